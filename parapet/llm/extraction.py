"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one a block element. Menus, scripts, forms,
adverts and the like give no text. The lengths of the lines that are left, links
discounted, are summed over a sliding window of lines. Where the sum rises over
the surge level the main text begins, where it falls to nothing it ends; the text
between surge and dive points is kept whole, short lines included. All such runs of
a page are kept. A line inside an article or a main element weighs a surge at least,
so that no marked line is lost, however short.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, in_slices

#: Lines in a window, and the length of a window's text that counts as a surge.
WINDOW = 3
SURGE = 60
#: A line whose text is link text for over this share weighs nothing.
LINK_SHARE = 0.5

#: Where a comment, a tag or another piece of markup begins, and where a tag ends: past quoted values, or at the next bracket.
_MARK = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements without main text.
_DROPPED = frozenset("head nav footer aside form script style noscript template iframe object embed svg canvas math button select textarea fieldset dialog menu title audio video map noframes".split())
#: Elements that begin and end a line.
_BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "figcaption", "legend", "summary"}
#: Names in class, id or role that mark parts outside the main text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " footer sidebar aside comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager masthead"
    " complementary contentinfo search dialog skip copyright legal disclaimer paywall".split()
)
#: Words that beside such a name in one class only tell its place or shape: cookie-bar, sidebar-left.
_LAYOUT = frozenset(
    "article post entry page site main global primary secondary top bottom left right inner outer fixed sticky mobile desktop bar box btn button buttons icon icons"
    " link links list lists item items panel block wrap wrapper container content area section row col column group holder slot form header head title text".split()
)
_CONTENT = frozenset(("article", "main"))
_NAMED = frozenset("div section ul ol dl p table span aside article li header figure details center a tr td".split())


@dataclass
class Line:
    text: str
    weight: int
    marked: bool


def _is_name(token: str) -> bool:
    """Whether a class, id or role as a whole names a part outside the main text: share-buttons, not share-price."""
    words = {w.rstrip("0123456789") for w in _WORDS.findall(token)} - {""}
    return not _NAMES.isdisjoint(words) and words <= _NAMES | _LAYOUT


def _is_outside(tag: str, attributes: str, in_content: bool, by_name: bool) -> bool:
    if tag in _DROPPED:
        return True
    if tag == "header" and not in_content:
        return True
    if len(attributes) < 4:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if by_name and name in ("class", "id", "role") and tag in _NAMED:
            if any(map(_is_name, value.split())):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def lines(page: str, by_name: bool = True) -> list[Line]:
    """The lines of a page outside dropped parts; without ``by_name``, names in class, id and role drop nothing.

    ``marked`` lines lie inside an article or a main element. The time grows with
    the page's length alone, however broken its markup is.
    """
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    homes: list[str] = []
    skip, depth = "", 0
    at, end = 0, len(page)

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            plain = entities.unescape(piece) if "&" in piece else piece
            parts.append(plain)
            if in_link:
                linked += len(plain)

    def flush() -> None:
        nonlocal linked
        if parts:
            plain = " ".join("".join(parts).split())
            if plain:
                out.append(Line(plain, 0 if linked > LINK_SHARE * len(plain) else len(plain), bool(homes)))
            parts.clear()
        linked = 0

    quoted = True
    last = page.rfind(">")
    while at < end:
        m = _MARK.search(page, at) if at <= last else None
        if not m or m.start() > last:  # no markup can end any more
            if not skip:
                text(page[at:])
            break
        if not skip:
            text(page[at : m.start()])
        if not m[2]:
            if m[0] == "<!--":
                close = _COMMENT_END.search(page, m.end())
                at = close.end() if close else end
            else:
                at = page.index(">", m.start()) + 1
            continue
        ends = _TAG_END.match(page, m.end()) if quoted else None
        if not ends:
            # A quote that never closes: from here on a tag ends at the next bracket, so that no tag is read to the end of the page again.
            quoted = False
        close = ends.end() if ends else page.find(">", m.end()) + 1
        if not close:
            if not skip:
                text(page[m.start() :])
            break
        attributes, at = page[m.end() : close], close
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in _RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = (page.find(">", stop.end()) + 1 or end) if stop else end
            continue
        if skip:
            if tag == skip and tag not in _VOID:
                depth += -1 if closing else 0 if skip in ("p", "li") else 1
                if depth <= 0:
                    skip = ""
                    continue
            # A dropped paragraph ends where the next block begins or the one around it ends.
            if not (skip == "p" and (tag in _CLOSES_P or closing and tag in _BLOCKS) or skip == "li" and (tag == "li" or closing and tag in ("ul", "ol"))):
                if not (closing and tag in ("html", "body")):
                    continue
            skip = ""
        if closing:
            if tag in _BLOCKS:
                flush()
            if tag == "a":
                in_link = 0
            if tag in homes:
                while homes.pop() != tag:
                    pass
            continue
        if tag in _BLOCKS:
            flush()
            in_link = 0
        if tag == "br":
            parts.append(" ")
            continue
        if _is_outside(tag, attributes[:-1], bool(homes), by_name):
            if tag in _BLOCKS or tag in _DROPPED:
                flush()
            if tag not in _VOID and not attributes.endswith("/>"):
                skip, depth = tag, 1
            continue
        if tag == "a":
            in_link = 1
        elif tag in _CONTENT:
            homes.append(tag)
    flush()
    return out


def _regions(weights: list[int]) -> list[tuple[int, int]]:
    """Half-open runs of lines between surge and dive points."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if sums[i] >= SURGE and weights[i]:
            stop = i
            while stop < n and sums[stop] > 0:
                stop += 1
            found.append((i, stop))
            i = stop
        else:
            i += 1
    return found


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks in order, parted by an empty line; empty if there is none.

    A page on which names drop all text is read once more without them, and then
    only its surges count.
    """
    found = lines(page or "")
    kept = _kept(found) or [x for x in found if x.weight]
    if not kept and page:
        kept = _kept(lines(page, by_name=False))
    return "\n\n".join(x.text for x in kept)


def _kept(found: list[Line]) -> list[Line]:
    weights = [max(x.weight, SURGE) if x.marked else x.weight for x in found]
    kept = []
    for a, b in _regions(weights):
        while b > a and not weights[b - 1]:
            b -= 1
        kept += found[a:b]
    return kept


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``pages`` without the markup column, with the main text and its length in code points.

    Null, empty and textless pages give an empty text. Pages are read one by one
    and whole; repeated rows stay. Existing columns of the new names are replaced.
    """
    bounded_batches(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, text_col, length_col)]
    own = pages.select(*others, F.col(html_col).cast("string").alias("__html"))
    schema = T.StructType([*pages.select(*others).schema, T.StructField(text_col, T.StringType()), T.StructField(length_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            found = [main_text(x) for x in batch.column("__html").to_pylist()]
            fields = [f for f in batch.schema if f.name != "__html"]
            kept = [batch.column(f.name) for f in fields]
            fields += [pa.field(text_col, pa.string()), pa.field(length_col, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], schema=pa.schema(fields))

    return own.mapInArrow(run, schema)
