"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised test items. Documents
stream through it word by word; at each word it knows the longest run ending
there that some item has. Where that run is as long as a window, the window's
words are hit.

Items are held in blocks of a bounded number of words, one automaton a block,
which each worker builds once from the broadcast block. Documents pass all
blocks in one scan; they are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_slices, table, texts

WINDOW = 10
#: Words of test items in one block, which bounds the broadcast and the automaton.
BLOCK_WORDS = 50_000
#: Blocks of items that one pass over the documents holds.
BLOCKS_A_PASS = 4
#: Documents with a larger share of hit words are removed, others lose the spans.
MAX_COVERAGE = 0.5
#: A document whose longest hit span is longer is removed too.
MAX_SPAN = 1000

#: Bytes after normalisation: A-Z becomes a-z; digits, a-z and all bytes of
#: characters beyond ASCII stay; every other byte parts words.
_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SPANS = "array<struct<start:int,end:int>>"


def words(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_KEEP).split()


class Automaton:
    """Suffix automaton of several word sequences.

    State 0 is the empty run. ``step`` maps word number to the next state,
    ``link`` is the state of the longest suffix in another class and ``size`` the
    longest run of a state. A run never crosses from one item into the next,
    since each item starts again at state 0.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.number.setdefault(w, len(self.number) + 1) for w in ws]) for name, ws in items if ws]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._name(coded)
        self.least = min([window, *(len(ids) for _, ids in coded)]) if coded else window

    def _extend(self, last: int, c: int) -> int:
        step, link, size = self.step, self.link, self.size
        known = step[last].get(c)
        if known is not None and size[known] == size[last] + 1:
            return known
        if known is not None:
            return self._split(last, c, known)
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at != -1 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at != -1:
            target = step[at][c]
            link[new] = target if size[target] == size[at] + 1 else self._split(at, c, target)
        return new

    def _split(self, at: int, c: int, target: int) -> int:
        """A state of its own for the runs of ``target`` no longer than at's plus one word."""
        step, link, size = self.step, self.link, self.size
        short = len(step)
        step.append(dict(step[target]))
        size.append(size[at] + 1)
        link.append(link[target])
        link[target] = short
        while at != -1 and step[at].get(c) == target:
            step[at][c] = short
            at = link[at]
        return short

    def _name(self, coded) -> None:
        """Which items hold a state's runs, for states that can be a whole window."""
        n, window = len(self.step), self.window
        holders: dict[int, set] = {}
        self.short: list[tuple[tuple[int, object], ...]] = [()] * n
        ends: dict[int, list] = {}
        for name, ids in coded:
            at = 0
            seen: set[int] = set()
            for c in ids:
                at = self.step[at][c]
                up = at
                while up > 0 and self.size[up] >= window and up not in seen:
                    seen.add(up)
                    holders.setdefault(up, set()).add(name)
                    up = self.link[up]
            if len(ids) < window:
                ends.setdefault(at, []).append((len(ids), name))
        #: For a state with runs of a window or more: the state of its last `window` words.
        self.base = [0] * n
        for at in sorted(range(1, n), key=self.size.__getitem__):
            up = self.link[at]
            if self.size[at] >= window:
                self.base[at] = self.base[up] if self.size[up] >= window else at
            if ends:
                self.short[at] = (*ends.get(at, ()), *self.short[up])
        self.holders = {at: frozenset(names) for at, names in holders.items()}

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (merged, half open, in words) of a document, and the items found."""
        n = len(tokens)
        if n < self.least:
            return [], set()
        ids = np.fromiter(map(self.number.get, tokens, [0] * n), np.int32, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
        starts, stops = known[::2], known[1::2]
        runs = np.flatnonzero(stops - starts >= self.least)
        spans: list[tuple[int, int]] = []
        found: set = set()
        for r in runs.tolist():
            self._run(ids[starts[r] : stops[r]].tolist(), int(starts[r]), spans, found)
        return spans, found

    def _run(self, ids: list[int], offset: int, spans: list, found: set) -> None:
        step, link, size, window, short = self.step, self.link, self.size, self.window, self.short
        at = length = 0
        for i, c in enumerate(ids, offset + 1):
            to = step[at].get(c)
            while to is None and at:
                at = link[at]
                length = size[at]
                to = step[at].get(c)
            if to is None:
                continue
            at, length = to, length + 1
            reach = 0
            if length >= window:
                reach = window
                found |= self.holders[self.base[at]]
            for k, name in short[at]:
                if k <= length:
                    reach = max(reach, k)
                    found.add(name)
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def item_blocks(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items in blocks of about ``block_words`` words each, by a hash of id and text."""
    counted = items.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = counted.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    if blocks == 1:
        return [counted]
    numbered = counted.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    return [numbered.where(F.col("block") == b).drop("block") for b in range(blocks)]


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def match(docs: DataFrame, items: DataFrame, *, text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, prefix: str = "__bench_") -> DataFrame:
    """``docs`` with columns <prefix>words (int), <prefix>spans and <prefix>items.

    Spans are hit words, merged, half open, counted in words of the document.
    Items are the ids, as strings, of the items with an occurring window; an item
    with a null id hits but isn't listed. Null texts have no words; null or
    wordless items have no window. Equal items count once by id. Repeated rows of
    ``docs`` stay rows of their own; an empty table gives an empty result. Columns
    of ``docs`` must not begin with ``prefix``.

    ``BLOCKS_A_PASS`` blocks of items are read in one pass over the documents; its
    result is written before the next, so that no task ever holds more automata.
    """
    rows, scans = _last_pass(docs, items, text_col, window, block_words, prefix)
    return rows.mapInArrow(_in_turn(scans), rows.schema)


_Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _in_turn(steps: list[_Step]) -> _Step:
    """All steps in one Python worker; a call of ``mapInArrow`` for each would hold a worker for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def _last_pass(docs: DataFrame, items: DataFrame, text_col: str, window: int, block_words: int, prefix: str) -> tuple[DataFrame, list[_Step]]:
    """What goes into the last pass of ``match``, and the scans of that pass."""
    spark = docs.sparkSession
    if clash := [c for c in docs.columns if c.startswith(prefix)]:
        raise ValueError(f"columns {clash} begin with the prefix {prefix}")
    bounded_batches(spark)
    out = docs.withColumns({f"{prefix}words": F.lit(0), f"{prefix}spans": F.array().cast(_SPANS), f"{prefix}items": F.array().cast("array<string>")})
    schema = out.schema
    sent, scans = [], []
    for block in item_blocks(items, block_words=block_words):
        if len(sent) == BLOCKS_A_PASS:
            out = table(out.mapInArrow(_in_turn(scans), schema), "bench-pass")
            for old_block in sent:
                old_block.unpersist()
            sent, scans = [], []
        held = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in block.collect()])
        sent.append(held)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = Automaton([(name, words(text.encode())) for name, text in held.value], window)
            for batch in in_slices(batches, 200):
                counts, spans, names = [], [], []
                old = batch.column(f"{prefix}spans").to_pylist(), batch.column(f"{prefix}items").to_pylist()
                for text, was, had in zip(texts(batch, text_col), *old, strict=True):
                    tokens = words(text)
                    new, found = automaton.scan(tokens)
                    counts.append(len(tokens))
                    spans.append([{"start": a, "end": b} for a, b in (_merged([(s["start"], s["end"]) for s in was], new) if was else new)])
                    names.append(sorted({*had, *(x for x in found if x is not None)}))
                new = {f"{prefix}words": counts, f"{prefix}spans": spans, f"{prefix}items": names}
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

        scans.append(scan)
    return out, scans


def digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_span.

    Rows with equal or null ids have rows of their own; a null text has no words,
    no items and the hash of no ids.
    """
    found = match(docs.select("doc_id", "text"), items, **options)
    length = lambda s: s["end"] - s["start"]
    hit = F.aggregate("__bench_spans", F.lit(0), lambda acc, s: acc + length(s))
    return found.select(
        "doc_id",
        F.col("__bench_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("__bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__bench_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("__bench_spans", length)), F.lit(0)).cast("long").alias("longest_span"),
    )


def _without(text: str, spans: list[dict]) -> str:
    """The text less the bytes from each span's first word to its last."""
    data = text.encode()
    kept, at, number, end = [], 0, 0, 0
    flat = data.translate(_KEEP)
    bounds = []
    for word in flat.split():
        start = flat.index(word, end)
        end = start + len(word)
        bounds.append((start, end))
    for span in spans:
        first, last = bounds[span["start"]][0], bounds[span["end"] - 1][1]
        kept.append(data[at:first])
        at = last
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", max_coverage: float = MAX_COVERAGE, max_span: int = MAX_SPAN, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of ``docs``, without what the benchmark holds.

    Hit spans are cut out of the text, and ``length_col`` follows the text. A
    document goes altogether when over ``max_coverage`` of its words are hit or a
    span has over ``max_span`` words. All other documents stay as they are, null
    texts, repeated rows and columns of any name included.
    """
    prefix = "__bench_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rows, scans = _last_pass(docs, items, text_col, window, block_words, prefix)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            spans, counts = batch.column(f"{prefix}spans").to_pylist(), batch.column(f"{prefix}words").to_pylist()
            lengths = [[s["end"] - s["start"] for s in x] for x in spans]
            stays = [sum(x) <= max_coverage * n and max(x, default=0) <= max_span for x, n in zip(lengths, counts, strict=True)]
            batch, spans = batch.filter(pa.array(stays, pa.bool_())), [x for x, stay in zip(spans, stays, strict=True) if stay]
            text = batch.column(text_col).to_pylist()
            columns = {text_col: [_without(t, s) if s else t for t, s in zip(text, spans, strict=True)]}
            if length_col in batch.schema.names:
                old = batch.column(length_col).to_pylist()
                columns[length_col] = [len(t) if s else n for t, s, n in zip(columns[text_col], spans, old, strict=True)]
            keep = [i for i, f in enumerate(batch.schema) if not f.name.startswith(prefix)]
            fields = [batch.schema.field(i) for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else batch.column(i) for i, f in zip(keep, fields, strict=True)], schema=pa.schema(fields))

    return rows.mapInArrow(_in_turn([*scans, cut]), docs.schema)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
