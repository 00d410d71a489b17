"""Text, date and number expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import wrapped  # noqa: F401

FEET = 0.3048


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that compatibility decomposition (NFKD) turns into one ASCII character, these characters, and those that become several."""
    one, several = {}, {}
    for code in range(0x80, 0x10000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[chr(code)] = plain
        elif plain and code < 0x2000 or 0xFB00 <= code <= 0xFB06:  # Latin digraphs, ligatures, fractions
            several[chr(code)] = plain
    return "".join(one), "".join(one.values()), several


_FROM, _TO, SEVERAL = _foldings()


def fold(text: Column) -> Column:
    """ASCII form of a text: compatibility decomposition, then all that is not ASCII goes."""
    odd = "[" + "".join(SEVERAL) + "]"
    wide = text
    for c, plain in SEVERAL.items():
        wide = F.replace(wide, F.lit(c), F.lit(plain))
    folded = F.regexp_replace(F.translate(F.when(text.rlike(odd), wide).otherwise(text), _FROM, _TO), r"[^\x00-\x7F]+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, all else one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def match_text(text: Column) -> Column:
    """A name for matching: folded, without parentheses, single spaces, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(text)), r"\([^)]*\)", " "), r"\s+", " "))


def null_like(text: Column) -> Column:
    """Empty text for '', nan, none and null in any case, else the trimmed text."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(bare).isin("", "nan", "none", "null"), "").otherwise(bare)


def safe_double(text: Column) -> Column:
    """A number or null; NaN is null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def floor_days(a: Column, b: Column) -> Column:
    """Whole days from b to a, rounded toward the past."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.floor((micros(a) - micros(b)) / F.lit(86_400_000_000)).cast("long")


def annual_windows(start: Column, end: Column) -> Column:
    """Years that cover [start, end): array of struct(begin, stop), the last cut off at the end."""
    n = F.greatest(F.lit(1), F.ceil(F.months_between(end, start) / 12).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.add_months(start, 12 * i).alias("begin"), F.least(F.add_months(start, 12 * (i + 1)), end).alias("stop")))


def window_starts(length: Column, size: int, stride: int) -> Column:
    """Starts of windows over a length: every stride, and one that ends where the length ends."""
    last = F.greatest(F.lit(0), length - size).cast("int")
    return F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))


def row_sum(*values: Column) -> Column:
    return sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))


def reasons(*flags: tuple[Column, str]) -> Column:
    """Names of the flags that hold, each once, in order, joined by ';'."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))), ";")


def height_bin(value: Column, edges=(0, 3, 6, 10, 25, 50)) -> Column:
    """'3-6' for 3 <= value < 6; the last bin is open."""
    out = F.when(value < edges[0], None)
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(value < high, F.lit(f"{low}-{high}"))
    return out.when(value.isNotNull(), F.lit(f"{edges[-1]}+"))


def height_category(p90: Column, most: Column) -> Column:
    """lowrise, midrise or highrise of a chip by its 90th percentile and its maximum height in metres."""
    return F.when((p90 >= 30) | (most >= 50), "highrise").when(p90 >= 10, "midrise").otherwise("lowrise")


def first_column(available: list[str], preference: list[str]) -> str | None:
    """The first of the preferred names that a table has, whatever their case."""
    held = {a.lower(): a for a in available}
    return next((held[p.lower()] for p in preference if p.lower() in held), None)


def preferred(preference: list[str], available: Column) -> Column:
    """First of the preference list that the array holds, else null."""
    return F.get(F.array_intersect(F.array(*map(F.lit, preference)), available), F.lit(0))
