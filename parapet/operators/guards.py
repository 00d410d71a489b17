"""Schema, null, key and reference checks; each returns the rows that break the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself; raises with the names it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns in this order; those that ``df`` lacks are null."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def front(df: DataFrame, names: list[str]) -> DataFrame:
    """The same columns, the named ones first."""
    return df.select(*names, *[c for c in df.columns if c not in names])


def null_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row a column: column, rows, missing."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    return counts.unpivot("rows", names, "column", "missing").select("column", "rows", "missing")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(fact: DataFrame, dimension: DataFrame, on: str, key: str) -> DataFrame:
    """Distinct keys of ``fact`` that the dimension lacks."""
    return fact.select(F.col(on).alias(key)).distinct().join(dimension.select(key), key, "left_anti")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate keys {keys}: {[tuple(r)[:-1] for r in bad]}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fails if the right keys aren't unique."""
    return left.join(require_unique(right, on), on, "left")


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Each alias as a copy of its column, for callers that know the older name; a stale column of that name goes first."""
    return df.drop(*[a for a in aliases if a in df.columns]).withColumns({a: F.col(c) for a, c in aliases.items()})


def exact_cover(df: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """Keys of one side that the other lacks, with what is wrong: 'missing' from the template, or 'unknown' to ``df``; no rows if the template covers exactly."""
    own, given = df.select(key).distinct(), template.select(key).distinct()
    missing = own.join(given, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.union(given.join(own, key, "left_anti").withColumn("problem", F.lit("unknown")))
