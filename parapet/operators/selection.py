"""Shortlists, greedy selection, pairs, ranks and running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def fallback_pool(df: DataFrame, by: list[str], strict: Column) -> DataFrame:
    """The strict rows of a group if it has any, else all its rows; ``relaxed`` tells which."""
    any_strict = F.max(strict.cast("int")).over(Window.partitionBy(*by)) == 1
    return df.withColumn("relaxed", ~any_strict).where(strict | F.col("relaxed"))


def greedy(df: DataFrame, by: str, slots: int, key, fields: list[str]) -> DataFrame:
    """Fill ``slots`` one after the other with the candidate of least ``key(candidate, chosen, slot)``.

    One row a group holds its candidates, so ``df`` must be a shortlist: the
    caller bounds the rows of a group. One native expression walks the slots, which
    count from 1. Returns one row a chosen candidate with its slot.
    """
    held = df.groupBy(by).agg(F.collect_list(F.struct(*fields)).alias("candidates"))

    def choose(chosen: Column, slot: Column) -> Column:
        left = F.filter(F.col("candidates"), lambda c: ~F.exists(chosen, lambda x: x == c))
        best = F.array_min(F.transform(left, lambda c: F.struct(key(c, chosen, slot).alias("key"), c.alias("c"))))
        return F.when(F.size(left) > 0, F.concat(chosen, F.array(best["c"]))).otherwise(chosen)

    empty = F.slice("candidates", 1, 0)
    picked = held.select(by, F.aggregate(F.sequence(F.lit(1), F.lit(slots)), empty, choose).alias("chosen"))
    return picked.select(by, F.posexplode("chosen").alias("slot", "c")).select(by, (F.col("slot") + 1).alias("slot"), "c.*")


def running_best(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """best (so far), improved, and best_at (where the best was)."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("best", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("improved", before.isNull() | (F.col(value) < before))
    return out.withColumn("best_at", F.last(F.when(F.col("improved"), F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def consecutive(df: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """run: how many rows in a row, this one included, the flag has held."""
    w = Window.partitionBy(by).orderBy(order)
    island = df.withColumn("island", F.sum(F.when(flag, 0).otherwise(1)).over(w))
    inside = Window.partitionBy(by, "island").orderBy(order)
    return island.withColumn("run", F.sum(F.when(flag, 1).otherwise(0)).over(inside)).drop("island")
