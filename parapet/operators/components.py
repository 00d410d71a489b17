"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, new_path, write_to


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free sum of their hashes; each hash is cut to 62 bits, so that billions of edges fit the decimal."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 2).cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node's larger neighbours point to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components", into: Scratch | None = None) -> DataFrame:
    """Rows (node, root) for every node of an edge; root is its component's smallest node.

    ``edges`` has columns u and v of one orderable type; loops and repeated edges
    are ignored, nulls must not occur, and a table without edges gives no rows.
    The rounds grow with the logarithm of the longest chain. Each is written to the
    shared folder, so a lost executor repeats one round at most, and the tables of
    older rounds are deleted. The result is a written table, one of ``into`` if
    that is given.

    A node with very many edges is no hot group: the minimum per node is aggregated
    before its shuffle and written, and the join that brings it back to the edges
    has both sides freshly shuffled, which adaptive execution may split.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, name)
    now = scratch.table(edges.select("u", "v").where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        wide = scratch.table(_large_star(now, scratch))
        now = scratch.table(_small_star(wide, scratch))
        after = _state(now)
        scratch.drop(keep=1)
        if after == state:
            break
        state = after
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    found = into.table(out) if into else write_to(out, new_path(spark, name))
    scratch.drop()
    return found
