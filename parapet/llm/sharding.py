"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child of the node draws a number from the hash of (document,
child) and its weight: ``-ln(u) / weight``. The smallest draw wins, so a child
gets its share of the weight, and a draw depends on nothing but the document and
that child. Where one child's weight changes, only that child's draws change:
documents move into or out of its subtree, none between its siblings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets of a shard, within which rows are numbered.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int) -> list[Shard]:
    """Two regions of two racks of two shards, and a region of its own for each shard past the eighth.

    From eight shards on, one more takes rows only into itself. Fewer than eight
    have a region each, and so grow in the same way up to seven; from seven to
    eight rows move between old shards too, for regions and racks come in.
    """
    full = 8 if shards >= 8 else 0
    nested = [Shard(f"region{s // 4}", f"rack{s // 2}", s) for s in range(full)]
    return nested + [Shard(f"region-of-{s}", f"rack-of-{s}", s) for s in range(full, shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own."""
    s = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Shard(f"region-of-{s}", f"rack-of-{s}", s, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    # 52 random bits plus a half, as a fraction: never 0, never 1.
    u = (F.xxhash64(key, F.lit(path)).bitwiseAND((1 << 52) - 1).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / F.lit(float(weight))


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key (a string column) in the tree."""
    if not tree or any(x.weight <= 0 for x in tree):
        raise ValueError("a tree needs shards of positive weight")

    def winner(children: dict[str, tuple[float, Column]]) -> Column:
        if len(children) == 1:
            return next(iter(children.values()))[1]
        names = sorted(children)
        draws = F.array(*[F.struct(_draw(key, n, children[n][0]).alias("draw"), F.lit(i).alias("i")) for i, n in enumerate(names)])
        best = F.array_min(draws)["i"]
        out = F.when(best == 0, children[names[0]][1])
        for i, n in enumerate(names[1:], 1):
            out = out.when(best == i, children[n][1])
        return out

    regions = {}
    for region in sorted({x.region for x in tree}):
        racks = {}
        for rack in sorted({x.rack for x in tree if x.region == region}):
            own = [x for x in tree if (x.region, x.rack) == (region, rack)]
            shards = {f"{region}/{rack}/{x.shard}": (x.weight, F.lit(x.shard)) for x in own}
            racks[f"{region}/{rack}"] = (sum(x.weight for x in own), winner(shards))
        regions[region] = (sum(x.weight for x in tree if x.region == region), winner(racks))
    return winner(regions).cast("int")


def shard_documents(docs: DataFrame, tree: list[Shard], after: list[Shard] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 1 (null text: 1, and the crc of
    no bytes, 0). ``slot`` numbers the rows of a shard from 0 without gaps.
    ``grown_shard`` is the shard in the tree ``after``, null without one. A null
    id is the key 'null'; rows with equal ids share a shard and have slots of
    their own. The text itself is never shuffled.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, tree).alias("shard"),
        (place(key, after) if after else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"),
    )
    # One row a shard and bucket; the rows are dealt by both for the window below anyway.
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return placed.join(ahead, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.row_number().over(inside) - 1).cast("long").alias("slot"), "grown_shard"
    )
