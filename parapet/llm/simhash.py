"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits. The number of set bits in each
segment makes a point in the grid {0, 1, 2}^32. One flipped bit moves one
coordinate by one, so the Manhattan distance of two points is never above the
Hamming distance of their fingerprints.

Points within Manhattan distance 4 are found by a grid join: the coordinates fall
into groups, eight for very many fingerprints; at most four groups can differ, so
some four of eight agree exactly. The cell of a point is its coordinates in four
chosen groups, over all 70 choices, refined by the raw bits of these groups. Points in a common cell are held
against the Manhattan distance, then against the Hamming distance itself. A dense
cell links by pivots (see ``clusters``), so that a group of near copies never
makes all its pairs.

Copies share a fingerprint, and only distinct fingerprints enter the join. So a
group of thousands of copies is one row there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.tables import Scratch, table
from .common import bounded_batches, free_prefix, in_slices, texts

SEED = 42
DISTANCE = 4
#: Members that a grid cell may have by chance.
BY_CHANCE = 1 / 256
_ODD = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a UTF-8 text: a bit is set where over half of the shingle hashes set it.

    Words are lower-cased in A-Z; shingles are words joined by one space, each
    occurrence counted. Fewer words than a shingle give one shingle of all; no
    words give 0.
    """
    import xxhash

    words = text.lower().split()  # bytes: only A-Z, and white space U+0009 to U+000D and space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory, whatever the text's length
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 500):
            fps = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bits set in each 2-bit segment, in unary: 00, 01 or 11.

    Written so, the bits in which two embeddings differ are their Manhattan distance.
    """
    odd = lambda x: x.bitwiseAND(F.lit(_ODD))
    high = F.shiftrightunsigned(fp, 1)
    return odd(fp.bitwiseOR(high)).bitwiseOR(F.shiftleft(odd(fp.bitwiseAND(high)), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_count(n: int, distance: int = DISTANCE) -> int:
    """Into how many groups the coordinates fall for n fingerprints.

    With g groups some g - distance agree. Fewer groups give fewer but fuller
    cells; the least number is taken that leaves a cell ``BY_CHANCE`` members by
    chance, and twice the distance is the most. What links is the same for any.
    """
    for g in range(distance + 1, 2 * distance):
        if n <= BY_CHANCE * 2.0 ** (64 * (g - distance) // g):
            return g
    return 2 * distance


def cells(distinct: DataFrame, distance: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """(cell, fp): each fingerprint in every grid cell of its embedding.

    Of ``groups`` groups of coordinates, two points within the distance agree in
    all but ``distance`` at least. ``distance`` flipped bits touch no more groups
    than that either, so within a grid cell only fingerprints that agree in the raw
    bits of these groups can link; the cell is refined by them. It is named by a
    hash; if two cells ever had the same, they would only share candidates.
    """
    if not 1 <= distance <= 4:
        raise ValueError("distance must be 1 to 4")
    groups = groups or 2 * distance
    cuts = [2 * (32 * g // groups) for g in range(groups + 1)]
    spans = list(zip(cuts, cuts[1:], strict=False))
    masks = [_signed(sum(((1 << (b - a)) - 1) << a for a, b in pick)) for pick in combinations(spans, groups - distance)]
    # A fingerprint becomes one row a mask, so the few bytes of them are spread over all tasks first.
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.sparkSession.sparkContext.defaultParallelism)
    spread = distinct.repartition(tasks, "fp").select("fp", embedding(F.col("fp")).alias("point"), F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    grid, raw = F.col("point").bitwiseAND(F.col("mask")), F.col("fp").bitwiseAND(F.col("mask"))
    return spread.select(F.xxhash64("mask", grid, raw).alias("cell"), "fp")


def _near(a: str, b: str, distance: int) -> Column:
    """Manhattan distance of the embeddings as the bound, then the fingerprints themselves."""
    bound = F.bit_count(embedding(F.col(a)).bitwiseXOR(embedding(F.col(b)))) <= distance
    return bound & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance)


def clusters(distinct: DataFrame, distance: int = DISTANCE, groups: int | None = None, into: Scratch | None = None) -> DataFrame:
    """(node, root) of each fingerprint that links to another: the least fingerprint that its links reach.

    ``distinct`` has one column fp without nulls or repeats. All pairs of a dense
    cell are never written. First the members of each cell are held against one of
    them, the pivot, and what links becomes one cluster; with other pivots this
    goes on until no pivot joins two clusters. Then, in cells that still hold
    several clusters, the members outside the largest are held against all members
    of other clusters, which finds every link that is left. So the result is exact,
    and the rows of a dense group grow with its members and not with their pairs.
    """
    spark = distinct.sparkSession
    scratch = Scratch(spark, "simhash-cells")
    every = cells(distinct, distance, group_count(distinct.count(), distance) if groups is None else groups)
    shared = scratch.table(every.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("cell"))
    members = scratch.table(every.join(shared, "cell"))
    roots, turn = None, 0
    while True:
        now = members.withColumn("root", F.col("fp")) if roots is None else members.join(roots, "fp", "left").select("cell", "fp", F.coalesce("root", "fp").alias("root"))
        if roots is not None:
            now = scratch.table(now)
        pick = (F.min if turn % 2 == 0 else F.max)(F.struct("fp", "root"))
        pivots = now.groupBy("cell").agg(pick.alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        pivots = scratch.table(pivots.select("cell", F.col("pivot.fp").alias("pivot"), F.col("pivot.root").alias("pivot_root")))
        found = now.join(pivots, "cell").where((F.col("root") != F.col("pivot_root")) & _near("fp", "pivot", distance))
        links = scratch.table(found.select(F.col("root").alias("u"), F.col("pivot_root").alias("v")).distinct())
        turn += 1
        if links.isEmpty():
            break
        roots = _merged(roots, links, scratch)
    # What pivots did not show: members outside the largest cluster of a cell, against all others in it.
    mixed = now.join(pivots.select("cell"), "cell", "left_semi")
    sizes = mixed.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = scratch.table(sizes.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("most")).select("cell", F.col("most.root").alias("largest")))
    sided = mixed.join(largest, "cell")
    a = sided.where("root <> largest").select("cell", F.col("fp").alias("fp_a"), F.col("root").alias("root_a"))
    b = sided.select("cell", F.col("fp").alias("fp_b"), F.col("root").alias("root_b"), (F.col("root") == F.col("largest")).alias("large"))
    once = F.col("large") | (F.col("fp_a") < F.col("fp_b"))
    rest = a.join(b, (a["cell"] == b["cell"]) & once & (F.col("root_a") != F.col("root_b")) & _near("fp_a", "fp_b", distance))
    links = scratch.table(rest.select(F.col("root_a").alias("u"), F.col("root_b").alias("v")).distinct())
    if not links.isEmpty():
        roots = _merged(roots, links, scratch)
    out = roots.select(F.col("fp").alias("node"), "root") if roots is not None else distinct.limit(0).select(F.col("fp").alias("node"), F.col("fp").alias("root"))
    out = into.table(out) if into else table(out, "simhash-clusters")
    scratch.drop()
    return out


def _merged(roots: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, root) after links between roots."""
    if roots is not None:
        links = links.union(roots.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    return components(links, "simhash-components", into=scratch).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, **options) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    ``component_id`` is the smallest doc_id that links reach, the document's own
    included. Empty texts and null texts have fingerprint 0 and link like any
    other. A null doc_id is never the smallest of a group with another id. Repeated
    ids and rows are documents of their own; an empty table gives an empty result.
    """
    marked = table(fingerprints(docs, **options), "simhash-fingerprints")
    scratch = Scratch(docs.sparkSession, "simhash-groups")
    groups = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = clusters(groups.select("fp"), distance, into=scratch)
    rooted = groups.join(roots, F.col("fp") == F.col("node"))
    # Written, so that the join on a root that very many fingerprints share may be split.
    ids = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = roots.join(ids, "root").select(F.col("node").alias("linked"), "component_id")
    named = table(groups.join(linked, F.col("fp") == F.col("linked"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    scratch.drop()
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: that with the smallest id, null ids last.

    Rows are held apart by a number of their own, not by their id: rows of equal
    or null ids are dropped only where their texts are near-duplicates. Of rows
    with the same smallest id the first by a hash of its content stays. Columns
    of any name stay as they are; null and empty texts are near-duplicates of one
    another, and an empty table stays empty.
    """
    own = free_prefix(docs, "__near_")
    row_col, key_col = own + "row", own + "key"
    content = [c for c, kind in docs.dtypes if "map<" not in kind]
    # Written once, so that a repeated task gives a row no other number.
    rows = table(docs.withColumn(row_col, F.monotonically_increasing_id()), "simhash-rows")
    key = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(*content).alias("hash"), F.col(row_col).alias("row"))
    found = near_duplicates(rows.select(key.alias(key_col), F.col(text_col)), distance, id_col=key_col, text_col=text_col)
    keep = found.where(F.col("doc_id.row") == F.col("component_id.row")).select(F.col("doc_id.row").alias(row_col))
    return rows.join(keep, row_col).select(*docs.columns)
