"""A Merkle manifest of a table: one tree a group, and one tree over the groups.

H is the SHA-256 of its inputs one after another, as lowercase hex; digests go in
as their hex text. The leaves of a group stand in the order of their keys. While a
level has several nodes, every ``FANOUT`` neighbours (the last run may be shorter,
down to a single node) become the H of their digests. The last node is the group's
subroot; a group of one leaf has that leaf. The subroots, in the order of their
groups, become the root in the same way.

The store. Leaves are hashed where their rows are read, and only digests go on.
They are range-sorted by group and key into sorted runs; the counts of the runs
give each leaf its coordinate (group number, place). A task reads such a sorted
piece from start to end and writes its nodes, ``FANOUT`` to a row, to the folder
of their level; a row's H is the node of the next level, which is read and
written in the same way. Nodes at the ends of a piece, whose neighbours another
task has, are rows of their own until the level is read: these few are then
joined by coordinate. So no task holds more than a batch, no level is sorted
again, and it makes no difference whether all rows are in one group.

Proofs. From the root down, the rows of a level meet what is above them by a merge
join on their coordinate, so what leaves have in common is read once a row. The
proof of a leaf is an array of steps, each the digests before it and after it in
its row.

Defined cases: nulls come first in the order of keys and groups, and are values of
their own; rows of equal key stand in the order of their digests; equal rows are
leaves of their own with equal digests. An empty table has no root and gives no
rows. Names of payload columns may be any, for they are held apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop_table, new_path
from ..operators.tables import write_to

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """H of values: ``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of all digests of a proof, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _row_digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(nodes, lambda x: x["digest"]), ""), 256)


def _levels(n: int) -> int:
    """Levels of rows of a tree with ``n`` leaves."""
    levels = 1
    while n > FANOUT:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class _Levels:
    """The levels of one or more trees in a folder, each a table of (grp, run, n, nodes).

    ``n`` is the number of a group's nodes on the level, ``run`` the place of the
    row among the group's; nodes hold place and digest, on level 0 the payload too.
    """

    def __init__(self, spark: SparkSession, path: str, levels: int, payload: list[T.StructField]):
        self.spark, self.path, self.levels, self.payload = spark, path, levels, payload

    def _schema(self, level: int) -> T.StructType:
        node = T.StructType([T.StructField("place", T.LongType()), T.StructField("digest", T.StringType()), *([] if level else self.payload)])
        return T.StructType.fromDDL("grp long, run long, n long").add("nodes", T.ArrayType(node)).add("whole", T.IntegerType())

    def rows(self, level: int) -> DataFrame:
        """(grp, run, n, nodes) of a level; rows that tasks have parted are joined here."""
        at = self.spark.read.schema(self._schema(level)).parquet(f"{self.path}/level={level}")
        apart = at.where("whole = 0").groupBy("grp", "run").agg(F.first("n").alias("n"), F.array_sort(F.flatten(F.collect_list("nodes"))).alias("nodes"))
        return at.where("whole = 1").drop("whole").unionByName(apart)

    def _write(self, nodes: DataFrame, level: int) -> None:
        """Neighbouring nodes, ``FANOUT`` to a row, as a task meets them from start to end; ``whole`` is 0 where another task has neighbours."""
        bounded_batches(self.spark)
        schema = self._schema(level)
        names = schema["nodes"].dataType.elementType.names

        def rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            grp, n, place = (table.column(c).to_numpy() for c in ("grp", "n", "place"))
            ends = np.append(starts, table.num_rows)
            run = place[starts] // FANOUT
            columns = [table.column(c).combine_chunks() for c in names]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))
            whole = np.diff(ends) == np.minimum(FANOUT, n[starts] - FANOUT * run)
            return pa.RecordBatch.from_arrays([pa.array(grp[starts]), pa.array(run), pa.array(n[starts]), held, pa.array(whole.astype(np.int32))], names=schema.names)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([rest, table]) if rest is not None else table
                if not table.num_rows:
                    continue
                grp, place = table.column("grp").to_numpy(), table.column("place").to_numpy()
                new = (np.diff(grp) != 0) | (np.diff(place // FANOUT) != 0) | (np.diff(place) != 1)
                starts = np.concatenate(([0], np.flatnonzero(new) + 1))
                if len(starts) > 1:
                    yield rows(table.slice(0, starts[-1]), starts[:-1])
                rest = table.slice(starts[-1])
            if rest is not None:
                yield rows(rest, np.array([0]))

        nodes.select("grp", "n", *names).mapInArrow(stream, schema).write.partitionBy("whole").parquet(f"{self.path}/level={level}")

    def grow(self, leaves: DataFrame) -> None:
        """Write all levels, each from the one before it; ``leaves`` are (grp, place, n, digest) and the payload."""
        for level in range(self.levels):
            self._write(leaves, level)
            up = self.rows(level).where(f"n > {FANOUT}")
            leaves = up.select("grp", F.col("run").alias("place"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), _row_digest(F.col("nodes")).alias("digest"))

    def tops(self) -> DataFrame:
        """(grp, digest): what remains of each tree."""
        last = [self.rows(level).where(f"n between 2 and {FANOUT}").select("grp", _row_digest(F.col("nodes")).alias("digest")) for level in range(self.levels)]
        lone = self.rows(0).where("n = 1").select("grp", F.col("nodes")[0]["digest"].alias("digest"))
        return reduce(DataFrame.unionByName, last, lone)

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """(grp, node, proof) of every leaf; ``above`` holds (grp, tail): the steps from the top of a group's tree on, none if not given, and what else is to go with its leaves."""
        more = [c for c in above.columns if c not in ("grp", "tail")] if above else []
        ahead = lambda x, of: F.array_join(F.transform(F.filter("nodes", lambda y: of(y["place"], x["place"])), lambda y: y["digest"]), "")
        step = F.struct(ahead(F.col("node"), lambda a, b: a < b).alias("before"), ahead(F.col("node"), lambda a, b: a > b).alias("after"))
        proof = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("tail"))).otherwise(F.col("tail"))
        tails = None
        for level in reversed(range(self.levels)):
            rows = self.rows(level)
            met = rows.where(f"n <= {FANOUT}")
            met = met.join(above, "grp") if above else met.withColumn("tail", F.array().cast("array<struct<before: string, after: string>>"))
            if tails is not None:
                met = met.unionByName(rows.where(f"n > {FANOUT}").join(tails, ["grp", "run"]))
            placed = met.select("grp", "n", "nodes", "tail", *more, F.explode("nodes").alias("node")).withColumn("proof", proof)
            tails = placed.select("grp", F.col("node.place").alias("run"), F.col("proof").alias("tail"), *more)
        return placed.select("grp", "node", "proof", *more)


class Manifest:
    """A written manifest: its ``root`` (None for an empty table), the levels of its trees, and the proofs of its leaves."""

    def __init__(self, path: str, root: str | None = None, leaves: _Levels | None = None, groups: _Levels | None = None):
        self.path, self.root, self.leaves, self.groups = path, root, leaves, groups

    def proofs(self) -> DataFrame:
        """(grp_key, node, subroot, proof) of every leaf; ``node`` holds its key, its digest and its payload."""
        above = self.groups.proofs().select(F.col("node.place").alias("grp"), F.col("node.grp_key").alias("grp_key"), F.col("node.digest").alias("subroot"), F.col("proof").alias("tail"))
        # Written, for every level of the leaves' trees meets it.
        above = write_to(above, f"{self.path}/above-{uuid.uuid4().hex}")
        return self.leaves.proofs(above).select("grp_key", "node", "subroot", "proof")

    def remove(self) -> None:
        drop_table(self.groups.spark, self.path)


def _numbered(sorted_leaves: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Leaves with (group number, place, group's size), and (grp_key, grp, n) of the groups, from the counts of the sorted pieces."""
    piece = F.shiftright("at", 33)  # a row's number holds its piece above 33 bits, and counts up from 0 within it
    here = sorted_leaves.groupBy(piece.alias("piece"), "grp_key").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    groups = here.groupBy("grp_key").agg(F.sum("rows").alias("n"))
    groups = _dense(groups, path)
    before = Window.partitionBy("grp_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    shifts = here.withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    shifts = shifts.join(groups, F.expr("grp_key <=> its_key")).select("piece", F.col("grp_key").alias("its_key"), "grp", "n", (F.col("ahead") - F.col("first")).alias("shift"))
    numbered = sorted_leaves.withColumn("piece", piece).join(shifts.withColumnRenamed("piece", "its_piece"), F.expr("piece = its_piece and grp_key <=> its_key"))
    placed = numbered.withColumn("place", F.col("at") + F.col("shift")).drop("piece", "its_piece", "its_key", "shift")
    return placed.sortWithinPartitions("grp", "place"), groups  # already so, unless the join had to shuffle


def _dense(groups: DataFrame, path: str) -> DataFrame:
    """(its_key, n, grp): groups numbered from 0 in their order, by sorted pieces."""
    ranged = groups.withColumnRenamed("grp_key", "its_key").repartitionByRange("its_key").sortWithinPartitions("its_key").withColumn("at", F.monotonically_increasing_id())
    ranged = write_to(ranged, f"{path}/group-numbers")
    counts = ranged.groupBy(F.shiftright("at", 33).alias("piece")).agg(F.count(F.lit(1)).alias("rows"))
    ahead = counts.select("piece", F.coalesce(F.sum("rows").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # one row a piece
    return ranged.withColumn("piece", F.shiftright("at", 33)).join(ahead, "piece").select("its_key", "n", (F.col("at").bitwiseAND((1 << 33) - 1) + F.col("ahead")).alias("grp"))


def build(leaves: DataFrame, path: str | None = None, *, payload: tuple[str, ...] = ()) -> Manifest:
    """Write the manifest of (grp_key, key, digest and the payload columns), one row a leaf."""
    spark = leaves.sparkSession
    path = path or new_path(spark, "manifest")
    # The row number parts rows of equal key among tasks; equal digests may stand in any order.
    own = leaves.select("grp_key", "key", "digest", *payload).withColumn("at", F.monotonically_increasing_id())
    own.write.parquet(f"{path}/hashed")
    hashed = spark.read.schema(own.schema).parquet(f"{path}/hashed")
    order = ["grp_key", "key", "digest", "at"]
    hashed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{path}/sorted")
    drop_table(spark, f"{path}/hashed")
    numbered, groups = _numbered(spark.read.schema(own.schema).parquet(f"{path}/sorted"), path)
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_groups:
        return Manifest(path)
    lower = _Levels(spark, f"{path}/leaves", _levels(most), [own.schema[c] for c in ("key", *payload)])
    lower.grow(numbered)
    tops = lower.tops().join(groups.drop("n"), "grp")
    tops = tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.lit(n_groups).cast("long").alias("n"), "digest", F.col("its_key").alias("grp_key"))
    upper = _Levels(spark, f"{path}/groups", _levels(n_groups), [T.StructField("grp_key", own.schema["grp_key"].dataType)])
    upper.grow(tops.repartitionByRange("place").sortWithinPartitions("place"))
    drop_table(spark, f"{path}/sorted")
    return Manifest(path, upper.tops().first()["digest"], lower, upper)


def document_leaf(text: Column) -> Column:
    """The leaf of a row of documents with ``text`` as its text."""
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def audit(docs: DataFrame, tampered: Column, changed: Column, path: str | None = None) -> DataFrame:
    """Every document's leaf and proof, and the root that its row gives when tampered rows hold ``changed`` as text.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified). The claimed
    leaf goes through the store as payload of the leaf, so texts are read once.
    """
    spark = docs.sparkSession
    claimed = F.when(tampered, document_leaf(changed))
    made = build(docs.select(F.col("lang").alias("grp_key"), F.col("doc_id").alias("key"), document_leaf(F.col("text")).alias("digest"), claimed.alias("claimed")), path, payload=("claimed",))
    if made.root is None:
        schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType)
        return spark.createDataFrame([], reduce(lambda s, c: s.add(c, T.StringType()), ("leaf", "subroot", "root", "proof_sha256", "folded_root"), schema).add("verified", T.BooleanType()))
    root = F.lit(made.root)
    folded = fold(F.coalesce("node.claimed", "node.digest"), F.col("proof"))
    out = made.proofs().select(F.col("node.key").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
