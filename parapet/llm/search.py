"""Ranked lexical search: impact-ordered postings, read score at a time.

The index. A term is a run of ASCII letters and digits and of other characters
beyond ASCII, in whole texts, with only A-Z lower-cased. Texts are read once, to
their terms and counts; then N, L and each document's impacts are known, and
tasks write segments of whole documents: a row a term, which holds the exact
impacts in descending order, where the group of each ends, and the documents of
the groups. Documents have slots in a segment in ascending order of their ids. All
rows and all terms are indexed. A segment is as large as ``SEGMENT_DOCS`` and
``SEGMENT_POSTINGS`` allow, so a term that every document holds is spread over
all segments.

The search. Items are taken in blocks of ``BLOCK_TERMS`` terms; the postings of a
block's terms are shuffled once, to their segment. A segment is read score at a
time: the groups of all terms of an item in descending order of weight times
impact, added up by document. Between steps, the next group of each term bounds
what any document may still get. As soon as few documents can reach the k-th best
sum, no other can be among the k best, and the scores of these few are completed
from what is left of the postings. The k best of all segments hold the k best of
all documents.

Defined cases: null and empty texts have no terms; documents without terms count
for nothing; an item without known terms finds nothing. Items are told apart by
row: rows of equal item_id each have their own ranks, and so have documents of
equal doc_id, in any order among themselves; a null doc_id comes first among equal
scores. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import write_to
from .common import bounded_batches, drop_table, in_slices, new_path, texts

#: Documents, and postings, of a segment, which bound the memory of a task.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4_000, 500_000
#: Terms of the items of one block, which come to the driver and go to all tasks.
BLOCK_TERMS = 100_000
#: A search stops early when so many times k documents, or fewer, may be among the k best.
FEW = 10

_LETTERS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text, in order."""
    return text.translate(_LETTERS).split()


def impact(tf, n, docs: int, terms: int):
    """What a term adds to a score for each unit of its weight: ``tf`` times in a text of ``n`` terms, in ``docs`` documents of ``terms`` terms."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))


def weight(docs: int, df: F.Column) -> F.Column:
    return F.floor(1000 * F.log((F.lit(2 * docs + 2).cast("double")) / (2 * df + 1).cast("double")))


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, terms, tfs): the number of terms of each text, and its distinct terms with their counts."""
    bounded_batches(rows.sparkSession)
    schema = T.StructType().add(key, rows.schema[key].dataType).add("n", T.LongType()).add("terms", T.ArrayType(T.StringType())).add("tfs", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 500):
            found = [Counter(terms_of(t)) for t in texts(batch, text)]
            ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array([t for c in found for t in c], pa.string()))
            tfs = pa.ListArray.from_arrays(ends, pa.array([x for c in found for x in c.values()], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([c.total() for c in found], pa.int64()), terms, tfs], names=[key, "n", "terms", "tfs"])

    return rows.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


_POSTINGS = "segment long, term string, impacts array<long>, ends array<int>, slots array<int>"


def _segments(counts: DataFrame, docs: int, terms: int) -> DataFrame:
    """Impact-ordered postings of segments; a row without a term holds the ids of a segment's slots."""
    ids = counts.schema["doc_id"].dataType
    schema = T.StructType.fromDDL(_POSTINGS).add("ids", T.ArrayType(ids))
    index = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("impacts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("slots", pa.list_(pa.int32()))])

    def segment(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
        one = lambda name: table.column(name).combine_chunks()
        names = one("terms").flatten().dictionary_encode()
        order = pc.array_sort_indices(names.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.diff(one("terms").offsets.to_numpy())
        slot = np.repeat(np.arange(table.num_rows, dtype=np.int32), sizes)
        term = place[names.indices.to_numpy()]
        value = impact(one("tfs").flatten().to_numpy(), np.repeat(one("n").to_numpy(), sizes), docs, terms)
        by = np.lexsort((slot, -value, term))
        slot, term, value = slot[by], term[by], value[by]
        last = np.append((np.diff(term) != 0) | (np.diff(value) != 0), True)  # of each group of equal impact
        groups = np.flatnonzero(last)
        group_term = term[groups]
        first_posting = np.searchsorted(term, np.arange(len(order)))
        first_group = np.searchsorted(group_term, np.arange(len(order) + 1)).astype(np.int32)
        held = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(order), number)), names.dictionary.take(pa.array(order)),
                pa.ListArray.from_arrays(pa.array(first_group), pa.array(value[groups])),
                pa.ListArray.from_arrays(pa.array(first_group), pa.array((groups + 1 - first_posting[group_term]).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(np.append(first_posting, len(term)).astype(np.int32)), pa.array(slot)),
            ],
            schema=index,
        )
        own = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), one("doc_id"))
        yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.nulls(1, f.type) for f in list(index)[1:]), own], names=[*index.names, "ids"])
        for at in range(0, len(order), 20_000):
            part = held.slice(at, 20_000)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, own.type)], names=[*index.names, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting, rows, postings = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in in_slices(batches, min(500, SEGMENT_DOCS)):
            waiting.append(batch)
            rows += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if rows >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                yield from segment(pa.Table.from_batches(waiting), number)
                number, waiting, rows, postings = number + 1, [], 0, 0
        if rows:
            yield from segment(pa.Table.from_batches(waiting), number)

    return counts.where("n > 0").mapInArrow(run, schema)


def best_of(postings: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], slots: int, k: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best slots of a segment with their scores, and how many postings were added before it was certain which they are.

    ``postings`` has (weight, impacts, ends, slots) of each term. Scores of 0 don't count.
    """
    scores = np.zeros(slots, np.int64)
    adds = [w * impacts for w, impacts, _, _ in postings]
    counts = [np.diff(ends, prepend=0) for _, _, ends, _ in postings]
    of = np.repeat(np.arange(len(postings)), [len(x) for x in adds])
    add, count, where = np.concatenate(adds), np.concatenate(counts), np.concatenate([s for *_, s in postings])
    start = np.cumsum(count) - count
    order = np.argsort(-add, kind="stable")  # a term's own groups stay in order
    until = np.cumsum(count[order])
    first = np.cumsum([0, *(len(x) for x in adds)])[:-1]
    lengths = np.array([len(x) for x in adds])

    def read(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[groups]
        at = np.repeat(start[groups] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return where[at], np.repeat(add[groups], n)

    def sums(of_slots: np.ndarray, values: np.ndarray) -> np.ndarray:  # below 2 ** 53, so exact
        return np.bincount(of_slots, values, slots).astype(np.int64)

    done, chosen = 0, None
    for step in range(1, 9):
        to = len(order) if step == 8 else int(np.searchsorted(until, until[-1] * step // 8)) + 1
        if to <= done:
            continue
        scores += sums(*read(order[done:to]))
        done = to
        if done == len(order):
            break
        read_groups = np.bincount(of[order[:done]], minlength=len(postings))
        left = read_groups < lengths
        bound = int(add[first[left] + read_groups[left]].sum())  # what any document may still get
        kth = int(np.partition(scores, slots - k)[slots - k]) if slots > k else 0
        if kth and bound < kth:  # a document not met so far can't be among the best
            able = scores + bound >= kth
            if np.count_nonzero(able) <= few * k:
                chosen = able
                break
    added = int(until[done - 1])
    if chosen is not None:
        of_slots, values = read(order[done:])
        mine = chosen[of_slots]
        scores = np.where(chosen, scores + sums(of_slots[mine], values[mine]), 0)
    if slots > k:
        kth = max(1, int(np.partition(scores, slots - k)[slots - k]))
        found = np.flatnonzero(scores >= kth)
    else:
        found = np.flatnonzero(scores)
    found = found[np.lexsort((found, -scores[found]))[:k]]
    return found, scores[found], added


class Index:
    """A written index: ``docs`` documents with terms, ``terms`` terms in all."""

    def __init__(self, spark: SparkSession, path: str, ids: T.DataType, docs: int, terms: int):
        self.spark, self.path, self.ids, self.docs, self.terms = spark, path, ids, docs, terms

    def postings(self) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromDDL(_POSTINGS).add("ids", T.ArrayType(self.ids))).parquet(f"{self.path}/segments")

    def search(self, items: DataFrame, k: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
        numbered = items.select(F.monotonically_increasing_id().alias("row"), id_col, text_col)
        asked = write_to(numbered, f"{self.path}/items")
        found, block, size = [], {}, 0
        if self.docs:
            for r in term_counts(asked, "row", text_col).select("row", "terms").toLocalIterator():
                if r["terms"]:
                    block[r["row"]] = r["terms"]
                    size += len(r["terms"])
                if size >= BLOCK_TERMS:
                    found.append(self._block(block, k, len(found)))
                    block, size = {}, 0
            if block:
                found.append(self._block(block, k, len(found)))
        if not found:
            return asked.select(id_col, F.lit(0).alias("rank"), F.lit(None).cast(self.ids).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
        return ranked.join(asked.select("row", id_col), "row").select(id_col, "rank", "doc_id", "score")

    def _block(self, block: dict[int, list[str]], k: int, number: int) -> DataFrame:
        """The ``k`` best documents of each segment for some items."""
        spark, docs = self.spark, self.docs
        wanted = spark.createDataFrame([(t,) for t in sorted({t for terms in block.values() for t in terms})], "term string")
        postings = self.postings()
        # The terms of a block are bounded, so the index isn't shuffled to meet them.
        chosen = write_to(postings.where("term is not null").join(F.broadcast(wanted), "term", "left_semi").unionByName(postings.where("term is null")), f"{self.path}/block-{number}")
        weights = chosen.where("term is not null").groupBy("term").agg(weight(docs, F.sum(F.size("slots"))).alias("w"))
        weights = {r["term"]: r["w"] for r in weights.collect()}  # BLOCK_TERMS and the terms of one item at most
        asked = spark.sparkContext.broadcast([(row, [(t, weights[t]) for t in terms if t in weights]) for row, terms in block.items()])

        def search(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            terms = table.column("term").to_pylist()
            ids = table.column("ids").combine_chunks().flatten()
            lists = {c: table.column(c).combine_chunks() for c in ("impacts", "ends", "slots")}
            lists = {c: (x.offsets.to_numpy(), x.values.to_numpy()) for c, x in lists.items()}
            at = {t: i for i, t in enumerate(terms) if t is not None}
            rows, slots, scores = [], [], []
            for row, weighted in asked.value:
                mine = [(w, *(values[o[at[t]] : o[at[t] + 1]] for o, values in lists.values())) for t, w in weighted if t in at]
                if mine:
                    best, score, _ = best_of(mine, len(ids), k)
                    rows.append(np.full(len(best), row))
                    slots.append(best)
                    scores.append(score)
            whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
            return pa.table({"row": whole(rows), "doc_id": ids.take(pa.array(whole(slots))), "score": whole(scores)})

        schema = T.StructType().add("row", T.LongType()).add("doc_id", self.ids).add("score", T.LongType())
        found = chosen.groupBy("segment").applyInArrow(search, schema)
        return write_to(found, f"{self.path}/found-{number}")

    def remove(self) -> None:
        drop_table(self.spark, self.path)


def build(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index all rows of ``docs``; ids may be of any type that has an order."""
    spark = docs.sparkSession
    path = path or new_path(spark, "search")
    counts = write_to(term_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text"), f"{path}/counts")
    size = counts.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    index = Index(spark, path, docs.schema[id_col].dataType, *size)
    write_to(_segments(counts, *size), f"{path}/segments")
    drop_table(spark, f"{path}/counts")
    return index
