"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document waits in the queue of its source, in a shuffled order that only
its id decides. Its virtual finish time is the number of words its source has
sent by then, itself included, divided by the source's target; sources with
larger targets therefore send more words in the same virtual time. The mix takes
documents in order of virtual finish time until the total budget is spent. A
document may come round again in a second epoch, behind the whole first one.

No window holds a whole source or the whole corpus. Running sums are made in two
steps: sums of hash buckets first (a bounded number of buckets a source), then
rows inside one bucket. The global cut is found the same way, over buckets of
virtual time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, table, word_count

#: Weights in order of the source names, repeated.
WEIGHTS = (3, 1, 2)
#: Hex digits of the shuffle hash that make one bucket of a source's queue.
BUCKET_DIGITS = 3
#: Buckets of virtual time between 0 and 2; later times share one bucket.
TIME_BUCKETS = 8192


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Target words of each source: one row (source, source_size, target) a source.

    Sources by code point, null last, get ``weights`` in turn and share
    ``share`` times all words by weight. No source gets over ``most`` times its
    own words; what it can't use is shared again by weight among the others.

    Sources are put in order of the weight at which they fill up; the full ones
    are then the first k, and the rest share what is left. The windows below run
    over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    fill = Window.orderBy(F.col("r"), F.col("source").asc_nulls_last())
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum(most * F.col("source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(share)
    return (
        sources.withColumn("r", most * F.col("source_size") / F.col("w"))
        .withColumn("level", (budget - before) / rest)
        .withColumn("level", F.first(F.when(F.col("level") < F.col("r"), F.col("level")), ignorenulls=True).over(everything))
        .select(
            "source",
            "source_size",
            F.when(F.col("r") > F.col("level"), F.col("level") * F.col("w")).otherwise((most * F.col("source_size")).cast("double")).alias("target"),
        )
    )


def fair_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """What the mix takes of each document.

    Returns one row an input row: doc_id, source, size, source_size, target,
    first_finish (virtual finish time in the first epoch), copies (how often the
    mix takes it, 0 to ``most``) and taken (size times copies).

    Null texts have size 0. Null sources are a source of their own, the last. Ids
    may be of any type; a null id has the place of the text 'null'. Documents with
    equal ids come one after the other; equal rows are equal. An empty table gives
    an empty result; a corpus without words takes nothing.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("turn"),
    ).withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS))
    sizes = table(sizes, "mix-sizes")
    targets = source_targets(sizes, weights, share, most)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        sizes.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("ahead", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("bucket").alias("in"), "ahead", "source_size", "target")
    )
    queue = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = sizes.join(buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))).select(
        "doc_id", "source", "size", "source_size", "target", "turn", (F.col("ahead") + F.sum("size").over(queue)).alias("sent")
    )
    queued = table(queued, "mix-queue")

    def finish(epoch: int) -> Column:
        return F.when(F.col("target") > 0, (F.col("sent") + epoch * F.col("source_size")) / F.col("target"))

    def at(epoch) -> Column:
        return F.least(F.floor(finish(epoch) * (TIME_BUCKETS // 2)), F.lit(TIME_BUCKETS))

    order = lambda epoch: F.struct(finish(epoch).alias("finish"), F.coalesce("source", F.lit("\U0010ffff")).alias("source"), F.col("turn").alias("turn"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("size").alias("size"))
    offers = queued.where("size > 0").select(
        "size", F.explode(F.array(*[F.struct(at(e).alias("slot"), order(e).alias("order")) for e in range(most)])).alias("o")
    ).select("size", "o.slot", "o.order")
    # At most TIME_BUCKETS + 1 rows, and of these one row comes to the driver.
    running = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slots = offers.groupBy("slot").agg(F.sum("size").alias("words")).select(
        "slot", "words", F.sum("words").over(running).alias("until"), F.floor(F.sum("words").over(every) / most * share).alias("budget")
    )
    edge = slots.where("until > budget").orderBy("slot").select("slot", (F.col("budget") - F.col("until") + F.col("words")).alias("left")).first()
    if edge is None:  # all copies fit, or there is nothing to take
        copies = F.when(F.col("target") > 0, F.lit(most)).otherwise(F.lit(0))
    else:
        inside = offers.where(F.col("slot") == edge["slot"]).withColumn("until", F.sum("size").over(Window.partitionBy("slot").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        cut = inside.where(F.col("until") <= edge["left"]).agg(F.max("order").alias("last")).first()["last"]
        if cut is None:
            taken = lambda e: at(e) < edge["slot"]
        else:
            last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["source"]).alias("source"), F.lit(cut["turn"]).alias("turn"), F.lit(cut["id"]).alias("id"), F.lit(cut["size"]).alias("size"))
            taken = lambda e: order(e) <= last
        copies = sum((F.when(taken(e), 1).otherwise(0) for e in range(most)), F.lit(0))
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", finish(0).alias("first_finish"), copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    Documents without words weigh nothing and come once. Rows that share an id
    also share a decision: the largest number of copies of any of them. Null ids
    are one id; columns of any name stay as they are; an empty table stays empty.
    """
    own = free_prefix(docs, "__mix_")
    mixed = fair_mix(docs, **options)
    copies = mixed.groupBy("doc_id").agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("copies"))
    picked = copies.where("copies > 0").select(F.col("doc_id").alias(own + "id"), F.col("copies").alias(own + "copies"))
    id_col = options.get("id_col", "doc_id")
    joined = docs.join(picked, docs[id_col].eqNullSafe(picked[own + "id"]))
    return joined.withColumn(own + "copy", F.explode(F.sequence(F.lit(1), F.col(own + "copies")))).select(*[docs[c] for c in docs.columns])
