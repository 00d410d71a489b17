"""The corpus pipeline: five stages, each on what the one before it kept.

``run`` writes each stage's rows as Parquet and hands the next stage what it reads
back. All stages but the last return the columns of ``documents``; the last
returns the digest of the token store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm import common, decontamination, mixing, simhash, store, toxicity

#: Documents at this score or above go.
TOXIC_SCORE = 0.3


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity grammar rejects; it learns from the labels of ``docs``.

    Rows are judged one by one, so repeated rows and rows of null or equal ids
    have their own verdicts; null and empty texts have no pattern and stay.
    Columns of any name stay as they are; an empty table stays empty.
    """
    own = common.free_prefix(docs, "__civil_")
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, score_col=own + "score", patterns_col=own + "patterns")
    return scored.where(F.col(own + "score") < TOXIC_SCORE).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group: that with the smallest id.

    Null ids come last; ties and repeated rows leave one. Documents without words
    are one group. Columns of any name stay; an empty table stays empty.
    """
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of the benchmark, and without documents that are mostly such passages.

    Null and empty texts stay, as do repeated rows and columns of any name; null
    items hit nothing; empty tables stay empty.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as weighted fair queueing takes it.

    Documents without words come once; a null source is a source of its own; rows
    of equal ids share a decision. Columns of any name stay; an empty table stays
    empty.
    """
    return mixing.mix_documents(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the content-addressed store of all token ids.

    Null texts are empty and have the end id alone; equal ids and repeated rows
    are documents of their own; an empty table gives no rows.
    """
    import public_tokenizers

    return store.store_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", keep_civil),
    ("near duplicates", keep_distinct),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
    ("token store", token_store),
]

#: Learned weights, chained links and token ids are beyond SQL; tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents under ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
