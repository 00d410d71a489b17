"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests, a laptop) a folder under the
    warehouse is taken instead, and set for later calls; on a cluster it raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[[^,\]]*(,\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_to(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back, so that its size is known to the next plan."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: what follows neither repeats the work nor depends on
    an executor that may be lost.
    """
    return write_to(df, new_path(df.sparkSession, name))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder through Hadoop's own file system API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a task takes before each becomes many.
SPREAD_ROWS = 20_000


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """The same rows dealt over tasks of about ``rows`` each, for steps that make many rows of one.

    A small file is read by one task, which would then hold all that its rows
    become. The rows are counted first, so the tasks grow with the input; few
    rows stay as they are.
    """
    n = -(-df.count() // rows)
    return df.repartition(n) if n > 1 else df


class Scratch:
    """Intermediate tables of one computation, each dropped when nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def table(self, df: DataFrame) -> DataFrame:
        self.paths.append(new_path(self.spark, self.name))
        return write_to(df, self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        """Drop all tables but the last ``keep``."""
        while len(self.paths) > keep:
            drop_table(self.spark, self.paths.pop(0))
