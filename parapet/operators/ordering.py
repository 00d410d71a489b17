"""Global ranks and running sums without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import table


def running(df: DataFrame, order: list[str], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """``df`` with running sums over all rows in ``order``, each row's own value included.

    Rows are parted by ranges of ``order`` and written once; a part's sums are
    added up for the parts after it (one row a part), then each part is numbered
    for itself. Rows that are equal in ``order`` come in an order of their own, so
    give a unique one.
    """
    own = {f"__{k}": v for k, v in sums.items()}
    parts = table(df.withColumns(own).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    ahead = parts.groupBy("__part").agg(*[F.sum(c).alias(c) for c in own])
    ahead = ahead.select(F.col("__part").alias("__in"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead") for c in own])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(F.broadcast(ahead), F.col("__part") == F.col("__in"))
    return joined.select(*df.columns, *[(F.sum(f"__{k}").over(inside) + F.col(f"__{k}_ahead")).alias(k) for k in sums])


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1."""
    return running(df, order, {name: F.lit(1).cast("long")}, "numbered")
