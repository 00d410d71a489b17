"""Windowed counts and latest states; the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """Count and sum of each event type an hour; ``late`` is the watermark on a stream."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark("at", late)
    grouped = rows.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Session windows of each user."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark("at", late)
    grouped = rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "user_id", "n")


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Keep the latest row of each key under ``path``: each micro-batch writes a new version.

    A repeated batch writes the same version again, so a restart loses and doubles
    nothing. Readers take the version with the largest number.
    """
    from ..operators.selection import top_n

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, own = batch.sparkSession, f"{path}/version={epoch:012d}"
        if epoch:
            batch = batch.unionByName(spark.read.parquet(f"{path}/version={epoch - 1:012d}"))
        top_n(batch, keys, [F.desc(order)], 1).drop("rank").write.mode("overwrite").parquet(own)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Count and sum of each event type in overlapping windows, one each ``step``."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark("at", late)
    grouped = rows.groupBy(F.window("at", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
