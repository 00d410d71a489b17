"""A session with the defaults that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "parapet", **conf: str) -> SparkSession:
    """UTC, ANSI casts, adaptive execution with skew handling; ``conf`` adds or overrides."""
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.appName(app).config(map=fixed | conf).getOrCreate()
