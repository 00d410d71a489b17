"""The registered queries: a name, a Spark plan, and the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a plan that takes the named views (or tables) as DataFrames.

    ``sql`` sees the same views; further common table expressions start it with a comma.
    """

    def add(plan):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(*[view(spark, sf_dir, v) for v in views])
        if sql:
            made = [v for v in views if v in VIEWS or v == "pixels"]
            rest = sql.strip()
            if made:
                ORACLES[name] = with_views(*made) + rest
            else:
                ORACLES[name] = "WITH " + rest.lstrip(",") if rest.startswith(",") else rest
        return plan

    return add


def raw(name: str, sql: str | None = None):
    """Register a plan that takes the session and the folder."""

    def add(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return add
