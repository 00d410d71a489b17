"""Error metrics, profiles and distances of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running


def r6(value: Column) -> Column:
    return F.round(value, 6)


def identity_errors(target: Column, predicted: Column) -> list[Column]:
    """n, mae, rmse, bias, median_ae and r2 of predictions taken as they are."""
    e = predicted - target
    sst = F.count(target) * F.var_pop(target)
    return [
        F.count(e).alias("n"), r6(F.avg(F.abs(e))).alias("mae"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(e)).alias("bias"),
        r6(F.median(F.abs(e))).alias("median_ae"), r6(1 - F.try_divide(F.sum(e * e), sst)).alias("r2"),
    ]


def line_fit(target: Column, predicted: Column) -> list[Column]:
    """slope, intercept and r2 of the fitted line, with the errors of the identity."""
    e = predicted - target
    return [
        F.count(e).alias("n"), r6(F.regr_slope(predicted, target)).alias("slope"), r6(F.regr_intercept(predicted, target)).alias("intercept"),
        r6(F.regr_r2(predicted, target)).alias("r2_line"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(F.abs(e))).alias("mae"), r6(F.avg(e)).alias("bias"),
    ]


def with_all(df: DataFrame, by: str, aggregates: list[Column], name: str = "all") -> DataFrame:
    """The aggregates of each group and of all rows together, which are the group ``name``."""
    out = df.rollup(by).agg(F.grouping(by).alias("__whole"), *aggregates)
    return out.withColumn(by, F.when(F.col("__whole") == 1, F.lit(name)).otherwise(F.col(by).cast("string"))).drop("__whole")


def numeric_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """One row a column: counts, mean, sd (n - 1), min, quartiles and max."""
    long = df.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "variable", "v")
    q = lambda p: r6(F.percentile("v", F.lit(p)))
    return long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("sd"),
        r6(F.min("v")).alias("least"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), r6(F.max("v")).alias("most"),
    )


def ks_distance(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """Largest distance of the two groups' empirical distribution functions.

    Values are counted first; the running counts have one row a distinct value.
    """
    counts = df.where(F.col(group).isin(a, b)).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == a).alias("a"), F.count_if(F.col(group) == b).alias("b"))
    up = running(counts, ["v"], {"up_a": F.col("a"), "up_b": F.col("b")}, "ks")
    n = up.agg(F.max("up_a").alias("a"), F.max("up_b").alias("b")).first()
    share = lambda c, k: F.try_divide(F.col(c), F.lit(k).cast("double"))
    return up.agg(r6(F.max(F.abs(share("up_a", n["a"]) - share("up_b", n["b"])))).alias("ks"))


def quantile_distance(df: DataFrame, value: str, group: str, a: str, b: str, points: int = 1001) -> DataFrame:
    """Mean absolute difference of the two groups' quantiles at evenly spaced points."""
    at = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    q = df.agg(F.percentile(F.when(F.col(group) == a, F.col(value)), at).alias("a"), F.percentile(F.when(F.col(group) == b, F.col(value)), at).alias("b"))
    gaps = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    return q.select(r6(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / points).alias("distance"))
