"""Aggregations, profiles and error metrics on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..operators import metrics, spatial
from ..operators.metrics import r6
from .filters import BIN_SQL
from .registry import query

N = "CAST(count(*) AS BIGINT)"


@query("group_count_nullable", "scenes", sql=f"SELECT shadow, {N} AS n FROM scenes GROUP BY shadow")
def group_count_nullable(scenes):
    return scenes.groupBy("shadow").agg(F.count(F.lit(1)).alias("n"))


@query("count_distinct_by_group", "scenes", sql="SELECT kind, CAST(count(DISTINCT city) AS BIGINT) AS cities, CAST(count(DISTINCT year) AS BIGINT) AS years FROM scenes GROUP BY kind")
def count_distinct_by_group(scenes):
    return scenes.groupBy("kind").agg(F.count_distinct("city").alias("cities"), F.count_distinct("year").alias("years"))


@query("numeric_profile", "scenes", sql="""
, l AS (SELECT 'sun' AS variable, sun AS v FROM scenes UNION ALL SELECT 'shadow', shadow FROM scenes UNION ALL SELECT 'coverage', coverage FROM scenes)
SELECT variable, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(v) AS BIGINT) AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least,
  round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS most FROM l GROUP BY variable""")
def numeric_profile(scenes):
    return metrics.numeric_profile(scenes, ["sun", "shadow", "coverage"])


@query("categorical_profile", "scenes", sql="""
, l AS (SELECT 'kind' AS variable, kind AS value FROM scenes UNION ALL SELECT 'shadow', coalesce(CAST(CAST(shadow AS INT) AS VARCHAR), '<missing>') FROM scenes)
SELECT variable, value, CAST(count(*) AS BIGINT) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY variable), 6) AS percent FROM l GROUP BY variable, value""")
def categorical_profile(scenes):
    from pyspark.sql import Window

    text = scenes.select("kind", F.coalesce(F.col("shadow").cast("int").cast("string"), F.lit("<missing>")).alias("shadow"))
    counts = text.unpivot([], ["kind", "shadow"], "variable", "value").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", r6(100 * F.col("n") / F.sum("n").over(Window.partitionBy("variable"))))


@query("quantile_summary", "heights", sql="""
SELECT city, CAST(count(p95) AS BIGINT) AS n, round(quantile_cont(p95, 0.01), 6) AS p01, round(quantile_cont(p95, 0.5), 6) AS p50, round(quantile_cont(p95, 0.99), 6) AS p99, round(stddev_samp(p95), 6) AS sd FROM heights GROUP BY city""")
def quantile_summary(heights):
    q = lambda p: r6(F.percentile("p95", F.lit(p)))
    return heights.groupBy("city").agg(F.count("p95").alias("n"), q(0.01).alias("p01"), q(0.5).alias("p50"), q(0.99).alias("p99"), r6(F.stddev_samp("p95")).alias("sd"))


@query("cleaning_audit", "heights", sql=f"SELECT city, {N} AS total, CAST(count(*) - count(official) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE official <= 0) AS BIGINT) AS nonpositive, CAST(count(*) FILTER (WHERE official > 0) AS BIGINT) AS positive FROM heights GROUP BY city")
def cleaning_audit(heights):
    v = F.col("official")
    return heights.groupBy("city").agg(F.count(F.lit(1)).alias("total"), F.count_if(v.isNull()).alias("missing"), F.count_if(v <= 0).alias("nonpositive"), F.count_if(v > 0).alias("positive"))


IDENTITY_SQL = """CAST(count(e) AS BIGINT) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(median(abs(e)), 6) AS median_ae,
  round(1 - sum(e * e) / nullif(count(t) * var_pop(t), 0), 6) AS r2"""


@query("error_metrics_identity_r2", "heights", sql=f"""
, l AS (SELECT city, variable, v - official AS e, official AS t FROM (UNPIVOT heights ON p90, p95, top INTO NAME variable VALUE v)) SELECT city, variable, {IDENTITY_SQL} FROM l GROUP BY ALL""")
def error_metrics_identity_r2(heights):
    long = heights.unpivot(["city", "official"], ["p90", "p95", "top"], "variable", "v")
    return long.groupBy("city", "variable").agg(*metrics.identity_errors(F.col("official"), F.col("v")))


LINE_SQL = """CAST(count(e) AS BIGINT) AS n, round(regr_slope(p, t), 6) AS slope, round(regr_intercept(p, t), 6) AS intercept, round(regr_r2(p, t), 6) AS r2_line,
  round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias"""
ROWS_SQL = ", l AS (SELECT *, predicted AS p, target AS t, predicted - target AS e FROM buildings_eval)"


@query("regression_metrics_ols", "buildings_eval", sql=f"{ROWS_SQL} SELECT city, status, {LINE_SQL} FROM l GROUP BY ALL")
def regression_metrics_ols(rows):
    return rows.groupBy("city", "status").agg(*metrics.line_fit(F.col("target"), F.col("predicted")))


@query("grouping_sets_all_city", "buildings_eval", sql=f"{ROWS_SQL} SELECT CASE WHEN grouping(city) = 1 THEN 'all' ELSE city END AS city, {LINE_SQL} FROM l GROUP BY GROUPING SETS ((city), ())")
def grouping_sets_all_city(rows):
    return metrics.with_all(rows, "city", metrics.line_fit(F.col("target"), F.col("predicted")))


@query("height_bin_error", "buildings_eval", sql=f"{ROWS_SQL} SELECT {BIN_SQL.format(v='t')} AS bin, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(e, 0.25), 6) AS p25, round(quantile_cont(e, 0.75), 6) AS p75 FROM l GROUP BY 1")
def height_bin_error(rows):
    e = F.col("predicted") - F.col("target")
    return rows.groupBy(scalars.height_bin(F.col("target")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.percentile(e, F.lit(0.25))).alias("p25"), r6(F.percentile(e, F.lit(0.75))).alias("p75"))


@query("rmse_by_bin_run", "heights", sql=f"SELECT city, run, {BIN_SQL.format(v='official')} AS bin, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((p95 - official) * (p95 - official))), 6) AS rmse FROM heights GROUP BY ALL")
def rmse_by_bin_run(heights):
    e = F.col("p95") - F.col("official")
    return heights.groupBy("city", "run", scalars.height_bin(F.col("official")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(e * e))).alias("rmse"))


@query("rollup_total_row", "cities", sql=f"SELECT CASE WHEN grouping(country) = 1 THEN 'TOTAL' ELSE country END AS country, {N} AS n FROM cities GROUP BY ROLLUP (country)")
def rollup_total_row(cities):
    return metrics.with_all(cities, "country", [F.count(F.lit(1)).alias("n")], "TOTAL")


@query("macro_average_rmse", "buildings_eval", sql=f"{ROWS_SQL}, c AS (SELECT status, city, sqrt(avg(e * e)) AS rmse FROM l GROUP BY ALL) SELECT status, round(avg(rmse), 6) AS rmse FROM c GROUP BY status")
def macro_average_rmse(rows):
    e = F.col("predicted") - F.col("target")
    return rows.groupBy("status", "city").agg(F.sqrt(F.avg(e * e)).alias("rmse")).groupBy("status").agg(r6(F.avg("rmse")).alias("rmse"))


@query("cv_two_stage", "buildings_eval", sql=f"{ROWS_SQL}, f AS (SELECT part, chip % 5 AS fold, avg(e) AS m, median(e) AS d FROM l GROUP BY ALL) SELECT part, round(avg(m), 6) AS mean, round(median(d), 6) AS median FROM f GROUP BY part")
def cv_two_stage(rows):
    e = F.col("predicted") - F.col("target")
    folds = rows.groupBy("part", (F.col("chip") % 5).alias("fold")).agg(F.avg(e).alias("m"), F.median(e).alias("d"))
    return folds.groupBy("part").agg(r6(F.avg("m")).alias("mean"), r6(F.median("d")).alias("median"))


@query("epoch_city_summary", "buildings_eval", sql="""
SELECT part, city, CAST(count(DISTINCT chip) AS BIGINT) AS chips, round(avg(CASE WHEN predicted < 5 THEN 1.0 ELSE 0 END), 6) AS collapsed, round(median(predicted), 6) AS median FROM buildings_eval GROUP BY ALL""")
def epoch_city_summary(rows):
    return rows.groupBy("part", "city").agg(F.count_distinct("chip").alias("chips"), r6(F.avg(F.when(F.col("predicted") < 5, 1.0).otherwise(0.0))).alias("collapsed"), r6(F.median("predicted")).alias("median"))


@query("epoch_loss", "manifest", sql=f"SELECT year(placed) AS epoch, {N} AS n, round(avg(cost), 4) AS mean, min(cost) AS least, max(cost) AS most FROM manifest GROUP BY 1")
def epoch_loss(manifest):
    return manifest.groupBy(F.year("placed").cast("bigint").alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cost"), 4).alias("mean"), F.min("cost").alias("least"), F.max("cost").alias("most"))


@query("collapse_check", "pixels", sql="""
, s AS (SELECT chip, city, stddev_pop(v) AS sd FROM pixels GROUP BY ALL)
SELECT city, round(avg(CAST(sd < 0.9 AS INT)), 6) AS share, round(min(sd), 6) AS least, round(avg(sd), 6) AS mean, avg(CAST(sd < 0.9 AS INT)) > 0.5 AS triggered FROM s GROUP BY city""")
def collapse_check(pixels):
    s = pixels.groupBy("chip", "city").agg(F.stddev_pop("v").alias("sd"))
    share = F.avg((F.col("sd") < 0.9).cast("int"))
    return s.groupBy("city").agg(r6(share).alias("share"), r6(F.min("sd")).alias("least"), r6(F.avg("sd")).alias("mean"), (share > 0.5).alias("triggered"))


@query("channel_moments", "pixels", sql="SELECT c AS band, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END, 6) AS sd FROM pixels WHERE chip % 10 < 7 GROUP BY c")
def channel_moments(pixels):
    sd = F.stddev_pop("v")
    return pixels.where("chip % 10 < 7").groupBy(F.col("c").alias("band")).agg(r6(F.avg("v")).alias("mean"), r6(F.when(sd > 0, sd).otherwise(1.0)).alias("sd"))


@query("weighted_mean", "buildings", sql="SELECT brand, round(sum(price * size) FILTER (WHERE id % 7 <> 0) / nullif(sum(size) FILTER (WHERE id % 7 <> 0), 0), 6) AS mean FROM buildings GROUP BY brand")
def weighted_mean(buildings):
    on = F.col("id") % 7 != 0
    w = F.sum(F.when(on, F.col("size")))
    return buildings.groupBy("brand").agg(r6(F.when(w > 0, F.try_divide(F.sum(F.when(on, F.col("price") * F.col("size"))), w))).alias("mean"))


@query("component_summary", "buildings", sql="""
, e AS (SELECT a.id AS x, b.id AS y FROM buildings a JOIN buildings b ON a.id < b.id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax AND abs(a.size - b.size) <= 25
    AND CASE WHEN a.xmax = b.xmin OR b.xmax = a.xmin THEN least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) WHEN a.ymax = b.ymin OR b.ymax = a.ymin THEN least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) ELSE 0 END
      >= greatest(1, 0.05 * least(2 * (a.xmax - a.xmin + a.ymax - a.ymin), 2 * (b.xmax - b.xmin + b.ymax - b.ymin)))),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
w AS (WITH RECURSIVE w AS (SELECT id AS node, id AS root FROM buildings UNION SELECT u.y, w.root FROM w JOIN u ON w.node = u.x WHERE w.root < u.y) SELECT node AS id, min(root) AS root FROM w GROUP BY node),
m AS (SELECT *, (xmax - xmin) * (ymax - ymin) AS area FROM buildings JOIN w USING (id)),
c AS (SELECT root, CAST(count(DISTINCT (r, c)) AS DOUBLE) AS merged FROM (SELECT root, c, unnest(range(CAST(ymin AS BIGINT), CAST(ymax AS BIGINT))) AS r FROM (SELECT *, unnest(range(CAST(xmin AS BIGINT), CAST(xmax AS BIGINT))) AS c FROM m)) GROUP BY root),
g AS (SELECT root, CAST(count(*) AS BIGINT) AS polygons, sum(area) AS area, any_value(merged) AS merged, array_to_string(list_sort(list(CAST(id AS VARCHAR))), '|') AS ids,
    round(avg(size), 6) AS mean, round(median(size), 6) AS median, min(size) AS least, max(size) AS most, round(sum(size * area) / sum(area), 6) AS weighted,
    round(avg(price), 6) AS price_mean, round(sum(price * area) / sum(area), 6) AS price_weighted FROM m JOIN c USING (root) GROUP BY root)
SELECT root, polygons, area, merged, round(merged / area, 6) AS ratio, ids, mean, median, least, most, weighted, price_mean, price_weighted,
  array_to_string(list_filter([CASE WHEN polygons > 3 THEN 'large_component' END, CASE WHEN merged / area < 0.98 OR merged / area > 1.02 THEN 'area_changed_more_than_2pct' END], lambda x: x IS NOT NULL), ';') AS flags FROM g""")
def component_summary(buildings):
    """Footprints that share enough of a boundary, and are about as high, merge; one row a merged footprint."""
    pairs = spatial.touching_pairs(buildings, carry=("size",))
    around = lambda p: 2 * (F.col(p + "xmax") - F.col(p + "xmin") + F.col(p + "ymax") - F.col(p + "ymin"))
    shared = geo.shared_boundary("a_", "b_")
    merge = (F.abs(F.col("a_size") - F.col("b_size")) <= 25) & (shared >= F.greatest(F.lit(1.0), 0.05 * F.least(around("a_"), around("b_"))))
    roots = spatial.components(pairs.where(merge).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    members = buildings.join(roots, F.col("id") == F.col("node"), "left").withColumns({"root": F.coalesce("root", "id"), "area": area})
    merged = spatial.covered_area(members, ["root"]).select("root", F.col("area").cast("double").alias("merged"))
    weighted = lambda c: F.round(F.try_divide(F.sum(F.col(c) * F.col("area")), F.sum("area")), 6)
    out = members.groupBy("root").agg(
        F.count(F.lit(1)).alias("polygons"), F.sum("area").alias("area"), F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "|").alias("ids"),
        r6(F.avg("size")).alias("mean"), r6(F.median("size")).alias("median"), F.min("size").alias("least"), F.max("size").alias("most"), weighted("size").alias("weighted"),
        r6(F.avg("price")).alias("price_mean"), weighted("price").alias("price_weighted"),
    ).join(merged, "root")
    ratio = F.try_divide("merged", "area")
    flags = scalars.reasons((F.col("polygons") > 3, "large_component"), ((ratio < 0.98) | (ratio > 1.02), "area_changed_more_than_2pct"))
    return out.withColumns({"ratio": r6(ratio), "flags": flags})


@query("capture_window", "manifest", sql="""
SELECT city, min(placed) AS first, max(placed) AS last, make_timestamp((epoch_us(min(placed)) + epoch_us(max(placed))) // 2) AS middle, array_to_string(list_sort(list_distinct(list(state))), ';') AS states FROM manifest GROUP BY city""")
def capture_window(manifest):
    us = lambda t: F.unix_micros(t.cast("timestamp"))
    lo, hi = F.min("placed"), F.max("placed")
    middle = F.timestamp_micros(F.expr("(unix_micros(cast(min(placed) as timestamp)) + unix_micros(cast(max(placed) as timestamp))) div 2")).cast("timestamp_ntz")
    return manifest.groupBy("city").agg(lo.alias("first"), hi.alias("last"), middle.alias("middle"), F.array_join(F.array_sort(F.collect_set("state")), ";").alias("states"))


@query("interval_summary", "manifest", sql="SELECT city, array_to_string(list_sort(list_distinct(list(year(placed)))), ';') AS years, CAST(min(year(placed)) AS INT) AS first, CAST(max(year(placed)) AS INT) AS last FROM manifest GROUP BY city")
def interval_summary(manifest):
    y = F.year("placed")
    return manifest.groupBy("city").agg(F.array_join(F.array_sort(F.collect_set(y)).cast("array<string>"), ";").alias("years"), F.min(y).alias("first"), F.max(y).alias("last"))


@query("conditional_counts", "scenes", sql="SELECT city, CAST(count(*) FILTER (WHERE kind = 'click') AS BIGINT) AS clicks, CAST(count(*) FILTER (WHERE kind = 'error') AS BIGINT) AS errors FROM scenes GROUP BY city")
def conditional_counts(scenes):
    return scenes.groupBy("city").agg(F.count_if(F.col("kind") == "click").alias("clicks"), F.count_if(F.col("kind") == "error").alias("errors"))


@query("monthly_profile", "manifest", sql="SELECT strftime(placed, '%B') AS month, year(placed) AS y, CAST(count(*) AS BIGINT) AS n, round(avg(cost), 4) AS mean FROM manifest GROUP BY ALL")
def monthly_profile(manifest):
    return manifest.groupBy(F.date_format("placed", "MMMM").alias("month"), F.year("placed").cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cost"), 4).alias("mean"))


@query("histogram_shares", "buildings_eval", sql=f", h AS (SELECT city, {BIN_SQL.format(v='target')} AS bin, count(*) AS n FROM buildings_eval GROUP BY 1, 2) SELECT city, bin, round(n / sum(n) OVER (PARTITION BY city), 6) AS share FROM h")
def histogram_shares(rows):
    from pyspark.sql import Window

    counts = rows.groupBy("city", scalars.height_bin(F.col("target")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("city", "bin", r6(F.col("n") / F.sum("n").over(Window.partitionBy("city"))).alias("share"))


@query("spatial_block_rollup", "chips", sql="SELECT CAST(floor(row_off / 1024) AS BIGINT) AS r, CAST(floor(col_off / 1024) AS BIGINT) AS c, CAST(count(*) AS BIGINT) AS n, round(median(worth), 4) AS median, round(sum(ln(1 + worth)), 4) AS logs, bool_or(city = '1-URGENT') AS urgent FROM chips GROUP BY ALL")
def spatial_block_rollup(chips):
    return chips.groupBy(F.floor(F.col("row_off") / 1024).alias("r"), F.floor(F.col("col_off") / 1024).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median("worth"), 4).alias("median"), F.round(F.sum(F.log1p("worth")), 4).alias("logs"), F.bool_or(F.col("city") == "1-URGENT").alias("urgent")
    )


@query("split_distribution", "buildings_eval", sql="""
SELECT CASE WHEN grouping(city) = 1 THEN 'all' ELSE city END AS city, CAST(count(*) AS BIGINT) AS n, round(stddev_pop(target), 6) AS sd, round(quantile_cont(target, 0.9), 6) AS p90, round(max(target), 6) AS most FROM buildings_eval WHERE target >= 0 GROUP BY ROLLUP (city)""")
def split_distribution(rows):
    return metrics.with_all(rows.where("target >= 0"), "city", [F.count(F.lit(1)).alias("n"), r6(F.stddev_pop("target")).alias("sd"), r6(F.percentile("target", F.lit(0.9))).alias("p90"), r6(F.max("target")).alias("most")])


@query("boxplot_stats", "buildings_eval", sql=f"""
{ROWS_SQL}, b AS (SELECT {BIN_SQL.format(v='t')} AS bin, e FROM l), q AS (SELECT bin, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.75) AS q3 FROM b GROUP BY bin)
SELECT bin, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(min(e) FILTER (WHERE e >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(e) FILTER (WHERE e <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM b JOIN q USING (bin) GROUP BY bin""")
def boxplot_stats(rows):
    b = rows.select(scalars.height_bin(F.col("target")).alias("bin"), (F.col("predicted") - F.col("target")).alias("e"))
    q = b.groupBy("bin").agg(F.percentile("e", F.lit(0.25)).alias("q1"), F.percentile("e", F.lit(0.75)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    e = F.col("e")
    return b.join(q, "bin").groupBy("bin").agg(r6(F.first("q1")).alias("q1"), r6(F.first("q3")).alias("q3"), r6(F.min(F.when(e >= F.col("q1") - reach, e))).alias("low"), r6(F.max(F.when(e <= F.col("q3") + reach, e))).alias("high"))


@query("train_counts", "chips", "manifest", sql="SELECT city, CAST(count(*) AS BIGINT) AS n FROM chips WHERE chip IN (SELECT id FROM manifest WHERE id % 10 < 7) GROUP BY city")
def train_counts(chips, manifest):
    train = manifest.where("id % 10 < 7").select(F.col("id").alias("chip"))
    return chips.join(train, "chip", "left_semi").groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query("pooled_percentile", "buildings_eval", sql="SELECT round(greatest(10, quantile_cont(v, 0.99)), 6) AS axis_limit FROM (SELECT target AS v FROM buildings_eval UNION ALL SELECT predicted FROM buildings_eval)")
def pooled_percentile(rows):
    pooled = rows.select(F.col("target").alias("v")).union(rows.select("predicted"))
    return pooled.agg(r6(F.greatest(F.lit(10.0), F.percentile("v", F.lit(0.99)))).alias("axis_limit"))


@query("merge_summary", "buildings", sql="""
, m AS (SELECT brand, size, count(*) AS n FROM buildings GROUP BY ALL)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM buildings) AS before, CAST(count(*) AS BIGINT) AS after, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS merged, CAST(max(n) AS BIGINT) AS largest FROM m""")
def merge_summary(buildings):
    m = buildings.groupBy("brand", "size").agg(F.count(F.lit(1)).alias("n"))
    return m.agg(F.sum("n").alias("before"), F.count(F.lit(1)).alias("after"), F.count_if(F.col("n") > 1).alias("merged"), F.max("n").alias("largest"))


@query("mask_group_error", "pixels", sql="""
, g AS (SELECT v, 10 * abs(v) - v AS e, unnest(list_filter(['all', CASE WHEN mask THEN 'positive' ELSE 'background' END, CASE WHEN c < 4 THEN 'footprint' END], lambda x: x IS NOT NULL)) AS part FROM pixels)
SELECT part, CAST(count(*) AS BIGINT) AS n, round(sum(abs(e)), 3) AS absolute FROM g GROUP BY part""")
def mask_group_error(pixels):
    parts = F.array_compact(F.array(F.lit("all"), F.when(F.col("mask"), "positive").otherwise("background"), F.when(F.col("c") < 4, "footprint")))
    rows = pixels.select((10 * F.abs("v") - F.col("v")).alias("e"), F.explode(parts).alias("part"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("e")), 3).alias("absolute"))


@query("component_reduce", "buildings_eval", sql="SELECT chip, city, CAST(count(*) AS BIGINT) AS n, round(avg(target), 6) AS target, round(median(predicted), 6) AS predicted FROM buildings_eval GROUP BY chip, city HAVING count(*) >= 3")
def component_reduce(rows):
    return rows.groupBy("chip", "city").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("target")).alias("target"), r6(F.median("predicted")).alias("predicted")).where("n >= 3")


@query("collect_metrics_union", "buildings_eval", sql=f"{ROWS_SQL} SELECT 'all' AS split, {IDENTITY_SQL} FROM l UNION ALL SELECT 'open', {IDENTITY_SQL} FROM l WHERE status = 'O'")
def collect_metrics_union(rows):
    m = metrics.identity_errors(F.col("target"), F.col("predicted"))
    return rows.agg(*m).withColumn("split", F.lit("all")).unionByName(rows.where("status = 'O'").agg(*m).withColumn("split", F.lit("open")))
