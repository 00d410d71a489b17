"""Joins, set operations and deduplication on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, selection
from ..operators import scenes as rules
from .registry import query


@query("left_join_many_to_one", "scenes", "cities", sql="SELECT scene_id, city, slug, country FROM scenes LEFT JOIN cities USING (city)")
def left_join_many_to_one(scenes, cities):
    return guards.many_to_one(scenes, cities, ["city"]).select("scene_id", "city", "slug", "country")


@query("left_join_one_to_one", "manifest", sql="SELECT m.id, m.cost, a.n FROM manifest m LEFT JOIN (SELECT id, id % 5 AS n FROM manifest WHERE state = 'F') a USING (id)")
def left_join_one_to_one(manifest):
    assets = manifest.where("state = 'F'").select("id", (F.col("id") % 5).alias("n"))
    return guards.many_to_one(manifest, assets, ["id"]).select("id", "cost", "n")


@query("inner_join_ready_training", "scenes", "cities", sql="""
SELECT slug, country, n FROM cities JOIN (SELECT city, CAST(count(*) AS BIGINT) AS n FROM scenes WHERE standard GROUP BY city HAVING count(*) >= 50) USING (city)""")
def inner_join_ready_training(scenes, cities):
    ready = scenes.where("standard").groupBy("city").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    return cities.join(ready, "city").select("slug", "country", "n")


@query("country_full_outer", "cities", "supplier", "nation", sql="""
, s AS (SELECT n_name AS country, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY 1),
c AS (SELECT country, count(*) AS cities FROM cities WHERE population > 9000 GROUP BY 1)
SELECT country, CAST(coalesce(cities, 0) AS BIGINT) AS cities, CAST(coalesce(suppliers, 0) AS BIGINT) AS suppliers FROM c FULL JOIN s USING (country)""")
def country_full_outer(cities, supplier, nation):
    s = supplier.where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = cities.where("population > 9000").groupBy("country").agg(F.count(F.lit(1)).alias("cities"))
    return c.join(s, "country", "full").select("country", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("cities", "suppliers")])


@query("country_summary", "cities", sql="""
SELECT country, CAST(count(*) AS BIGINT) AS cities, CAST(count(*) FILTER (WHERE population > 5000) AS BIGINT) AS large,
  CAST(count(*) - count(*) FILTER (WHERE population > 5000) AS BIGINT) AS small, round(avg(population), 4) AS mean, round(count(*) FILTER (WHERE population > 5000) / count(*), 6) AS share
FROM cities GROUP BY country""")
def country_summary(cities):
    large = F.count_if(F.col("population") > 5000)
    n = F.count(F.lit(1))
    return cities.groupBy("country").agg(n.alias("cities"), large.alias("large"), (n - large).alias("small"), F.round(F.avg("population"), 4).alias("mean"), F.round(F.try_divide(large, n), 6).alias("share"))


@query("semi_join", "scenes", "cities", sql="SELECT scene_id, city FROM scenes WHERE city IN (SELECT city FROM cities WHERE segment = 'MACHINERY')")
def semi_join(scenes, cities):
    return scenes.join(cities.where("segment = 'MACHINERY'"), "city", "left_semi").select("scene_id", "city")


@query("anti_join", "scenes", "cities", sql="SELECT scene_id, city FROM scenes WHERE city NOT IN (SELECT city FROM cities WHERE segment = 'MACHINERY')")
def anti_join(scenes, cities):
    return scenes.join(cities.where("segment = 'MACHINERY'"), "city", "left_anti").select("scene_id", "city")


@query("coalesce_join_priority", "cities", "supplier", sql="""
SELECT c.slug, coalesce(a.v, b.v, 'default') AS value, CASE WHEN a.v IS NOT NULL THEN 'audit' WHEN b.v IS NOT NULL THEN 'registry' ELSE 'default' END AS origin FROM cities c
LEFT JOIN (SELECT s_suppkey AS city, s_name AS v FROM supplier WHERE s_acctbal > 5000) a USING (city) LEFT JOIN (SELECT s_suppkey * 2 AS city, s_name AS v FROM supplier) b USING (city)""")
def coalesce_join_priority(cities, supplier):
    tagged = lambda df, key, tag: df.select(key.alias("city"), F.struct(F.col("s_name").alias("value"), F.lit(tag).alias("origin")).alias(tag))
    a = tagged(supplier.where("s_acctbal > 5000"), F.col("s_suppkey"), "audit")
    b = tagged(supplier, F.col("s_suppkey") * 2, "registry")
    best = F.coalesce("audit", "registry", F.struct(F.lit("default").alias("value"), F.lit("default").alias("origin")))
    return cities.join(a, "city", "left").join(b, "city", "left").select("slug", best.alias("b")).select("slug", "b.value", "b.origin")


@query("manifest_upsert", "manifest", sql="""
, held AS (SELECT id, state, cost FROM manifest WHERE id % 3 = 0), plan AS (SELECT id, bundle, cost + 100 AS cost FROM manifest WHERE id % 2 = 0)
SELECT id, bundle, p.cost AS cost, coalesce(h.state, 'new') AS state, coalesce(h.state = 'F' AND h.cost <> p.cost, false) AS conflict FROM plan p LEFT JOIN held h USING (id)""")
def manifest_upsert(manifest):
    held = manifest.where("id % 3 = 0").select("id", "state", F.col("cost").alias("was"))
    plan = manifest.where("id % 2 = 0").select("id", "bundle", (F.col("cost") + 100).alias("cost"))
    conflict = F.coalesce((F.col("state") == "F") & (F.col("was") != F.col("cost")), F.lit(False))
    return plan.join(held, "id", "left").select("id", "bundle", "cost", F.coalesce("state", F.lit("new")).alias("state"), conflict.alias("conflict"))


@query("asof_fallback", "scenes", "surveys", sql="""
, c AS (SELECT s.city, CASE WHEN month IN (12, 1) THEN 'winter_jan_dec' ELSE 'summer_jun_jul' END AS season, scene_id, acquired, survey_start, survey_end, coalesce(shadow, 0) + coalesce(haze, 0) AS penalty, cloud, clear, sun
  FROM scenes s JOIN surveys USING (city) WHERE month IN (6, 7, 12, 1) AND cloud = 0 AND coverage = 100 AND standard),
k AS (SELECT *, CASE WHEN acquired BETWEEN survey_start AND survey_end THEN 'inside' WHEN acquired >= survey_end THEN 'after' ELSE 'before' END AS relation FROM c),
d AS (SELECT *, CASE relation WHEN 'inside' THEN CAST(floor(abs((acquired - survey_start) - (survey_end - survey_start) / 2)) AS BIGINT) WHEN 'after' THEN acquired - survey_end ELSE survey_start - acquired END AS days_off FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY city, season ORDER BY list_position(['inside', 'after', 'before'], relation), days_off, penalty, cloud, coalesce(clear, -1) DESC, coalesce(sun, -999) DESC, scene_id) AS n FROM d)
SELECT city, season, scene_id, relation, CAST(days_off AS BIGINT) AS days_off FROM r WHERE n = 1""")
def asof_fallback(scenes, surveys):
    """For each city and season the clean scene inside the survey's window, else after, else before it."""
    return rules.nearest_to_survey(scenes.withColumn("penalty", rules.penalty("shadow", "haze")), surveys.select("city", "survey_start", "survey_end"))


@query("override_join", "cities", sql="SELECT slug, CASE city WHEN 7 THEN 'fixed-a' WHEN 11 THEN 'fixed-b' ELSE segment END AS choice FROM cities")
def override_join(cities):
    fixed = cities.sparkSession.createDataFrame([(7, "fixed-a"), (11, "fixed-b")], "city long, fixed string")
    return cities.join(F.broadcast(fixed), "city", "left").select("slug", F.coalesce("fixed", "segment").alias("choice"))


@query("alias_match_join", "nation", "supplier", sql="""
, g AS (SELECT s_suppkey, unnest(['zone_' || s_nationkey, 'nation_' || s_nationkey, 'nation_0']) AS alias, unnest([0, 1, 2]) AS pos FROM supplier)
SELECT s_suppkey, arg_min(n_name, pos) AS country FROM g JOIN nation ON lower(n_name) = alias GROUP BY s_suppkey""")
def alias_match_join(nation, supplier):
    names = F.array(F.concat(F.lit("zone_"), "s_nationkey"), F.concat(F.lit("nation_"), "s_nationkey"), F.lit("nation_0"))
    tries = supplier.select("s_suppkey", F.posexplode(names).alias("pos", "alias"))
    return tries.join(nation, F.lower("n_name") == F.col("alias")).groupBy("s_suppkey").agg(F.min_by("n_name", "pos").alias("country"))


@query("prefer_flagged_else_all", "scenes", sql="SELECT city, scene_id FROM (SELECT *, max(CAST(kind = 'purchase' AND year = 2020 AS INT)) OVER (PARTITION BY city) AS any_latest FROM scenes) WHERE any_latest = 0 OR (kind = 'purchase' AND year = 2020)")
def prefer_flagged_else_all(scenes):
    latest = (F.col("kind") == "purchase") & (F.col("year") == 2020)
    return selection.fallback_pool(scenes, ["city"], latest).select("city", "scene_id")


@query("regex_key_join", "pages", sql="SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host FROM pages WHERE regexp_extract(url, '^https?://([^/]+)/', 1) IN (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) FROM pages GROUP BY 1 HAVING count(*) >= 2)")
def regex_key_join(pages):
    keyed = pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"))
    wanted = guards.duplicate_keys(keyed, ["host"])
    return keyed.join(wanted, "host", "left_semi").select("page_id", "host")


@query("symmetric_difference", "manifest", sql="""
, a AS (SELECT id FROM manifest WHERE id % 2 = 0), b AS (SELECT id FROM manifest WHERE id % 3 = 0)
SELECT CASE WHEN a.id IS NULL THEN 'only_b' WHEN b.id IS NULL THEN 'only_a' ELSE 'both' END AS side, CAST(count(*) AS BIGINT) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""")
def symmetric_difference(manifest):
    a, b = (manifest.where(f"id % {k} = 0").select("id", F.lit(True).alias(n)) for k, n in ((2, "in_a"), (3, "in_b")))
    side = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("both")
    return a.join(b, "id", "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


PAIR_SQL = """
, z AS (SELECT s.*, survey_end AS reference, coalesce(shadow, 0) + coalesce(haze, 0) AS penalty, greatest(0.0, cloud) * 10000 + greatest(0.0, 100 - coverage) * 10000 AS departs, month IN (6, 7) AS warm FROM scenes s JOIN surveys USING (city) WHERE month IN (6, 7, 12, 1)),
f AS (SELECT *, cloud = 0 AND coverage = 100 AS strict, bool_or(cloud = 0 AND coverage = 100) OVER (PARTITION BY city, warm) AS any_strict FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY city, warm ORDER BY abs(acquired - reference) + departs + CASE WHEN standard THEN 0 ELSE 100 END - coalesce(sun / CAST(1000 AS DOUBLE), 0), CAST(scene_id AS VARCHAR)) AS place FROM f WHERE strict OR NOT any_strict),
p AS (
  SELECT w.city, w.scene_id AS winter, s.scene_id AS summer, w.acquired AS w_acquired, s.acquired AS s_acquired, w.sun AS w_sun, s.sun AS s_sun, abs(s.acquired - w.acquired) AS gap,
    abs(CAST(floor(((w.acquired - DATE '1970-01-01') + (s.acquired - DATE '1970-01-01')) / 2 - (w.reference - DATE '1970-01-01')) AS BIGINT)) AS apart,
    CASE WHEN contains(w.assets, '8b_sr') AND contains(s.assets, '8b_sr') THEN 1 WHEN contains(w.assets, '4b_sr') AND contains(s.assets, '4b_sr') THEN 2 END AS asset_rank,
    CASE WHEN w.standard THEN 0 ELSE 100 END + CASE WHEN s.standard THEN 0 ELSE 100 END AS quality, w.departs AS wd, s.departs AS sd, w.penalty + s.penalty AS hazy,
    -coalesce(w.sun / CAST(1000 AS DOUBLE), 0) - coalesce(s.sun / CAST(1000 AS DOUBLE), 0) AS bonus
  FROM o w JOIN o s ON w.city = s.city AND NOT w.warm AND s.warm WHERE w.place <= 40 AND s.place <= 40),
q AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY asset_rank, round(apart + greatest(0, gap - 183) * 1000 + quality + wd + sd + hazy + bonus, 9), apart, gap, CAST(winter AS VARCHAR), CAST(summer AS VARCHAR)) AS n FROM p WHERE asset_rank IS NOT NULL),
pairs AS (SELECT * FROM q WHERE n = 1)"""


def _pairs(scenes, surveys):
    dated = scenes.join(surveys.select("city", F.col("survey_end").alias("reference")), "city").withColumn("penalty", rules.penalty("shadow", "haze"))
    return rules.best_pair(dated)


@query("pair_argmin", "scenes", "surveys", sql=f"{PAIR_SQL} SELECT city, winter, summer, CASE asset_rank WHEN 1 THEN 'ortho_analytic_8b_sr' ELSE 'ortho_analytic_4b_sr' END AS asset FROM pairs")
def pair_argmin(scenes, surveys):
    """Every winter scene with every summer scene of a city's two pools, the best with a common asset."""
    return _pairs(scenes, surveys).select("city", "winter", "summer", "asset")


@query("combination_argmax", "scenes", "surveys", sql=f"""
{PAIR_SQL},
i AS (SELECT s.city, scene_id, acquired, sun, clear, coalesce(shadow, 0) + coalesce(haze, 0) AS penalty, w_acquired, s_acquired, w_sun, s_sun FROM scenes s JOIN pairs USING (city)
  WHERE cloud = 0 AND coverage = 100 AND standard AND acquired > least(w_acquired, s_acquired) AND acquired < greatest(w_acquired, s_acquired) AND scene_id NOT IN (winter, summer)),
b AS (SELECT a.city, a.scene_id AS first_id, b.scene_id AS second_id, list_sort([a.w_sun, a.s_sun, a.sun, b.sun]) AS suns, list_sort([a.w_acquired, a.s_acquired, a.acquired, b.acquired]) AS dates, a.penalty + b.penalty AS hazy,
    coalesce((a.clear + b.clear) / 2, a.clear, b.clear) AS clear FROM i a JOIN i b ON a.city = b.city AND a.scene_id < b.scene_id),
k AS (SELECT *, round(suns[4] - suns[1], 9) AS sun_range, round(list_stddev_pop(suns), 9) AS spread, round(least(suns[2] - suns[1], suns[3] - suns[2], suns[4] - suns[3]), 9) AS gap, least(dates[2] - dates[1], dates[3] - dates[2], dates[4] - dates[3]) AS day_gap FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY sun_range DESC, spread DESC, gap DESC, round(clear, 9) DESC NULLS LAST, day_gap DESC, hazy, first_id, second_id) AS n FROM k)
SELECT city, first_id, second_id, sun_range FROM r WHERE n = 1""")
def combination_argmax(scenes, surveys):
    """Two more clean scenes between the dates of a city's pair, of all combinations the one that widens sun elevations most."""
    return rules.between_pair(scenes.withColumn("penalty", rules.penalty("shadow", "haze")), _pairs(scenes, surveys))


@query("union_all", "supplier", "customer", sql="SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def union_all(supplier, customer):
    a = supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


BACKFILL = """
, u AS (SELECT scene_id % 4000 AS id, scene_id, 'main' AS origin, 0 AS p FROM scenes WHERE scene_id < 5000 UNION ALL SELECT scene_id % 4000, scene_id, 'backfill', 1 FROM scenes WHERE scene_id >= 5000)
SELECT id, scene_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS n FROM u) WHERE n = 1"""


def _parts(scenes):
    part = lambda cond, name, p: scenes.where(cond).select((F.col("scene_id") % 4000).alias("id"), "scene_id", F.lit(name).alias("origin"), F.lit(p).alias("p"))
    return part("scene_id < 5000", "main", 0).unionByName(part("scene_id >= 5000", "backfill", 1))


@query("backfill_merge", "scenes", sql=BACKFILL.format(order="p, scene_id"))
def backfill_merge(scenes):
    return selection.top_n(_parts(scenes), ["id"], [F.col("p"), F.col("scene_id")], 1).select("id", "scene_id", "origin")


@query("dedupe_keep_last", "scenes", sql=BACKFILL.format(order="p DESC, scene_id DESC"))
def dedupe_keep_last(scenes):
    return selection.top_n(_parts(scenes), ["id"], [F.desc("p"), F.desc("scene_id")], 1).select("id", "scene_id", "origin")


@query("distinct_conflict", "lineitem", sql="SELECT l_partkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def distinct_conflict(lineitem):
    return lineitem.select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("suppliers")).where("suppliers > 1")


@query("set_intersect", "lineitem", "orders", sql="SELECT l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(lineitem, orders):
    return lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")).intersect(orders.where("o_orderstatus = 'F'").select("o_orderkey"))


@query("set_except_coverage", "manifest", sql="SELECT 'missing' AS problem, id FROM manifest WHERE id % 10 = 9 UNION ALL SELECT 'shared', id FROM manifest WHERE id % 10 = 4")
def set_except_coverage(manifest):
    a, b, whole = manifest.where("id % 10 < 5").select("id"), manifest.where("id % 10 >= 4 AND id % 10 < 9").select("id"), manifest.select("id")
    missing = whole.exceptAll(a.union(b).distinct())
    return missing.select(F.lit("missing").alias("problem"), "id").union(a.intersect(b).select(F.lit("shared"), "id"))
