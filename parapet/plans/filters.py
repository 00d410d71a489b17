"""Projections, derivations, filters and guards on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..operators import guards, labels
from ..operators import scenes as rules
from .registry import query


@query("null_audit", "scenes", sql="""
SELECT 'shadow' AS "column", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(shadow) AS BIGINT) AS missing FROM scenes
UNION ALL SELECT 'sun', count(*), count(*) - count(sun) FROM scenes""")
def null_audit(scenes):
    return guards.null_counts(scenes, ["shadow", "sun"])


@query("duplicate_key_audit", "lineitem", sql="SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_audit(lineitem):
    return guards.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"])


@query("orphan_keys", "lineitem", "orders", sql="SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_keys(lineitem, orders):
    return guards.orphans(lineitem, orders.where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")


@query("strict_clean_filter", "scenes", sql="SELECT scene_id, city, month FROM scenes WHERE month IN (6, 7, 12, 1) AND cloud = 0 AND coverage = 100 AND standard")
def strict_clean_filter(scenes):
    return scenes.where(F.col("month").isin(6, 7, 12, 1) & (F.col("cloud") == 0) & (F.col("coverage") == 100) & F.col("standard")).select("scene_id", "city", "month")


@query("between_exclusive_anti", "scenes", sql="""
SELECT s.scene_id, s.year FROM scenes s WHERE s.year > 2017 AND s.year < 2021
AND NOT EXISTS (SELECT 1 FROM scenes t WHERE t.scene_id = s.scene_id AND t.kind = 'click')""")
def between_exclusive_anti(scenes):
    chosen = scenes.where("kind = 'click'").select("scene_id")
    return scenes.where("year > 2017 AND year < 2021").join(chosen, "scene_id", "left_anti").select("scene_id", "year")


@query("eligible_pool", "scenes", sql="SELECT city, CAST(count(*) AS BIGINT) AS n FROM scenes WHERE abs(view_angle) >= 5 AND cloud <= 0.02 AND coverage >= 99 AND standard GROUP BY city HAVING count(*) >= 3")
def eligible_pool(scenes):
    pool = scenes.where((F.abs("view_angle") >= 5) & (F.col("cloud") <= 0.02) & (F.col("coverage") >= 99) & F.col("standard"))
    return pool.groupBy("city").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


TIER_SQL = "CASE WHEN coverage >= 99.999999 AND cloud <= 1e-12 THEN 0 WHEN coverage >= 99.5 AND cloud <= 1e-12 THEN 1 WHEN coverage >= 99.5 AND cloud <= 0.01 THEN 2 ELSE 3 END"


@query("filter_tier_case", "scenes", sql=f"SELECT {TIER_SQL} AS tier, CAST(count(*) AS BIGINT) AS n FROM scenes GROUP BY 1")
def filter_tier_case(scenes):
    return scenes.groupBy(rules.filter_tier(F.col("coverage"), F.col("cloud")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


SEASON_SQL = """CASE WHEN month IN (6, 7) THEN CASE WHEN lat >= 0 THEN 'summer' ELSE 'winter' END
  WHEN month IN (12, 1) THEN CASE WHEN lat >= 0 THEN 'winter' ELSE 'summer' END END"""


@query("season_case", "scenes", sql=f"SELECT {SEASON_SQL} AS season, CAST(count(*) AS BIGINT) AS n FROM scenes GROUP BY 1")
def season_case(scenes):
    return scenes.groupBy(geo.season(F.col("lat"), F.col("month")).alias("season")).agg(F.count(F.lit(1)).alias("n"))


SECTOR_SQL = "CASE WHEN bearing >= 315 OR bearing < 45 THEN 'N' WHEN bearing < 135 THEN 'E' WHEN bearing < 225 THEN 'S' ELSE 'W' END"


@query("bearing_sector", "scenes", sql=f"""
SELECT {SECTOR_SQL} AS sector4, ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((bearing + 22.5) / 45) AS INT) % 8 + 1] AS sector8, CAST(count(*) AS BIGINT) AS n
FROM scenes GROUP BY ALL""")
def bearing_sector(scenes):
    b = F.col("bearing")
    return scenes.groupBy(geo.sector4(b).alias("sector4"), geo.sector8(b).alias("sector8")).agg(F.count(F.lit(1)).alias("n"))


@query("temporal_fallback_level", "scenes", "surveys", sql=f"""
, y AS (SELECT city, year(survey_end) AS last, CASE WHEN regexp_matches(years, '^\\d{{4}}$') OR contains(years, ';') OR (regexp_matches(years, '^\\d{{4}}-\\d{{4}}$') AND precision_kind IN ('exact_official_project_range', 'official_flight_lot_range'))
    THEN list_transform(regexp_extract_all(years, '\\d{{4}}'), lambda x: CAST(x AS INT)) ELSE [] END AS exact FROM surveys),
t AS (SELECT s.year AS year, last, list_contains(exact, s.year) AS hit, {SEASON_SQL} IS NOT NULL AS solstice FROM scenes s JOIN y USING (city) WHERE standard)
SELECT CAST(CASE WHEN hit THEN 0 WHEN year > last THEN 1 ELSE 2 END + CASE WHEN solstice THEN 0 ELSE 3 END AS INT) AS level,
  CASE WHEN hit THEN 'acquisition_year' WHEN year > last THEN 'post_lidar' ELSE 'pre_lidar_fallback' END AS relation,
  CAST(CASE WHEN hit THEN 0 WHEN year > last THEN year - last ELSE last - year END AS INT) AS years_off, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL""")
def temporal_fallback_level(scenes, surveys):
    read = rules.survey_years(F.col("years"), F.col("precision_kind"), first_year=0)
    exact = surveys.select("city", F.year("survey_end").alias("last"), read["eligible"].alias("exact"))
    hit, y, last = F.array_contains("exact", F.col("year")), F.col("year"), F.col("last")
    phase = F.when(hit, 0).when(y > last, 1).otherwise(2)
    level = phase + F.when(geo.season(F.col("lat"), F.col("month")).isNotNull(), 0).otherwise(3)
    relation = F.element_at(F.array(*map(F.lit, ("acquisition_year", "post_lidar", "pre_lidar_fallback"))), phase + 1)
    away = F.when(hit, 0).otherwise(F.abs(y - last))
    return scenes.where("standard").join(exact, "city").groupBy(level.alias("level"), relation.alias("relation"), away.alias("years_off")).agg(F.count(F.lit(1)).alias("n"))


@query("year_rule_parse", "surveys", sql="""
, r AS (SELECT city, years, CASE WHEN contains(years, ';') THEN 'semicolon_separated_exact_years' WHEN regexp_full_match(years, '\\d{4}') THEN 'single_exact_or_documented_year'
    WHEN regexp_full_match(years, '\\d{4}-\\d{4}') AND precision_kind IN ('exact_official_project_range', 'official_flight_lot_range') THEN 'documented_two_year_range_endpoints'
    WHEN regexp_full_match(years, '\\d{4}-\\d{4}') AND precision_kind IN ('official_campaign_range', 'official_catalog_series_range', 'official_national_campaign_range') THEN 'broad_range_not_expanded'
    ELSE 'unresolved_acquisition_year_format' END AS rule FROM surveys),
y AS (SELECT *, CASE WHEN rule IN ('broad_range_not_expanded', 'unresolved_acquisition_year_format') THEN [] ELSE list_sort(list_distinct(list_transform(regexp_extract_all(years, '\\d{4}'), lambda x: CAST(x AS INT)))) END AS ys FROM r),
e AS (SELECT city, rule, array_to_string(list_filter(ys, lambda x: x >= 2016), ';') AS eligible, array_to_string(list_filter(ys, lambda x: x < 2016), ';') AS excluded FROM y)
SELECT city, rule, eligible, excluded, CASE WHEN eligible <> '' THEN 'eligible' WHEN rule = 'broad_range_not_expanded' THEN 'requires_exact_lidar_tile_year' WHEN excluded <> '' THEN 'no_same_year_planetscope_metadata' ELSE 'requires_acquisition_year_review' END AS status FROM e""")
def year_rule_parse(surveys):
    read = surveys.select("city", rules.survey_years(F.col("years"), F.col("precision_kind")).alias("y"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ";")
    return read.select("city", "y.rule", joined("y.eligible").alias("eligible"), joined("y.excluded").alias("excluded"), "y.status")


@query("unpivot_metrics", "heights", sql="""
SELECT city, variable, CAST(count(*) AS BIGINT) AS n, round(sum(v), 3) AS total FROM (UNPIVOT heights ON p90, p95, top INTO NAME variable VALUE v) GROUP BY ALL""")
def unpivot_metrics(heights):
    long = heights.unpivot(["city"], ["p90", "p95", "top"], "variable", "v")
    return long.groupBy("city", "variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"))


@query("unit_convert_case", "buildings", sql="SELECT id, round(CAST(CASE WHEN brand IN ('Brand#1', 'Brand#2') THEN size * 0.3048 ELSE size END AS DOUBLE), 6) AS height, brand IN ('Brand#1', 'Brand#2') AS was_feet FROM buildings")
def unit_convert_case(buildings):
    feet = F.col("brand").isin("Brand#1", "Brand#2")
    return buildings.select("id", F.round(F.when(feet, F.col("size") * scalars.FEET).otherwise(F.col("size").cast("double")), 6).alias("height"), feet.alias("was_feet"))


@query("min_height_clamp", "heights", sql="SELECT id, run, p95, CASE WHEN p95 > 0 AND p95 < 2.4 THEN CAST(2.4 AS DOUBLE) ELSE p95 END AS clamped FROM heights")
def min_height_clamp(heights):
    v = F.col("p95")
    return heights.select("id", "run", "p95", F.when((v > 0) & (v < 2.4), F.lit(2.4)).otherwise(v).alias("clamped"))


@query("impute_nonpositive_audit", "pixels", sql="""
SELECT city, CAST(count(*) FILTER (WHERE c % 2 = 0) AS BIGINT) AS masked, CAST(count(*) FILTER (WHERE c % 2 = 0 AND v <= 0) AS BIGINT) AS imputed,
  round(sum(CASE WHEN c % 2 = 0 AND v <= 0 THEN 2.4 ELSE v END), 4) AS total FROM pixels GROUP BY city""")
def impute_nonpositive_audit(pixels):
    masked = F.col("c") % 2 == 0
    bad = masked & (F.col("v") <= 0)
    return pixels.groupBy("city").agg(F.count_if(masked).alias("masked"), F.count_if(bad).alias("imputed"), F.round(F.sum(F.when(bad, F.lit(2.4)).otherwise(F.col("v"))), 4).alias("total"))


@query("nonpositive_to_null", "heights", sql="SELECT city, CAST(count(CASE WHEN official > 0 THEN official END) AS BIGINT) AS official, CAST(count(CASE WHEN p95 > 0 THEN p95 END) AS BIGINT) AS p95 FROM heights GROUP BY city")
def nonpositive_to_null(heights):
    return heights.groupBy("city").agg(*[F.count(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in ("official", "p95")])


@query("batch_offset_limit", "cities", sql="SELECT slug, country FROM cities ORDER BY slug LIMIT 25 OFFSET 50")
def batch_offset_limit(cities):
    return cities.select("slug", "country").orderBy("slug").offset(50).limit(25)


@query("reason_flags", "scenes", sql="""
SELECT scene_id, array_to_string(list_distinct_ordered, ';') AS reasons FROM (
  SELECT scene_id, list_filter([CASE WHEN cloud > 0 THEN 'cloudy' END, CASE WHEN coverage < 99 THEN 'partial' END, CASE WHEN NOT standard THEN 'quality' END, CASE WHEN shadow IS NULL THEN 'no_shadow' END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM scenes)""")
def reason_flags(scenes):
    flags = [(F.col("cloud") > 0, "cloudy"), (F.col("coverage") < 99, "partial"), (~F.col("standard"), "quality"), (F.col("shadow").isNull(), "no_shadow")]
    return scenes.select("scene_id", scalars.reasons(*flags).alias("reasons"))


@query("quality_tier", "points", sql="""
, n AS (SELECT tile, CAST(floor(x / 32) AS BIGINT) AS strip, CAST(count(*) FILTER (WHERE class = 6) AS BIGINT) AS roof, CAST(count(*) FILTER (WHERE class = 2) AS BIGINT) AS ground,
    quantile_cont(z, 0.9) FILTER (WHERE class = 6) - median(z) FILTER (WHERE class = 2) AS height, tile = 3 AS late FROM points GROUP BY ALL),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN roof < 10 THEN 'fewer_than_10_roof_points' END, CASE WHEN ground < 10 THEN 'fewer_than_10_ground_points' END,
    CASE WHEN height IS NULL THEN 'missing_height' WHEN height <= 0 THEN 'implausible_height' END, CASE WHEN late THEN 'constructed_after_lidar' END], lambda x: x IS NOT NULL), ';') AS reasons FROM n),
t AS (SELECT *, CASE WHEN reasons <> '' THEN 'Reject' WHEN roof >= 100 AND ground >= 100 THEN 'A' WHEN roof >= 40 AND ground >= 40 THEN 'B' ELSE 'C' END AS tier FROM r)
SELECT tile, strip, roof, ground, round(height, 6) AS height, reasons, tier, tier IN ('A', 'B') AS usable_for_training, tier IN ('A', 'B', 'C') AS usable_for_validation,
  round(least(1.0, roof / 50), 6) AS roof_coverage, round(least(1.0, ground / 50), 6) AS ground_coverage FROM t""")
def quality_tier(points):
    z = lambda k: F.when(F.col("class") == k, F.col("z"))
    n = points.groupBy("tile", F.floor(F.col("x") / 32).alias("strip")).agg(
        F.count(z(6)).alias("roof"), F.count(z(2)).alias("ground"), (F.percentile(z(6), F.lit(0.9)) - F.median(z(2))).alias("height")
    )
    roof, ground, height = F.col("roof"), F.col("ground"), F.col("height")
    late = F.when(F.col("tile") == 3, "constructed_after_lidar")
    return n.withColumns(labels.quality(roof, ground, height, late)).select(
        "tile", "strip", "roof", "ground", F.round("height", 6).alias("height"), "reasons", "tier", "usable_for_training", "usable_for_validation",
        F.round("roof_coverage", 6).alias("roof_coverage"), F.round("ground_coverage", 6).alias("ground_coverage"),
    )


@query("temporal_mismatch", "manifest", sql="""
, b AS (SELECT id, CASE id % 3 WHEN 0 THEN 'new_york_city' WHEN 1 THEN 'los_angeles' ELSE 'boston' END AS city, CASE WHEN id % 7 = 0 THEN 'Removed ' WHEN state = 'F' THEN 'DEMOLISHED' ELSE 'Existing' END AS status,
    year(placed) + 18 AS built, year(placed) + 28 AS drawn, id % 10 = 0 AS merged FROM manifest)
SELECT id, CASE WHEN merged THEN '' WHEN city = 'new_york_city' AND built > 2014 THEN 'constructed_after_lidar' WHEN city = 'los_angeles' AND lower(trim(status)) IN ('demolished', 'removed') THEN 'footprint_status_demolished_or_removed'
  WHEN city = 'los_angeles' AND drawn > 2024 THEN 'footprint_date_after_lidar' ELSE '' END AS mismatch FROM b""")
def temporal_mismatch(manifest):
    k, y = F.col("id") % 3, F.year("placed")
    city = F.when(k == 0, "new_york_city").when(k == 1, "los_angeles").otherwise("boston")
    status = F.when(F.col("id") % 7 == 0, "Removed ").when(F.col("state") == "F", "DEMOLISHED").otherwise("Existing")
    return manifest.select("id", labels.temporal_mismatch(city, status, y + 18, y + 28, F.col("id") % 10 == 0).alias("mismatch"))


BIN_SQL = "CASE WHEN {v} < 0 THEN NULL WHEN {v} < 3 THEN '0-3' WHEN {v} < 6 THEN '3-6' WHEN {v} < 10 THEN '6-10' WHEN {v} < 25 THEN '10-25' WHEN {v} < 50 THEN '25-50' ELSE '50+' END"


@query("height_bin_case", "buildings_eval", sql=f"SELECT {BIN_SQL.format(v='target')} AS bin, CAST(count(*) AS BIGINT) AS n FROM buildings_eval GROUP BY 1")
def height_bin_case(rows):
    return rows.groupBy(scalars.height_bin(F.col("target")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("height_category", "chips", sql="SELECT city, CASE WHEN p90_height >= 30 OR max_height >= 50 THEN 'highrise' WHEN p90_height >= 10 THEN 'midrise' ELSE 'lowrise' END AS category, CAST(count(*) AS BIGINT) AS n FROM chips GROUP BY ALL")
def height_category(chips):
    return chips.groupBy("city", scalars.height_category(F.col("p90_height"), F.col("max_height")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("rename_aliases", "cities", sql="SELECT slug AS id, country, continent AS selection_region FROM cities")
def rename_aliases(cities):
    return guards.with_aliases(cities.select("slug", "country", "continent"), {"id": "slug", "selection_region": "continent"}).drop("slug", "continent").select("id", "country", "selection_region")


@query("first_available_column", "buildings", sql="SELECT id, price AS height, 'price' AS taken_from FROM buildings")
def first_available_column(buildings):
    """The official height is the first of the candidate columns that a city's table has."""
    name = scalars.first_column(buildings.columns, ["HEIGHTROOF", "Price", "size"])
    return buildings.select("id", F.col(name).alias("height"), F.lit(name).alias("taken_from"))


@query("asset_preference", "scenes", sql="""
, a AS (SELECT scene_id, CASE scene_id % 3 WHEN 0 THEN ['sr', 'udm'] WHEN 1 THEN ['analytic', 'sr8'] ELSE ['udm'] END AS assets FROM scenes)
SELECT scene_id, list_filter(['sr8', 'sr', 'analytic'], lambda x: list_contains(assets, x))[1] AS asset FROM a""")
def asset_preference(scenes):
    arr = lambda *xs: F.array(*map(F.lit, xs))
    k = F.col("scene_id") % 3
    assets = F.when(k == 0, arr("sr", "udm")).when(k == 1, arr("analytic", "sr8")).otherwise(arr("udm"))
    return scenes.select("scene_id", scalars.preferred(["sr8", "sr", "analytic"], assets).alias("asset"))


@query("source_routing", "cities", sql="SELECT slug, CASE WHEN country IN ('NATION_1', 'NATION_2') THEN 'registry_a' WHEN continent = (SELECT max(r_name) FROM region) THEN 'registry_b' ELSE 'global' END AS registry FROM cities")
def source_routing(cities):
    last = cities.agg(F.max("continent")).first()[0]
    return cities.select("slug", F.when(F.col("country").isin("NATION_1", "NATION_2"), "registry_a").when(F.col("continent") == last, "registry_b").otherwise("global").alias("registry"))


@query("coverage_status", "scenes", sql="SELECT city, CASE WHEN max(coverage) FILTER (WHERE standard) IS NULL THEN 'not_found' WHEN max(coverage) FILTER (WHERE standard) >= 99 THEN 'ready' ELSE 'incomplete' END AS status FROM scenes GROUP BY city")
def coverage_status(scenes):
    best = F.max(F.when(F.col("standard"), F.col("coverage")))
    return scenes.groupBy("city").agg(best.alias("b")).select("city", F.when(F.col("b").isNull(), "not_found").when(F.col("b") >= 99, "ready").otherwise("incomplete").alias("status"))


@query("highrise_flag", "heights", sql="SELECT id, bool_or(p95 >= 30 OR top >= 50) AS highrise FROM heights GROUP BY id")
def highrise_flag(heights):
    return heights.groupBy("id").agg(F.bool_or((F.col("p95") >= 30) | (F.col("top") >= 50)).alias("highrise"))


@query("enum_map", "manifest", sql="SELECT id, CASE state WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 0 END AS code FROM manifest")
def enum_map(manifest):
    codes = F.create_map(F.lit("F"), F.lit(3), F.lit("O"), F.lit(2))
    return manifest.select("id", F.coalesce(F.element_at(codes, F.col("state")), F.lit(0)).alias("code"))


@query("config_merge", "manifest", sql="SELECT bundle, CAST(CASE WHEN bundle LIKE '1%' THEN 0.1 ELSE 0.01 END AS DOUBLE) AS rate, CASE WHEN bundle LIKE '2%' THEN 64 ELSE 32 END AS batch, 'base' AS model FROM (SELECT DISTINCT bundle FROM manifest)")
def config_merge(manifest):
    text = lambda **kv: F.create_map(*[F.lit(str(x)) for pair in kv.items() for x in pair])
    base = text(rate=0.01, batch=32, model="base")
    more = F.when(F.col("bundle").startswith("1"), text(rate=0.1)).when(F.col("bundle").startswith("2"), text(batch=64)).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(F.col("more"), k)), F.col("more"))
    out = manifest.select("bundle").distinct().withColumn("more", more).select("bundle", merged.alias("m"))
    return out.select("bundle", F.col("m")["rate"].cast("double").alias("rate"), F.col("m")["batch"].cast("int").alias("batch"), F.col("m")["model"].alias("model"))
