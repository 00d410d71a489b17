"""Scalar functions on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, scalars
from .registry import query



@query("slugify", "part", sql="SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name || ' É ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugify(part):
    return part.select("p_partkey", scalars.slug(F.concat_ws(" É ", "p_name", "p_brand")).alias("slug"))


@query("normalize_text", "nation", sql="SELECT n_nationkey, trim(regexp_replace(regexp_replace(lower(strip_accents(n_name || '  (Área) São')), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM nation")
def normalize_text(nation):
    return nation.select("n_nationkey", scalars.match_text(F.concat("n_name", F.lit("  (Área) São"))).alias("name"))


@query("null_like", "scenes", sql="SELECT scene_id, CASE scene_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN kind ELSE '' END AS value FROM scenes")
def null_like(scenes):
    k = F.col("scene_id") % 4
    return scenes.select("scene_id", scalars.null_like(F.when(k == 0, " NaN ").when(k == 1, "none").when(k == 2, F.col("kind"))).alias("value"))


@query("regex_extract", "pages", sql="SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, CAST(nullif(regexp_extract(url, '/(\\d+)', 1), '') AS BIGINT) AS number FROM pages")
def regex_extract(pages):
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", r"/(\d+)", 1).try_cast("bigint").alias("number"))


@query("split_join", "part", sql="SELECT p_partkey, array_to_string(list_sort(string_split(p_name || ';' || p_type, ' ')), '|') AS parts FROM part")
def split_join(part):
    return part.select("p_partkey", F.array_join(F.array_sort(F.split(F.concat_ws(";", "p_name", "p_type"), " ")), "|").alias("parts"))


@query("safe_cast", "part", sql="SELECT p_partkey, TRY_CAST(CASE p_partkey % 3 WHEN 0 THEN 'nan' WHEN 1 THEN 'x' || p_size ELSE CAST(p_size AS VARCHAR) END AS BIGINT) AS value FROM part")
def safe_cast(part):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.lit("nan")).when(k == 1, F.concat(F.lit("x"), "p_size")).otherwise(F.col("p_size").cast("string"))
    return part.select("p_partkey", scalars.safe_double(text).cast("bigint").alias("value"))


@query("sha256_text", "cities", sql="SELECT slug, sha256('419453:' || slug) AS digest FROM cities")
def sha256_text(cities):
    return cities.select("slug", F.sha2(F.concat_ws(":", F.lit("419453"), "slug"), 256).alias("digest"))


@query("local_time", "orders", sql="SELECT o_orderkey, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM orders")
def local_time(orders):
    return orders.select("o_orderkey", F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "America/New_York").cast("timestamp_ntz").alias("local"))


@query("date_parts", "orders", sql="SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders")
def date_parts(orders):
    d = F.col("o_orderdate")
    return orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.trunc(d.cast("date"), "month").alias("month_start"))


@query("epoch_ms_date", "orders", sql="SELECT o_orderkey, CAST(epoch_ms(o_orderkey * 86400123) AS DATE) AS day FROM orders")
def epoch_ms_date(orders):
    return orders.select("o_orderkey", F.timestamp_millis(F.col("o_orderkey") * 86400123).cast("date").alias("day"))


@query("floor_days", "orders", sql="SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-06-01 12:00:00')) / 86400000000) AS BIGINT) AS days FROM orders")
def floor_days(orders):
    return orders.select("o_orderkey", scalars.floor_days(F.col("o_orderdate"), F.lit("1998-06-01 12:00:00").cast("timestamp")).alias("days"))


@query("annual_windows", "orders", sql="""
, t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s FROM orders),
w AS (SELECT o_orderkey, s, unnest(range(0, 12)) AS i FROM t)
SELECT o_orderkey, CAST(s + to_months(CAST(12 * i AS INT)) AS DATE) AS begin, least(CAST(s + to_months(CAST(12 * (i + 1) AS INT)) AS DATE), DATE '2003-03-01') AS stop
FROM w WHERE s + to_months(CAST(12 * i AS INT)) < DATE '2003-03-01'""")
def annual_windows(orders):
    rows = orders.select("o_orderkey", F.explode(scalars.annual_windows(F.col("o_orderdate").cast("date"), F.lit("2003-03-01").cast("date"))).alias("w"))
    return rows.select("o_orderkey", "w.begin", "w.stop").where("begin < stop")


@query("row_sum", "scenes", sql="SELECT scene_id, coalesce(haze, 0) + coalesce(shadow, 0) + cloud AS total FROM scenes")
def row_sum(scenes):
    return scenes.select("scene_id", scalars.row_sum(F.col("haze"), F.col("shadow"), F.col("cloud")).alias("total"))


@query("bearing_distance", "buildings", sql="""
SELECT id, round(((degrees(atan2(xmin - 250, ymin - 200)) % 360) + 360) % 360, 6) AS bearing, round(sqrt((xmin - 250) * (xmin - 250) + (ymin - 200) * (ymin - 200)), 6) AS distance FROM buildings""")
def bearing_distance(buildings):
    dx, dy = F.col("xmin") - 250, F.col("ymin") - 200
    return buildings.select("id", F.round(geo.bearing_of(dx, dy), 6).alias("bearing"), F.round(F.hypot(dx, dy), 6).alias("distance"))


@query("geodesic_buffer", "supplier", sql="""
, c AS (SELECT s_suppkey, radians((s_suppkey % 360) - 180) AS l, radians((s_suppkey % 120) - 60) AS p, 5000 / 6371008.8 AS d FROM supplier),
v AS (SELECT *, unnest(range(0, 360, 5)) AS b FROM c),
w AS (SELECT s_suppkey, b, l, p, d, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(radians(b))) AS q FROM v)
SELECT s_suppkey, CAST(b AS INT) AS bearing, round(degrees(q), 5) AS lat FROM w""")
def geodesic_buffer(supplier):
    k = F.col("s_suppkey")
    ring = geo.geodesic_buffer(((k % 360) - 180).cast("double"), ((k % 120) - 60).cast("double"), F.lit(5000.0))
    return supplier.select("s_suppkey", F.posexplode(ring).alias("i", "p")).where("i < 72").select("s_suppkey", (F.col("i") * 5).alias("bearing"), F.round("p.lat", 5).alias("lat"))


@query("utm_zone", "supplier", sql="""
SELECT s_suppkey, CAST(CASE WHEN (s_suppkey % 120) - 60 >= 0 THEN 32600 ELSE 32700 END + least(60, floor(((s_suppkey % 361) - 180 + 180) / 6) + 1) AS INT) AS epsg FROM supplier""")
def utm_zone(supplier):
    k = F.col("s_suppkey")
    return supplier.select("s_suppkey", geo.utm_zone((k % 361) - 180, (k % 120) - 60).alias("epsg"))


@query("grid_index", "points", sql="SELECT CAST(floor((x - 3) / 7) AS BIGINT) AS col, CAST(floor((400 - y) / 7) AS BIGINT) AS row, CAST(count(*) AS BIGINT) AS n FROM points WHERE x >= 3 AND y <= 400 GROUP BY ALL")
def grid_index(points):
    inside = points.where("x >= 3 AND y <= 400")
    return inside.groupBy(F.floor((F.col("x") - 3) / 7).alias("col"), F.floor((400 - F.col("y")) / 7).alias("row")).agg(F.count(F.lit(1)).alias("n"))


@query("window_starts", "part", sql="""
SELECT p_partkey, array_to_string(CASE WHEN (p_size + 5) % 1 = 0 AND greatest(0, p_size * 10 - 64) % 48 = 0 THEN range(0, greatest(0, p_size * 10 - 64) + 1, 48) ELSE list_append(range(0, greatest(0, p_size * 10 - 64) + 1, 48), greatest(0, p_size * 10 - 64)) END, ',') AS starts FROM part""")
def window_starts(part):
    return part.select("p_partkey", F.array_join(scalars.window_starts(F.col("p_size") * 10, 64, 48).cast("array<string>"), ",").alias("starts"))


@query("clamp_round", "buildings_eval", sql="SELECT chip, part, target, round(least(greatest(predicted, 0), 40), 3) AS clamped FROM buildings_eval")
def clamp_round(rows):
    return rows.select("chip", "part", "target", F.round(F.least(F.greatest("predicted", F.lit(0.0)), F.lit(40.0)), 3).alias("clamped"))


@query("percentile_stretch", "pixels", sql="""
, q AS (SELECT city, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pixels GROUP BY city)
SELECT chip, r, c, round(least(1.0, greatest(0.0, (v - lo) / (hi - lo))), 5) AS stretched FROM pixels JOIN q USING (city)""")
def percentile_stretch(pixels):
    q = pixels.groupBy("city").agg(F.percentile("v", F.lit(0.02)).alias("lo"), F.percentile("v", F.lit(0.98)).alias("hi"))
    v = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    return pixels.join(q, "city").select("chip", "r", "c", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 5).alias("stretched"))


@query("json_extract", "events", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(event_id AS VARCHAR) || ':' || event_type AS label FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50")
def json_extract(events):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    return events.select("event_id", F.from_json("props", schema)["k"].alias("k"), F.concat_ws(":", "event_id", "event_type").alias("label")).where("k >= 50")


@query("geojson_bbox", "buildings", sql="SELECT id, xmin AS west, ymin AS south, xmax AS east, ymax AS north FROM buildings")
def geojson_bbox(buildings):
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"), point("xmin", "ymin"))
    text = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    parsed = F.from_json(text, "type string, coordinates array<array<array<double>>>")["coordinates"]
    flat = buildings.select("id", F.flatten(parsed).alias("p"))
    xs, ys = F.transform("p", lambda q: q[0]), F.transform("p", lambda q: q[1])
    return flat.select("id", F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))
