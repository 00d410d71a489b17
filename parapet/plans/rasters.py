"""Spatial joins and rasters held as tables of cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster, spatial
from ..operators.metrics import r6
from .registry import query

MEET = "a.id < b.id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


@query("spatial_self_join_bbox", "buildings", sql=f"SELECT a.id AS a_id, b.id AS b_id FROM buildings a JOIN buildings b ON {MEET}")
def spatial_self_join_bbox(buildings):
    return spatial.touching_pairs(buildings).select("a_id", "b_id")


@query("connected_components", "buildings", sql=f"""
, e AS (SELECT a.id AS x, b.id AS y FROM buildings a JOIN buildings b ON {MEET}), u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (WITH RECURSIVE w AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, w.root FROM w JOIN u ON w.node = u.x WHERE w.root < u.y) SELECT node, min(root) AS root FROM w GROUP BY node)
SELECT node, root FROM r""")
def connected_components(buildings):
    return spatial.components(spatial.touching_pairs(buildings).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


@query("spatial_semi_join", "buildings", sql="SELECT id FROM buildings WHERE xmin <= 300 AND xmax >= 100 AND ymin <= 250 AND ymax >= 50")
def spatial_semi_join(buildings):
    area = buildings.sparkSession.createDataFrame([(100.0, 50.0, 300.0, 250.0)], "axmin double, aymin double, axmax double, aymax double")
    cells = spatial.cells(area, 64.0, "axmin", "aymin", "axmax", "aymax")
    b = spatial.cells(buildings, 64.0)
    meet = (F.col("xmin") <= F.col("axmax")) & (F.col("xmax") >= F.col("axmin")) & (F.col("ymin") <= F.col("aymax")) & (F.col("ymax") >= F.col("aymin"))
    return b.join(cells, (b["gx"] == cells["gx"]) & (b["gy"] == cells["gy"]) & meet, "left_semi").select("id").distinct()


@query("bbox_range_join", "points", "buildings", sql="""
SELECT id, CAST(count(*) AS BIGINT) AS n, round(max(z), 6) AS top FROM points JOIN buildings ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY id""")
def bbox_range_join(points, buildings):
    return spatial.boxes_of_points(points, buildings).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("z"), 6).alias("top"))


@query("point_in_polygon", "points", "buildings", sql="""
SELECT id, CAST(count(*) AS BIGINT) AS n FROM points JOIN buildings ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax AND (x - xmin) * (ymax - ymin) < (ymax - y) * (xmax - xmin) WHERE class <> 7 GROUP BY id""")
def point_in_polygon(points, buildings):
    """Points in the lower left triangle of each box."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmin", "ymax"), p("xmin", "ymin"))
    near = spatial.boxes_of_points(points.where("class <> 7"), buildings.withColumn("ring", ring))
    return near.where(geo.inside_ring(F.col("x"), F.col("y"), F.col("ring"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("roof_ground_percentiles", "points", "buildings", sql="""
, j AS (SELECT id, class, z FROM points JOIN buildings ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax),
g AS (SELECT id, median(z) AS ground FROM j WHERE class = 2 GROUP BY id), h AS (SELECT id, ground, z - ground AS h FROM j JOIN g USING (id) WHERE class = 6)
SELECT id, round(any_value(ground), 9) AS ground, CAST(count(*) AS BIGINT) AS n, round(avg(h), 9) AS mean, round(median(h), 9) AS p50, round(quantile_cont(h, 0.75), 9) AS p75, round(quantile_cont(h, 0.9), 9) AS p90,
  round(quantile_cont(h, 0.95), 9) AS p95, round(quantile_cont(h, 0.99), 9) AS p99, round(max(h), 9) AS top FROM h GROUP BY id""")
def roof_ground_percentiles(points, buildings):
    j = spatial.boxes_of_points(points, buildings).select("id", "class", "z")
    g = j.where("class = 2").groupBy("id").agg(F.median("z").alias("ground"))
    roof = j.where("class = 6").join(g, "id").withColumn("h", F.col("z") - F.col("ground"))
    at = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return roof.groupBy("id").agg(
        F.round(F.first("ground"), 9).alias("ground"), F.count(F.lit(1)).alias("n"), F.round(F.avg("h"), 9).alias("mean"),
        *[F.round(F.percentile("h", F.lit(p)), 9).alias(name) for name, p in at.items()], F.round(F.max("h"), 9).alias("top"),
    )


@query("roof_ring_points", "points", "buildings", sql="""
, e AS (SELECT *, CASE WHEN least(xmax - xmin, ymax - ymin) > 2 THEN 1.0 WHEN least(xmax - xmin, ymax - ymin) > 1 THEN 0.5 ELSE 0.0 END AS erosion FROM buildings),
f AS (SELECT x, y, z FROM points p WHERE class = 2 AND NOT EXISTS (SELECT 1 FROM buildings b WHERE p.x BETWEEN b.xmin AND b.xmax AND p.y BETWEEN b.ymin AND b.ymax)),
d AS (SELECT id, sqrt(greatest(xmin - x, 0, x - xmax) ** 2 + greatest(ymin - y, 0, y - ymax) ** 2) AS d FROM e JOIN f ON x BETWEEN xmin - 5 AND xmax + 5 AND y BETWEEN ymin - 5 AND ymax + 5),
g AS (SELECT id, count(*) AS n FROM d WHERE d >= 1 AND d <= 5 GROUP BY id),
r AS (SELECT id, count(*) AS n FROM e JOIN points ON class = 6 AND x BETWEEN xmin + erosion AND xmax - erosion AND y BETWEEN ymin + erosion AND ymax - erosion GROUP BY id)
SELECT id, CAST(erosion AS DOUBLE) AS erosion, CAST(coalesce(r.n, 0) AS BIGINT) AS roof, CAST(coalesce(g.n, 0) AS BIGINT) AS ground FROM e LEFT JOIN r USING (id) LEFT JOIN g USING (id)""")
def roof_ring_points(points, buildings):
    """Roof points inside the eroded footprint, and ground points in the ring from 1 to 5 around it that no footprint holds."""
    roof, ground = points.where("class = 6"), points.where("class = 2")
    eroded = spatial.eroded(buildings, (1.0, 0.5))
    on_roof = spatial.boxes_of_points(roof, eroded).groupBy("id").agg(F.count(F.lit(1)).alias("roof"))
    in_ring = spatial.ring_points(ground, buildings, 1.0, 5.0).groupBy("id").agg(F.count(F.lit(1)).alias("ground"))
    counted = eroded.select("id", "erosion").join(on_roof, "id", "left").join(in_ring, "id", "left")
    return counted.select("id", "erosion", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("roof", "ground")])


CELLS = ", g AS (SELECT CAST(floor(y / 8) AS BIGINT) AS r, CAST(floor(x / 8) AS BIGINT) AS c, max(z) FILTER (WHERE class = 6) AS dsm, CAST(sum(CAST(z AS DECIMAL(18, 5))) FILTER (WHERE class = 2) AS DOUBLE) / count(*) FILTER (WHERE class = 2) AS dtm FROM points GROUP BY ALL)"


def _mean_of_exact(value, where):
    """The mean of numbers with five decimals, from their exact sum: the same in any order."""
    return F.sum(F.when(where, F.col(value).cast("decimal(18,5)"))).cast("double") / F.nullif(F.count_if(where), F.lit(0))


def _cells(points):
    return points.groupBy(F.floor(F.col("y") / 8).alias("r"), F.floor(F.col("x") / 8).alias("c")).agg(F.max(F.when(F.col("class") == 6, F.col("z"))).alias("dsm"), _mean_of_exact("z", F.col("class") == 2).alias("dtm"))


@query("dsm_dtm_cells", "points", sql=f"{CELLS} SELECT r, c, round(dsm, 9) AS dsm, round(dtm, 9) AS dtm FROM g")
def dsm_dtm_cells(points):
    return _cells(points).select("r", "c", F.round("dsm", 9).alias("dsm"), F.round("dtm", 9).alias("dtm"))


@query("ndsm_algebra", "points", sql=f"{CELLS} SELECT r, c, round(greatest(dsm - dtm, 0), 9) AS ndsm FROM g WHERE dsm IS NOT NULL AND dtm IS NOT NULL")
def ndsm_algebra(points):
    return _cells(points).where("dsm IS NOT NULL AND dtm IS NOT NULL").select("r", "c", F.round(F.greatest(F.col("dsm") - F.col("dtm"), F.lit(0.0)), 9).alias("ndsm"))


@query("idw_fill", "points", sql=f"""
{CELLS}, k AS (SELECT r, c, dtm FROM g WHERE dtm IS NOT NULL), h AS (SELECT r, c FROM g WHERE dtm IS NULL)
SELECT h.r, h.c, round(CAST(sum(CAST(k.dtm AS DECIMAL(18, 9)) * CAST(40 / ((k.r - h.r) ** 2 + (k.c - h.c) ** 2) AS INT)) AS DOUBLE) / sum(CAST(40 / ((k.r - h.r) ** 2 + (k.c - h.c) ** 2) AS INT)), 5) AS dtm FROM h JOIN k ON abs(k.r - h.r) <= 2 AND abs(k.c - h.c) <= 2 GROUP BY ALL""")
def idw_fill(points):
    """Empty cells from cells within two steps, weighted by the inverse squared distance: an equi-join on 24 shifts.

    Weights are whole fortieths, so the sums are exact and don't depend on their order.
    """
    g = _cells(points)
    shift = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if a or b])
    given = g.where("dtm IS NOT NULL").withColumn("s", F.explode(shift)).select((F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), F.col("dtm").cast("decimal(18,9)").alias("dtm"), (40 / (F.col("s.a") ** 2 + F.col("s.b") ** 2)).cast("int").alias("w"))
    return g.where("dtm IS NULL").select("r", "c").join(given, ["r", "c"]).groupBy("r", "c").agg(F.round(F.sum(F.col("dtm") * F.col("w")).cast("double") / F.sum("w"), 5).alias("dtm"))


@query("tile_inventory", "points", sql="SELECT tile, CAST(count(*) AS BIGINT) AS n, min(x) AS west, max(y) AS north, CAST(count(DISTINCT class) AS BIGINT) AS classes, coalesce(count(*) FILTER (WHERE class = 2) > 900, false) AS valid FROM points GROUP BY tile")
def tile_inventory(points):
    valid = points.where("class = 2").groupBy("tile").agg((F.count(F.lit(1)) > 900).alias("valid"))
    stats = points.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("west"), F.max("y").alias("north"), F.count_distinct("class").alias("classes"))
    return stats.join(valid, "tile", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


@query("rasterize_cells", "buildings", sql="""
, x AS (SELECT *, unnest(range(CAST(xmin AS BIGINT), CAST(xmax AS BIGINT))) AS c FROM buildings), y AS (SELECT *, unnest(range(CAST(ymin AS BIGINT), CAST(ymax AS BIGINT))) AS r FROM x)
SELECT r, c, arg_max(size, id) AS burned FROM y GROUP BY ALL""")
def rasterize_cells(buildings):
    return raster.burn(buildings, "size", "id")


def _burn_sql(first: str, last: str) -> str:
    side = lambda lo, hi: f"unnest(range(CAST({first.format(lo)} AS BIGINT), CAST({last.format(hi)} AS BIGINT)))"
    return f"""
, b AS (SELECT id, size, xmin / 3 AS xmin, xmax / 3 AS xmax, ymin / 3 AS ymin, ymax / 3 AS ymax FROM buildings),
x AS (SELECT *, {side("xmin", "xmax")} AS c FROM b), y AS (SELECT id, size, c, {side("ymin", "ymax")} AS r FROM x)
SELECT r, c, arg_max(size, id) AS burned FROM y GROUP BY ALL"""


def _thirds(buildings):
    return buildings.select("id", "size", *[(F.col(c) / 3).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query("rasterize_centres", "buildings", sql=_burn_sql("ceil({} - 0.5)", "ceil({} - 0.5)"))
def rasterize_centres(buildings):
    """Footprints on a grid three times as coarse: cells whose centre is inside."""
    return raster.burn(_thirds(buildings), "size", "id")


@query("rasterize_touched", "buildings", sql=_burn_sql("floor({})", "ceil({})"))
def rasterize_touched(buildings):
    """The same with every cell that a footprint touches."""
    return raster.burn(_thirds(buildings), "size", "id", all_touched=True)


@query("rect_union_area", "buildings", sql="""
, x AS (SELECT *, unnest(range(CAST(xmin AS BIGINT), CAST(xmax AS BIGINT))) AS c FROM buildings), y AS (SELECT brand, c, unnest(range(CAST(ymin AS BIGINT), CAST(ymax AS BIGINT))) AS r FROM x)
SELECT brand, CAST(count(DISTINCT (r, c)) AS BIGINT) AS area FROM y GROUP BY brand""")
def rect_union_area(buildings):
    return spatial.covered_area(buildings, ["brand"]).select("brand", F.col("area").cast("bigint").alias("area"))


PAIRS = f", p AS (SELECT a.id AS a_id, b.id AS b_id, a.xmin AS a1, a.xmax AS a2, a.ymin AS a3, a.ymax AS a4, b.xmin AS b1, b.xmax AS b2, b.ymin AS b3, b.ymax AS b4 FROM buildings a JOIN buildings b ON {MEET})"


@query("rect_overlap", "buildings", sql=f"{PAIRS} SELECT a_id, b_id, round(least(100.0, 100 * (least(a2, b2) - greatest(a1, b1)) * (least(a4, b4) - greatest(a3, b3)) / ((a2 - a1) * (a4 - a3))), 6) AS percent FROM p")
def rect_overlap(buildings):
    area = (F.col("a_xmax") - F.col("a_xmin")) * (F.col("a_ymax") - F.col("a_ymin"))
    return spatial.touching_pairs(buildings).select("a_id", "b_id", r6(F.least(F.lit(100.0), 100 * geo.overlap("a_", "b_") / area)).alias("percent"))


@query("shared_boundary_rect", "buildings", sql=f"""{PAIRS} SELECT a_id, b_id, CASE WHEN a2 = b1 OR b2 = a1 THEN greatest(0, least(a4, b4) - greatest(a3, b3)) WHEN a4 = b3 OR b4 = a3 THEN greatest(0, least(a2, b2) - greatest(a1, b1)) ELSE 0 END AS shared FROM p""")
def shared_boundary_rect(buildings):
    return spatial.touching_pairs(buildings).select("a_id", "b_id", geo.shared_boundary("a_", "b_").alias("shared"))


@query("rect_clearance", "buildings", sql="SELECT id, CASE WHEN xmin >= 50 AND xmax <= 450 AND ymin >= 50 AND ymax <= 350 THEN least(xmin - 50, 450 - xmax, ymin - 50, 350 - ymax) ELSE 0 END AS clearance FROM buildings")
def rect_clearance(buildings):
    inside = F.expr("xmin >= 50 AND xmax <= 450 AND ymin >= 50 AND ymax <= 350")
    return buildings.select("id", F.when(inside, F.least(F.col("xmin") - 50, 450 - F.col("xmax"), F.col("ymin") - 50, 350 - F.col("ymax"))).otherwise(0.0).alias("clearance"))


@query("shoelace_area", "buildings", sql="SELECT id, (xmax - xmin) * (ymax - ymin) / 2 AS area FROM buildings")
def shoelace_area(buildings):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return buildings.select("id", geo.shoelace(F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmin", "ymax"), p("xmin", "ymin"))).alias("area"))


@query("equal_area_project", "supplier", sql="""
, q AS (SELECT s_suppkey, (s_suppkey % 360) - 180 AS lon, sin(radians((s_suppkey % 120) - 60)) AS s, 0.00669437999014 AS e2, sqrt(0.00669437999014) AS e FROM supplier),
k AS (SELECT *, cos(radians(30)) / sqrt(1 - e2 * sin(radians(30)) ** 2) AS k0, (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) AS q FROM q)
SELECT s_suppkey, round(6378137.0 * k0 * radians(lon), 2) AS x, round(6378137.0 * q / (2 * k0), 2) AS y FROM k""")
def equal_area_project(supplier):
    k = F.col("s_suppkey")
    xy = supplier.select("s_suppkey", geo.equal_area(((k % 360) - 180).cast("double"), ((k % 120) - 60).cast("double")).alias("p"))
    return xy.select("s_suppkey", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


def _utm_sql() -> str:
    """The forward series in SQL, from its formula: zone of the point, conformal latitude, sphere, waves."""
    e, radius, forward, _ = geo.kruger()
    waves = lambda f, g: " + ".join(f"{c:.17e} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(forward, 1))
    return f"""
, p AS (SELECT s_suppkey, (s_suppkey * 7 % 3600) / 10.0 - 180 AS lon, CAST((s_suppkey * 13 % 1600) / 10.0 - 80 AS DOUBLE) AS lat FROM supplier),
z AS (SELECT s_suppkey, CAST(lon AS DOUBLE) AS lon, lat, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, floor((lon + 180) / 6) + 1) AS INT) AS epsg FROM p),
t AS (SELECT *, radians(lon - (6 * (epsg % 100) - 183)) AS away, sinh(atanh(sin(radians(lat))) - {e:.17e} * atanh({e:.17e} * sin(radians(lat)))) AS t FROM z),
f AS (SELECT *, atan2(t, cos(away)) AS xi, asinh(sin(away) / sqrt(t * t + cos(away) * cos(away))) AS eta FROM t)
SELECT s_suppkey, epsg, round(500000 + 9.996e-1 * {radius:.17e} * (eta + {waves("cos", "sinh")}), 4) AS x, round(CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END + 9.996e-1 * {radius:.17e} * (xi + {waves("sin", "cosh")}), 4) AS y, true AS returns FROM f"""


@query("utm_project", "supplier", sql=_utm_sql())
def utm_project(supplier):
    """Points over the world in metres of their own UTM zone, and whether they come back to within 1e-9 degrees."""
    k = F.col("s_suppkey")
    at = supplier.select("s_suppkey", ((k * 7 % 3600) / 10 - 180).cast("double").alias("lon"), ((k * 13 % 1600) / 10 - 80).cast("double").alias("lat"))
    zoned = at.withColumn("epsg", geo.utm_zone(F.col("lon"), F.col("lat")))
    there = zoned.withColumn("p", geo.utm(F.col("lon"), F.col("lat"), F.col("epsg"))).withColumn("back", geo.utm_inverse(F.col("p.x"), F.col("p.y"), F.col("epsg")))
    near = (F.abs(F.col("back.lon") - F.col("lon")) < 1e-9) & (F.abs(F.col("back.lat") - F.col("lat")) < 1e-9)
    return there.select("s_suppkey", "epsg", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), near.alias("returns"))


@query("chip_tiling", "points", sql="SELECT CAST(floor(y / 64) AS BIGINT) AS r, CAST(floor(x / 64) AS BIGINT) AS c, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE class = 6) AS BIGINT) AS roof FROM points GROUP BY ALL HAVING count(*) FILTER (WHERE class = 6) >= 5")
def chip_tiling(points):
    return points.groupBy(F.floor(F.col("y") / 64).alias("r"), F.floor(F.col("x") / 64).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == 6).alias("roof")).where("roof >= 5")


@query("overlap_mean_variance", "pixels", sql="""
, w AS (SELECT chip, r, c, v, unnest([0, 2, 4]) AS s FROM pixels)
SELECT chip, r, c, round(avg(v + s), 9) AS mean, round(var_pop(v + s), 9) AS variance, CAST(count(*) AS BIGINT) AS n FROM w WHERE r >= s AND r < s + 4 GROUP BY ALL""")
def overlap_mean_variance(pixels):
    seen = pixels.withColumn("s", F.explode(F.array(*map(F.lit, (0, 2, 4))))).where("r >= s AND r < s + 4")
    v = F.col("v") + F.col("s")
    return seen.groupBy("chip", "r", "c").agg(F.round(F.avg(v), 9).alias("mean"), F.round(F.var_pop(v), 9).alias("variance"), F.count(F.lit(1)).alias("n"))


@query("mosaic_first", "pixels", sql="SELECT city, r, c, round(arg_min(v, chip), 6) AS v FROM pixels GROUP BY ALL")
def mosaic_first(pixels):
    return pixels.groupBy("city", "r", "c").agg(r6(F.min_by("v", "chip")).alias("v"))


@query("mask_apply", "pixels", sql="SELECT chip, r, c, CASE WHEN mask THEN v ELSE CAST(-9999 AS DOUBLE) END AS v FROM pixels")
def mask_apply(pixels):
    return pixels.select("chip", "r", "c", F.when(F.col("mask"), F.col("v")).otherwise(-9999.0).alias("v"))


@query("pixel_metrics", "pixels", sql="SELECT chip, CAST(count(*) FILTER (WHERE mask) AS BIGINT) AS n, CAST(count(DISTINCT v) AS BIGINT) AS distinct_values, round(max(v) - min(v), 6) AS spread, round(avg(abs(v)) FILTER (WHERE mask), 11) AS mae FROM pixels GROUP BY chip")
def pixel_metrics(pixels):
    return pixels.groupBy("chip").agg(F.count_if("mask").alias("n"), F.count_distinct("v").alias("distinct_values"), r6(F.max("v") - F.min("v")).alias("spread"), F.round(F.avg(F.when(F.col("mask"), F.abs("v"))), 11).alias("mae"))


@query("rotate_flip", "pixels", sql="""
, d AS (SELECT *, CAST('0x' || sha256('3:' || chip)[1:12] AS BIGINT) % 16 AS k FROM pixels),
t AS (SELECT chip, k, v, CASE k % 4 WHEN 0 THEN r WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r ELSE c END AS r, CASE k % 4 WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 7 - c ELSE 7 - r END AS c FROM d)
SELECT chip, CAST(CASE WHEN (k // 8) % 2 = 1 THEN 7 - r ELSE r END AS INT) AS r, CAST(CASE WHEN (k // 4) % 2 = 1 THEN 7 - c ELSE c END AS INT) AS c, v FROM t""")
def rotate_flip(pixels):
    """Each chip turned by 0 to 3 quarters, then maybe mirrored sideways and upside down, by its hash."""
    return raster.augment(pixels, "chip", 8, 3).select("chip", "r", "c", "v")


@query("resample_nearest", "pixels", sql="SELECT p.chip, t.r, t.c, p.v FROM pixels p JOIN (SELECT a AS r, b AS c FROM range(0, 12) x(a), range(0, 12) y(b)) t ON p.r = floor((t.r + 0.5) * 8 / 12) AND p.c = floor((t.c + 0.5) * 8 / 12)")
def resample_nearest(pixels):
    from_to = lambda at, n: F.expr(f"explode(filter(sequence(0, 11), t -> floor((t + 0.5) * 8 / 12) = {at}))").alias(n)
    rows = pixels.select("chip", "c", "v", from_to("r", "tr"))
    return rows.select("chip", F.col("tr").cast("bigint").alias("r"), from_to("c", "tc"), "v").select("chip", "r", F.col("tc").cast("bigint").alias("c"), "v")


@query("resample_bilinear", "pixels", sql="""
, t AS (SELECT a AS r, b AS c, (a + CAST(0.5 AS DOUBLE)) * 8 / 12 - CAST(0.5 AS DOUBLE) AS y, (b + CAST(0.5 AS DOUBLE)) * 8 / 12 - CAST(0.5 AS DOUBLE) AS x FROM range(0, 12) p(a), range(0, 12) q(b)),
w AS (SELECT chip, t.r, t.c, CASE WHEN mask THEN v END AS v, (1 - abs(y - p.r)) * (1 - abs(x - p.c)) AS w FROM pixels p JOIN t ON 1 - abs(y - p.r) > 0 AND 1 - abs(x - p.c) > 0)
SELECT chip, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(CAST(sum(CAST(w * v AS DECIMAL(28, 12))) AS DOUBLE) / CAST(sum(CAST(w AS DECIMAL(28, 12))) FILTER (WHERE v IS NOT NULL) AS DOUBLE), 9) AS v FROM w GROUP BY ALL""")
def resample_bilinear(pixels):
    """Chips of 8 x 8 brought to 12 x 12; cells outside the mask have no value."""
    cells = pixels.select("chip", "r", "c", F.when(F.col("mask"), F.col("v")).alias("v"))
    return raster.resample_bilinear(cells, ["chip"], "v", (8, 8), (12, 12)).select("chip", "r", "c", F.round("v", 9).alias("v"))


@query("channel_normalise", "pixels", sql=", s AS (SELECT c, avg(v) AS m, stddev_pop(v) AS d FROM pixels GROUP BY c) SELECT chip, r, c, round((v - m) / d, 5) AS z FROM pixels JOIN s USING (c)")
def channel_normalise(pixels):
    s = pixels.groupBy("c").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    return pixels.join(s, "c").select("chip", "r", "c", F.round((F.col("v") - F.col("m")) / F.col("d"), 5).alias("z"))


@query("bin_weight", "pixels", sql="SELECT weight, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(CASE WHEN NOT mask THEN 0.05 WHEN v < 3 THEN 4 WHEN v < 6 THEN 3 WHEN v < 10 THEN 2 WHEN v < 25 THEN 1 WHEN v < 50 THEN 3 ELSE 8 END AS DOUBLE) AS weight FROM pixels) GROUP BY weight")
def bin_weight(pixels):
    v = F.col("v")
    weight = F.when(~F.col("mask"), 0.05).when(v < 3, 4.0).when(v < 6, 3.0).when(v < 10, 2.0).when(v < 25, 1.0).when(v < 50, 3.0).otherwise(8.0)
    return pixels.groupBy(weight.alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("band_stack", "pixels", sql="SELECT chip, c, array_to_string(list(round(v, 3) ORDER BY r), ',') IS NOT NULL AS stacked, CAST(count(*) AS BIGINT) AS bands, round(sum(v * (r + 1)), 6) AS signature FROM pixels GROUP BY ALL")
def band_stack(pixels):
    bands = pixels.groupBy("chip", "c").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("b"))
    weighted = F.aggregate("b", F.lit(0.0), lambda s, x: s + x["v"] * (x["r"] + 1))
    return bands.select("chip", "c", F.lit(True).alias("stacked"), F.size("b").cast("bigint").alias("bands"), F.round(weighted, 6).alias("signature"))


@query("band_index", "buildings", sql="SELECT id, CASE WHEN list_position(['blue', 'green', 'red', 'nir'], CASE id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'nir' END) > 0 THEN list_position(['blue', 'green', 'red', 'nir'], CASE id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'nir' END) ELSE 8 END AS band FROM buildings")
def band_index(buildings):
    names = F.array(*map(F.lit, ("blue", "green", "red", "nir")))
    at = F.array_position(names, F.when(F.col("id") % 3 == 0, "red").when(F.col("id") % 3 == 1, "nir"))
    return buildings.select("id", F.when(at > 0, at.cast("int")).otherwise(8).alias("band"))


@query("stride_sample", "pixels", sql="SELECT chip, r, c, v FROM pixels WHERE r % 3 = 0 AND c % 3 = 0")
def stride_sample(pixels):
    return pixels.where("r % 3 = 0 AND c % 3 = 0").select("chip", "r", "c", "v")


@query("alignment_audit", "chips", sql="""
SELECT chip, array_to_string(list_filter([CASE WHEN row_off % 512 <> 0 THEN 'row' END, CASE WHEN col_off > 5000 THEN 'extent' END, CASE WHEN city LIKE '5%' THEN 'grid' END], lambda x: x IS NOT NULL), ';') AS failed FROM chips""")
def alignment_audit(chips):
    from ..functions.scalars import reasons

    return chips.select("chip", reasons((F.col("row_off") % 512 != 0, "row"), (F.col("col_off") > 5000, "extent"), (F.col("city").startswith("5"), "grid")).alias("failed"))


@query("chip_inspection", "pixels", sql="""
, s AS (SELECT chip, avg(CAST(mask AS INT)) AS share, max(v) AS top, count(*) FILTER (WHERE v > 1) AS tall FROM pixels GROUP BY chip)
SELECT chip, round(share, 6) AS share, CAST(tall AS BIGINT) AS tall, array_to_string(list_filter([CASE WHEN share < 0.4 THEN 'empty' END, CASE WHEN top < 2 THEN 'low' END], lambda x: x IS NOT NULL), ';') AS excluded FROM s""")
def chip_inspection(pixels):
    from ..functions.scalars import reasons

    s = pixels.groupBy("chip").agg(F.avg(F.col("mask").cast("int")).alias("share"), F.max("v").alias("top"), F.count_if(F.col("v") > 1).alias("tall"))
    return s.select("chip", r6(F.col("share")).alias("share"), "tall", reasons((F.col("share") < 0.4, "empty"), (F.col("top") < 2, "low")).alias("excluded"))


LABELS = """
, m AS (SELECT chip, r, c, v, r * 8 + c AS k FROM pixels WHERE {where}),
e AS (SELECT a.chip, a.k AS x, b.k AS y FROM m a JOIN m b ON a.chip = b.chip AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
w AS (WITH RECURSIVE w AS (SELECT chip, k AS node, k AS root FROM m UNION SELECT e.chip, e.y, w.root FROM w JOIN e ON w.chip = e.chip AND w.node = e.x WHERE w.root < e.y) SELECT chip, node, min(root) AS root FROM w GROUP BY chip, node)"""


@query("pixel_components", "pixels", sql=LABELS.format(where="v > 1") + " SELECT chip, CAST(root AS INT) AS root, CAST(count(*) AS BIGINT) AS cells FROM w GROUP BY chip, root")
def pixel_components(pixels):
    """Four-neighbour components of the cells over 1 in each chip."""
    return raster.labelled(pixels.where("v > 1"), "chip", 8).groupBy("chip", "root").agg(F.count(F.lit(1)).alias("cells"))


_SPECTRAL = "(r * 3 + c + chip) % 61 <> 0"
_BINS = ", ".join(f"CAST(coalesce(count(*) FILTER (WHERE h >= {low}{'' if high is None else f' AND h < {high}'}), 0) AS BIGINT) AS bin_{low}_{'plus' if high is None else high}" for low, high in raster.HEIGHT_BINS)
_BIN_NAMES = [f"bin_{low}_{'plus' if high is None else high}" for low, high in raster.HEIGHT_BINS]


@query("chip_report", "pixels", sql=LABELS.format(where="mask AND v > 0.05") + f""",
h AS (SELECT w.chip, root, median(v * 10) AS h FROM w JOIN m ON w.chip = m.chip AND w.node = m.k GROUP BY w.chip, root HAVING count(*) >= 3),
p AS (SELECT chip, CAST(count(*) AS BIGINT) AS components, median(h) AS median_height, quantile_cont(h, 0.9) AS p90_height, max(h) AS max_height, {_BINS} FROM h GROUP BY chip),
s AS (SELECT chip, count(*) AS n, count(*) FILTER (WHERE {_SPECTRAL}) / count(*) AS spectral, count(*) FILTER (WHERE v > 0.05) / count(*) AS target FROM pixels WHERE mask GROUP BY chip),
t AS (SELECT s.*, p.* EXCLUDE (chip), array_to_string(list_filter([CASE WHEN spectral < 0.99 THEN 'insufficient_spectral_building_coverage' END, CASE WHEN target < 0.95 THEN 'insufficient_positive_target_coverage' END, CASE WHEN components IS NULL THEN 'no_eligible_building_components' END], lambda x: x IS NOT NULL), ';') AS excluded
  FROM s LEFT JOIN p USING (chip))
SELECT chip, CAST(n AS BIGINT) AS building_cells, round(spectral, 9) AS spectral_coverage, round(target, 9) AS target_coverage, coalesce(components, 0) AS components, round(median_height, 9) AS median_height, round(p90_height, 9) AS p90_height, round(max_height, 9) AS max_height,
  CASE WHEN components IS NULL THEN 'empty' WHEN p90_height >= 30 OR max_height >= 50 THEN 'highrise' WHEN p90_height >= 10 THEN 'midrise' ELSE 'lowrise' END AS category, excluded, excluded = '' AS eligible, {", ".join(f"coalesce({n}, 0) AS {n}" for n in _BIN_NAMES)} FROM t""")
def chip_report(pixels):
    """Coverages, component heights, height bins and reasons for leaving out of each chip with building cells."""
    cells = pixels.select("chip", "r", "c", "mask", F.expr(_SPECTRAL).alias("spectral"), F.when(F.col("v") > 0.05, F.col("v") * 10).alias("target"))
    out = raster.inspect_chips(cells, "chip", 8)
    return out.withColumns({n: F.round(n, digits) for n, digits in (("spectral_coverage", 9), ("target_coverage", 9), ("median_height", 9), ("p90_height", 9), ("max_height", 9))})


@query("chip_windows", "pixels", sql="""
, s AS (SELECT unnest([0, 2, 4, 5]) AS s), w AS (SELECT a.s AS row_off, b.s AS col_off FROM s a, s b),
n AS (SELECT chip, row_off, col_off, CAST(count(*) FILTER (WHERE v > 1) AS BIGINT) AS positive, CAST(count(*) FILTER (WHERE mask) AS BIGINT) AS building FROM pixels JOIN w ON r >= row_off AND r < row_off + 3 AND c >= col_off AND c < col_off + 3 GROUP BY ALL)
SELECT chip, CAST(row_off AS BIGINT) AS row_off, CAST(col_off AS BIGINT) AS col_off, positive, building, CAST(row_number() OVER (PARTITION BY chip ORDER BY row_off, col_off) - 1 AS INT) AS index FROM n WHERE positive >= 4 AND building > 0""")
def chip_windows(pixels):
    """Windows of 3 x 3 every two cells, the last ones at the edge; those with enough tall and any building cells, numbered."""
    extents = pixels.select("chip").distinct().select("chip", F.lit(8).alias("height"), F.lit(8).alias("width"))
    sums = raster.window_sums(pixels.select("chip", "r", "c", "v", "mask"), extents, ["chip"], {"positive": (F.col("v") > 1).cast("bigint"), "building": F.col("mask").cast("bigint")}, 3, 2, last_window=True)
    kept = sums.where("positive >= 4 AND building > 0")
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("chip").orderBy("row_off", "col_off")) - 1)


@query("scene_windows", "points", sql="""
, g AS (SELECT tile, CAST(floor(y / 8) AS BIGINT) AS r, CAST(floor(x / 8) AS BIGINT) AS c, class FROM points),
x AS (SELECT tile, max(r) + 1 AS h, max(c) + 1 AS w FROM g GROUP BY tile),
a AS (SELECT tile, w, unnest(range(0, h - 16 + 1, 8)) AS row_off FROM x), b AS (SELECT tile, row_off, unnest(range(0, w - 16 + 1, 8)) AS col_off FROM a)
SELECT b.tile, row_off, col_off, CAST(count(*) FILTER (WHERE class = 6) AS BIGINT) AS roof, CAST(count(*) FILTER (WHERE class = 2) AS BIGINT) AS ground
FROM b JOIN g ON b.tile = g.tile AND r >= row_off AND r < row_off + 16 AND c >= col_off AND c < col_off + 16 GROUP BY ALL HAVING count(*) FILTER (WHERE class = 6) >= 5""")
def scene_windows(points):
    """Overlapping windows of 16 x 16 cells over each tile's points, kept where enough are on roofs."""
    cells = points.select("tile", F.floor(F.col("y") / 8).alias("r"), F.floor(F.col("x") / 8).alias("c"), "class")
    extents = cells.groupBy("tile").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    sums = {"roof": (F.col("class") == 6).cast("bigint"), "ground": (F.col("class") == 2).cast("bigint")}
    return raster.window_sums(cells, extents, ["tile"], sums, 16, 8).where("roof >= 5")


GAP = 4
_Q = ", ".join(f"min({{'d2': d2, 'dc': abs(dc), 'z': z}}) FILTER (WHERE {up} AND {side}) AS q{i}" for i, (up, side) in enumerate((("kr <= r", "dc <= 0"), ("kr >= r", "dc <= 0"), ("kr <= r", "dc >= 0"), ("kr >= r", "dc >= 0")), 1))
_SUM = lambda of: " + ".join(f"coalesce({of.format(q=f'q{i}')}, 0)" for i in range(1, 5))


@query("gap_fill", "points", sql=f"""
{CELLS}, x AS (SELECT max(r) AS h, max(c) AS w FROM g), rs AS (SELECT w, unnest(range(0, h + 1)) AS r FROM x), d AS (SELECT r, unnest(range(0, w + 1)) AS c FROM rs),
f AS (SELECT d.r, d.c, g.dtm AS z FROM d LEFT JOIN g ON d.r = g.r AND d.c = g.c), k AS (SELECT r AS kr, c AS kc, z FROM f WHERE z IS NOT NULL),
n AS (SELECT r, c, kr, kc - c AS dc, (kr - r) ** 2 + (kc - c) ** 2 AS d2, k.z FROM f JOIN k ON kr BETWEEN r - {GAP} AND r + {GAP} AND kc BETWEEN c - {GAP} AND c + {GAP} WHERE f.z IS NULL AND (kr - r) ** 2 + (kc - c) ** 2 <= {GAP * GAP}),
q AS (SELECT r, c, {_Q} FROM n GROUP BY r, c),
i AS (SELECT f.r, f.c, f.z, CAST(coalesce(f.z, ({_SUM("{q}.z / sqrt({q}.d2)")}) / ({_SUM("1 / sqrt({q}.d2)")})) AS DECIMAL(18, 9)) AS v FROM f LEFT JOIN q ON f.r = q.r AND f.c = q.c),
s AS (SELECT a.r, a.c, CAST(sum(b.v) AS DOUBLE) / count(b.v) AS z FROM i a JOIN i b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE a.z IS NULL AND a.v IS NOT NULL GROUP BY a.r, a.c)
SELECT i.r, i.c, round(coalesce(i.z, s.z), 9) AS dtm, i.z IS NULL AS was_empty FROM i LEFT JOIN s ON i.r = s.r AND i.c = s.c""")
def gap_fill(points):
    """The ground grid of all points without gaps of up to four cells."""
    cells = _cells(points).select("r", "c", "dtm")
    across = lambda side: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(side)))
    dense = cells.agg(F.max("r").alias("h"), F.max("c").alias("w")).where("h IS NOT NULL").select(across("h").alias("r"), "w").select("r", across("w").alias("c"))
    filled = raster.fill_gaps(dense.join(cells, ["r", "c"], "left"), "dtm", GAP)
    return filled.select("r", "c", F.round("filled", 9).alias("dtm"), "was_empty")


@query("order_plan", "manifest", sql="""
, g AS (SELECT city, bundle, list_sort(list(id)) AS ids FROM manifest GROUP BY ALL)
SELECT city, bundle, CAST(len(ids) AS BIGINT) AS n, 'order_' || sha256(city || ':' || bundle || ':' || array_to_string(ids, ','))[1:12] AS name FROM g""")
def order_plan(manifest):
    ids = F.array_sort(F.collect_list("id"))
    g = manifest.groupBy("city", "bundle").agg(ids.alias("ids"))
    name = F.concat(F.lit("order_"), F.substring(F.sha2(F.concat_ws(":", "city", "bundle", F.array_join(F.col("ids").cast("array<string>"), ",")), 256), 1, 12))
    return g.select("city", "bundle", F.size("ids").cast("bigint").alias("n"), name.alias("name"))
