"""Footprints with corners, hollows and holes: burning, points inside, coverage, shared walls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import polygons, spatial
from .registry import query

#: Rings of five kinds of footprints, in parts of their box: an L, a frame, a diamond, a hollow triangle and a U.
SHAPES = (
    [[(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0)]],
    [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)]],
    [[(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5), (0.5, 0)]],
    [[(0, 0), (1, 0), (0, 1), (0, 0)], [(0.125, 0.125), (0.5, 0.125), (0.125, 0.5), (0.125, 0.125)]],
    [[(0, 0), (1, 0), (1, 1), (0.75, 1), (0.75, 0.25), (0.25, 0.25), (0.25, 1), (0, 1), (0, 0)]],
)
_ROWS = ", ".join(f"({k}, {i}, {j}, {float(x)!r}, {float(y)!r})" for k, rings in enumerate(SHAPES) for i, ring in enumerate(rings) for j, (x, y) in enumerate(ring))
#: Corners and edges of the footprints in cells of three quarters.
EDGES = f"""
, f(kind, ring, seq, fx, fy) AS (SELECT kind, ring, seq, CAST(fx AS DOUBLE), CAST(fy AS DOUBLE) FROM (VALUES {_ROWS}) AS t(kind, ring, seq, fx, fy)),
v AS (SELECT id, size, ring, seq, (xmin + fx * (xmax - xmin)) * 4 / 3 AS x, (ymin + fy * (ymax - ymin)) * 4 / 3 AS y FROM buildings JOIN f ON kind = id % 5),
e AS (SELECT a.id, a.size, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.id = b.id AND a.ring = b.ring AND b.seq = a.seq + 1),
box AS (SELECT id, size, CAST(floor(min(x)) AS BIGINT) AS c1, CAST(ceil(max(x)) AS BIGINT) AS c2, CAST(floor(min(y)) AS BIGINT) AS r1, CAST(ceil(max(y)) AS BIGINT) AS r2 FROM v GROUP BY id, size),
col AS (SELECT *, unnest(range(c1, c2)) AS c FROM box), cell AS (SELECT id, size, c, unnest(range(r1, r2)) AS r FROM col),
inside AS (
  SELECT cell.id, cell.size, r, c FROM cell JOIN e ON cell.id = e.id
  WHERE (y1 > r + 0.5) <> (y2 > r + 0.5) AND c + 0.5 < x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) GROUP BY cell.id, cell.size, r, c HAVING count(*) % 2 = 1)"""


def footprints(buildings, scale: float = 4.0, per: float = 3.0):
    """Buildings with their rings, by default in cells of three quarters."""
    at = lambda lo, hi, part: (F.col(lo) + F.lit(float(part)) * (F.col(hi) - F.col(lo))) * scale / per
    shape = lambda rings: F.array(*[F.array(*[F.struct(at("xmin", "xmax", x).alias("x"), at("ymin", "ymax", y).alias("y")) for x, y in ring]) for ring in rings])
    rings = F.when(F.col("id") % 5 == 0, shape(SHAPES[0]))
    for kind, of in enumerate(SHAPES[1:], 1):
        rings = rings.when(F.col("id") % 5 == kind, shape(of))
    return buildings.withColumn("rings", rings)


@query("burn_polygons", "buildings", sql=f"{EDGES} SELECT r, c, arg_max(size, id) AS burned FROM inside GROUP BY r, c")
def burn_polygons(buildings):
    """Sizes on the cells whose centres are inside a footprint, the last one over the others."""
    return polygons.burn(footprints(buildings), "size", "id")


@query("burn_polygons_touched", "buildings", sql=f"""{EDGES},
y AS (SELECT cell.*, x1, y1, x2, y2, greatest(least(y1, y2), r) AS ya, least(greatest(y1, y2), r + 1) AS yb FROM cell JOIN e ON cell.id = e.id),
p AS (SELECT *, CASE WHEN y1 = y2 THEN least(x1, x2) ELSE greatest(least(x1, x2), least(greatest(x1, x2), x1 + (ya - y1) * (x2 - x1) / (y2 - y1))) END AS xa, CASE WHEN y1 = y2 THEN greatest(x1, x2) ELSE greatest(least(x1, x2), least(greatest(x1, x2), x1 + (yb - y1) * (x2 - x1) / (y2 - y1))) END AS xb
  FROM y WHERE ya < yb OR (y1 = y2 AND y1 > r AND y1 < r + 1)),
touched AS (SELECT id, size, r, c FROM p WHERE greatest(xa, xb) > c AND least(xa, xb) < c + 1 UNION SELECT * FROM inside)
SELECT r, c, arg_max(size, id) AS burned FROM touched GROUP BY r, c""")
def burn_polygons_touched(buildings):
    """The same on every cell that a footprint covers some of."""
    return polygons.burn(footprints(buildings), "size", "id", all_touched=True)


@query("polygon_cells", "buildings", sql=f"{EDGES} SELECT id, CAST(count(*) AS BIGINT) AS cells FROM inside GROUP BY id")
def polygon_cells(buildings):
    """Cells of each footprint, counted from its spans without a row a cell."""
    return polygons.spans(footprints(buildings), ["id"]).groupBy("id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("cells"))


@query("points_in_rings", "points", "buildings", sql=f"""{EDGES},
p AS (SELECT id, x * 4 / 3 AS x, y * 4 / 3 AS y, z, row_number() OVER () AS k FROM points JOIN buildings ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE class <> 7),
h AS (SELECT p.id, k, z FROM p JOIN e ON p.id = e.id WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY p.id, k, z HAVING count(*) % 2 = 1)
SELECT id, CAST(count(*) AS BIGINT) AS n, round(max(z), 6) AS top FROM h GROUP BY id""")
def points_in_rings(points, buildings):
    """Points inside each footprint and outside its holes.

    Boxes meet the points; rings, which follow from the boxes, are made for the pairs that met.
    """
    near = spatial.boxes_of_points(points.where("class <> 7").select("x", "y", "z"), buildings.select("id", "xmin", "ymin", "xmax", "ymax"))
    held = footprints(near).where(geo.inside_polygon(F.col("x") * 4 / 3, F.col("y") * 4 / 3, F.col("rings")))
    return held.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("z"), 6).alias("top"))


_MEET = "a.id < b.id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"
#: Area of the quarter of a diamond with half axes p and q that lies beyond u and v from its centre.
_CORNER = "p * q / 2 * greatest(0, 1 - greatest({}, 0) / p - greatest({}, 0) / q) ** 2"
_QUARTER = " + ".join(
    f"({_CORNER.format(u1, v1)}) - ({_CORNER.format(u2, v1)}) - ({_CORNER.format(u1, v2)}) + ({_CORNER.format(u2, v2)})" for u1, u2 in (("l", "r"), ("-r", "-l")) for v1, v2 in (("d", "u"), ("-u", "-d"))
)


@query("coverage_rotated", "buildings", sql=f"""
, m AS (SELECT a.id AS a_id, b.id AS b_id, (a.xmax - a.xmin) / 2 AS p, (a.ymax - a.ymin) / 2 AS q, b.xmin - (a.xmin + a.xmax) / 2 AS l, b.xmax - (a.xmin + a.xmax) / 2 AS r, b.ymin - (a.ymin + a.ymax) / 2 AS d, b.ymax - (a.ymin + a.ymax) / 2 AS u,
  (b.xmax - b.xmin) * (b.ymax - b.ymin) AS whole FROM buildings a JOIN buildings b ON {_MEET})
SELECT a_id, b_id, round(least(100, 100 * ({_QUARTER}) / whole), 7) AS percent FROM m""")
def coverage_rotated(buildings):
    """Per cent of each box that a neighbour's diamond covers."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    side = lambda p, n: F.col(f"{p}_{n}")
    middle = lambda p, axis: (side(p, axis + "min") + side(p, axis + "max")) / 2
    diamond = F.array(*[point(*at) for at in (
        (middle("a", "x"), side("a", "ymin")), (side("a", "xmax"), middle("a", "y")), (middle("a", "x"), side("a", "ymax")), (side("a", "xmin"), middle("a", "y")), (middle("a", "x"), side("a", "ymin")),
    )])
    box = F.array(*[point(side("b", x), side("b", y)) for x, y in (("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin"))])
    shaped = spatial.touching_pairs(buildings).select("a_id", "b_id", diamond.alias("ring"), box.alias("area"))
    return shaped.select("a_id", "b_id", F.round(geo.coverage_percent(F.col("ring"), F.col("area")), 7).alias("percent"))


@query("shared_walls", "buildings", sql=f"""{EDGES},
s AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l FROM e), border AS (SELECT id, sum(l) AS border FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, a.l, ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) / a.l AS o1, ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) / a.l AS o2,
  ((a.x2 - a.x1) * (b.x1 - a.x1) + (a.y2 - a.y1) * (b.y1 - a.y1)) / a.l AS t1, ((a.x2 - a.x1) * (b.x2 - a.x1) + (a.y2 - a.y1) * (b.y2 - a.y1)) / a.l AS t2
  FROM s a JOIN s b ON a.id < b.id AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 1e-6 AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 1e-6 AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 1e-6 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 1e-6),
w AS (SELECT a, b, sum(least(l, greatest(t1, t2)) - greatest(0, least(t1, t2))) AS shared FROM p WHERE abs(o1) < 1e-7 AND abs(o2) < 1e-7 AND least(l, greatest(t1, t2)) - greatest(0, least(t1, t2)) > 1e-7 GROUP BY a, b)
SELECT w.a, w.b, round(shared, 7) AS shared, round(shared / least(x.border, y.border), 7) AS ratio FROM w JOIN border x ON w.a = x.id JOIN border y ON w.b = y.id""")
def shared_walls(buildings):
    """Length and part of the border that any two footprints share."""
    return polygons.shared_walls(footprints(buildings)).select("a", "b", F.round("shared", 7).alias("shared"), F.round("ratio", 7).alias("ratio"))


@query("nearest_wall", "buildings", sql=f"""{EDGES},
c AS (SELECT id, (xmin + xmax) / 2 * 4 / 3 AS x, (ymin + ymax) / 2 * 4 / 3 AS y FROM buildings),
d AS (SELECT c.id, e.id AS o, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM c JOIN e ON c.id <> e.id)
SELECT id, round(sqrt(min((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)), 7) AS distance FROM d GROUP BY id""")
def nearest_wall(buildings):
    """Distance from the middle of each footprint to the nearest wall of another."""
    middle = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2 * 4 / 3
    centres = buildings.select("id", middle("xmin", "xmax").alias("x"), middle("ymin", "ymax").alias("y"))
    sides = polygons.edges(footprints(buildings).select("id", "rings"))
    return polygons.nearest_edges(centres, sides, 16.0).select("id", F.round("distance", 7).alias("distance"))


@query("clearance_rotated", "buildings", sql="""
, k AS (SELECT id, unnest([xmin, xmax, xmax, xmin]) AS x, unnest([ymin, ymin, ymax, ymax]) AS y FROM buildings)
SELECT id, round(greatest(0, min((1 - abs(x - 250) / 240 - abs(y - 200) / 190) * 240 * 190 / sqrt(240 * 240 + 190 * 190))), 7) AS clearance FROM k GROUP BY id""")
def clearance_rotated(buildings):
    """How far each box keeps from the border of a diamond-shaped scene that covers it; 0 for the others."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    scene = F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((250, 10), (490, 200), (250, 390), (10, 200), (250, 10))])
    box = F.array(*[point(F.col(x), F.col(y)) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))])
    return buildings.select("id", F.round(geo.clearance(box, scene), 7).alias("clearance"))
