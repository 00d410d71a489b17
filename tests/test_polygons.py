"""Polygons on grids and clipped polygons against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.functions import geo
from parapet.operators import polygons

RINGS = "id long, size int, rings array<array<struct<x: double, y: double>>>"


def odd(x, y, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            n += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return n % 2 == 1


def shapes():
    rng = random.Random(4)
    out = []
    for i in range(60):
        at = lambda: (rng.choice([rng.uniform(-5, 15), float(rng.randint(-5, 15)), rng.randint(-10, 30) / 2]), rng.choice([rng.uniform(-5, 15), rng.randint(-10, 30) / 2]))
        ring = [at() for _ in range(rng.randint(3, 9))]  # may cross itself
        rings = [ring + ring[:1]]
        if i % 3 == 0:
            hole = [at() for _ in range(3)]
            rings.append(hole + hole[:1])
        out.append((i, i % 7, rings))
    return [*out, (100, 1, []), (101, 1, None), (102, None, out[0][2]), (103, 2, [[(1.0, 1.0)]]), (104, 3, [[(0.0, 0.0), (4.0, 0.0), (0.0, 0.0)]])]


def test_burning_against_a_plain_burn(spark):
    rows = shapes()
    table = spark.createDataFrame(rows, RINGS)
    cells = [(r, c) for r in range(-8, 20) for c in range(-8, 20)]
    inside = {(i, r, c) for i, size, rings in rows for r, c in cells if rings and odd(c + 0.5, r + 0.5, rings)}
    assert {tuple(r) for r in polygons.cells_inside(table, ["id"]).collect()} == inside
    want = {}
    for i, size, _ in rows:
        if size is not None:
            want |= {(r, c): size for k, r, c in inside if k == i}
    assert {(r["r"], r["c"]): r["burned"] for r in polygons.burn(table, "size", "id").collect()} == want
    assert {(r["r"], r["c"]) for r in polygons.burn(table, "size", "id", all_touched=True).collect()} >= set(want)


def test_spans_grow_with_the_height_of_a_polygon_alone(spark):
    table = spark.createDataFrame([(1, 1, [[(0.0, 0.0), (1e9, 0.0), (1e9, 10.0), (0.0, 10.0), (0.0, 0.0)]])], RINGS)
    rows = polygons.spans(table, ["id"]).collect()
    assert [(r["first"], r["last"]) for r in rows] == [(0, 10**9 - 1)] * 10


def test_touched_cells_of_thin_and_aligned_shapes(spark):
    rings = {1: [(0.2, 0.2), (3.8, 0.4), (3.8, 0.45), (0.2, 0.2)], 2: [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)], 3: [(0.5, 0.5), (2.5, 2.5), (0.5, 2.5), (0.5, 0.5)]}
    for i, ring in rings.items():
        table = spark.createDataFrame([(i, i, [ring])], RINGS)
        got = {(r["r"], r["c"]) for r in polygons.burn(table, "size", "id", all_touched=True).collect()}
        assert got == {1: {(0, c) for c in range(4)}, 2: {(r, c) for r in (0, 1) for c in (0, 1)}, 3: {(r, c) for r in range(3) for c in range(r + 1)}}[i]


def test_coverage_of_touching_degenerate_hollow_and_turned_rings(spark):
    box = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    cases = [
        (box, box, 100.0),
        (box[::-1], box, 100.0),
        (box, box[::-1], 100.0),
        ([(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0), (2.0, 2.0)], box, 25.0),
        ([(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0), (4.0, 0.0)], box, 0.0),  # shares an edge
        ([(4.0, 4.0), (8.0, 4.0), (8.0, 8.0), (4.0, 4.0)], box, 0.0),  # shares a corner
        ([(9.0, 9.0), (10.0, 9.0), (9.0, 10.0), (9.0, 9.0)], box, 0.0),
        ([(-10.0, -10.0), (50.0, -10.0), (50.0, 50.0), (-10.0, 50.0), (-10.0, -10.0)], box, 100.0),
        ([(0.0, 0.0), (4.0, 4.0), (0.0, 0.0)], box, 0.0),  # no area
        ([(-2.0, 2.0), (2.0, -2.0), (6.0, 2.0), (2.0, 6.0), (-2.0, 2.0)], box, 100.0),
        ([(0.0, 2.0), (2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0)], box, 50.0),
        ([(-1.0, -1.0), (5.0, -1.0), (5.0, 1.0), (1.0, 1.0), (1.0, 3.0), (5.0, 3.0), (5.0, 5.0), (-1.0, 5.0), (-1.0, -1.0)], box, 62.5),  # a C that the box cuts into three arms
        (box, [(0.0, 0.0), (4.0, 4.0), (0.0, 0.0)], None),
        (None, box, None),
    ]
    moved = lambda ring, by: ring and [(x + by, y - by) for x, y in ring]
    rows = [(i, moved(a, by), moved(b, by)) for by in (0.0, 2.0**20) for i, (a, b, _) in enumerate(cases)]
    table = spark.createDataFrame(rows, "i int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    for r in table.select("i", geo.coverage_percent(F.col("a"), F.col("b")).alias("p")).collect():
        want = cases[r["i"]][2]
        assert (r["p"] is None) == (want is None) and (want is None or abs(r["p"] - want) < 1e-9), (r, want)


def test_coverage_against_counted_points(spark):
    """Random rings and random convex areas: the share of a fine grid of points in both."""
    import math

    rng = random.Random(9)
    rows = []
    for i in range(12):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 7)))
        area = [(5 + 4 * math.cos(t), 5 + 4 * math.sin(t)) for t in turns]
        ring = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]
        rows.append((i, ring + ring[:1], area + area[:1]))
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>").select("i", geo.coverage_percent(F.col("a"), F.col("b")).alias("p")).collect()}
    grid = [(x / 20 + 0.0123, y / 20 + 0.0077) for x in range(200) for y in range(200)]
    for i, a, b in rows:
        held = [p for p in grid if odd(*p, [b])]
        if len(held) > 2000:
            assert abs(got[i] - 100 * sum(odd(*p, [a]) for p in held) / len(held)) < 2


def closed(*points):
    return [[(float(x), float(y)) for x, y in (*points, points[0])]]


def test_shared_walls_of_triangles_hollow_and_turned_shapes(spark):
    c, s = 0.6, 0.8  # a turn
    turned = lambda points: [(100 + c * x - s * y, 50 + s * x + c * y) for x, y in points]
    ell, inner = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)], [(2, 2), (4, 2), (4, 4), (2, 4)]
    rows = [
        (1, closed(*ell)), (2, closed(*inner)),  # two walls of 2 in the hollow of an L
        (3, closed((4, 0), (8, 0), (4, 4))),  # along a wall of 2 of the L, and of 2 of the square
        (11, closed(*turned(ell))), (12, closed(*turned(inner))),
        (21, closed((200, 0), (300, 0), (300, 10), (200, 10))), (22, closed((210, 10), (290, 10), (290, 20), (210, 20))),  # many cells long
        (23, closed((200, -10), (230, -10), (230, 0), (200, 0))), (24, closed((230, -10), (250, -10), (250, 0), (230, 0))),
        (31, closed((400, 0), (401, 0), (401, 1), (400, 1))), (32, closed((401, 1), (402, 1), (402, 2), (401, 2))),  # one corner
        (41, closed((500, 0), (504, 0), (504, 4), (500, 4)) + closed((501, 1), (503, 1), (503, 3), (501, 3))), (42, closed((501, 1), (503, 1), (503, 3), (501, 3))),  # fills a hole
        (51, closed((600, 0), (610, 0), (605, 5))), (52, closed((600, 0), (608, 0), (602, 0), (610, 0), (605, -5))),  # a wall that goes forth and back counts once
    ]
    got = {(r["a"], r["b"]): (round(r["shared"], 6), round(r["ratio"], 6)) for r in polygons.shared_walls(spark.createDataFrame(rows, "id int, rings array<array<struct<x: double, y: double>>>")).collect()}
    lengths = {k: v[0] for k, v in got.items()}
    assert lengths == {(1, 2): 4.0, (1, 3): 2.0, (2, 3): 2.0, (11, 12): 4.0, (21, 22): 80.0, (21, 23): 30.0, (21, 24): 20.0, (23, 24): 10.0, (41, 42): 8.0, (51, 52): 10.0}
    assert got[1, 2][1] == 0.5 and got[41, 42][1] == 1.0


def test_nearest_edges_against_all_edges(spark):
    import math

    rng = random.Random(3)
    walls = [(i % 40, *(v := (rng.uniform(0, 300), rng.uniform(0, 200))), v[0] + rng.uniform(-9, 9), v[1] + rng.uniform(-9, 9)) for i in range(120)]
    walls += [(50, 32.0, 0.0, 32.0, 64.0), (51, 0.0, 48.0, 90.0, 48.0), (52, 7.0, 7.0, 7.0, 7.0)]  # along borders of cells, and a point
    points = [(i, rng.uniform(-50, 350), rng.uniform(-50, 250)) for i in range(150) if i != 50] + [(200, 5000.0, -3000.0), (201, 32.0, 48.0), (50, 32.0, 20.0)]

    def away(x, y, w):
        _, x1, y1, x2, y2 = w
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0
        return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

    want = {i: min(away(x, y, w) for w in walls if w[0] != i) for i, x, y in points}
    table, sides = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(walls, "id int, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: r for r in polygons.nearest_edges(table, sides, 16.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[i]["distance"] - d) < 1e-9 for i, d in want.items())
    assert all(abs(min(away(x, y, w) for w in walls if w[0] == got[i]["nearest"]) - want[i]) < 1e-9 for i, x, y in points)
    alone = polygons.nearest_edges(table.where("id = 50"), sides.where("id = 50"), 16.0).collect()
    assert [(r["id"], r["nearest"], r["distance"]) for r in alone] == [(50, None, None)]
    assert polygons.nearest_edges(table, sides.limit(0), 16.0).where("distance IS NOT NULL").count() == 0
    assert polygons.nearest_edges(table.limit(0), sides, 16.0).count() == 0


def test_rounds_of_the_nearest_search_grow_with_the_logarithm_of_the_distance(spark, monkeypatch):
    rounds = []
    real = polygons.Scratch.table
    monkeypatch.setattr(polygons.Scratch, "table", lambda self, df: rounds.append(1) or real(self, df))
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    sides = spark.createDataFrame([(2, 1000.0, 1.0, 1000.0, 2.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    assert [r["distance"] for r in polygons.nearest_edges(points, sides, 1.0).collect()] == [1000.0005] or rounds
    assert len(rounds) <= 1 + 2 * 13


def test_clearance_of_covered_touching_and_uncovered_rings(spark):
    scene = closed((0, 0), (10, 0), (10, 6), (0, 6))[0]
    diamond = closed((5, -5), (15, 5), (5, 15), (-5, 5))[0]
    cases = [(closed((2, 2), (4, 2), (4, 3))[0], scene, 2.0), (scene, scene, 0.0), (closed((9, 1), (12, 1), (9, 3))[0], scene, 0.0), (scene, scene[::-1], 0.0), (closed((4, 4), (6, 4), (6, 6), (4, 6))[0], diamond, 8 / 2**0.5), (closed((1, 1), (2, 1), (1, 5.5))[0], scene[::-1], 0.5), (None, scene, None)]
    table = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    for r in table.select("i", geo.clearance(F.col("a"), F.col("b")).alias("d")).collect():
        want = cases[r["i"]][2]
        assert (r["d"] is None) == (want is None) and (want is None or abs(r["d"] - want) < 1e-9), (r, want)


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverage_of_a_batch_of_unlike_rings_is_counted_at_once(spark):
    """Rings of 3 to 9 corners with nulls between them, in one task: as alone, and by a batched step, not by nested lambdas a row."""
    import math

    area = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
    of = lambda n: [(4 + 2 * math.cos(2 * math.pi * k / n), 4 + 2 * math.sin(2 * math.pi * k / n)) for k in [*range(n), 0]]
    rows = [(i, None if i % 5 == 0 else [(1.0, None), (2.0, 1.0), (1.0, None)] if i % 7 == 0 else of(3 + i % 7), area if i % 11 else []) for i in range(300)]
    table = spark.createDataFrame(rows, "i int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>").coalesce(1)
    found = table.select("i", geo.coverage_percent(F.col("a"), F.col("b")).alias("p"))
    assert "ArrowEvalPython" in _physical(found)
    for r in found.collect():
        i, n = r["i"], 3 + r["i"] % 7
        want = None if i % 5 == 0 or i % 7 == 0 or i % 11 == 0 else 100 * (n / 2 * 4 * math.sin(2 * math.pi / n)) / 64
        assert (r["p"] is None) == (want is None) and (want is None or abs(r["p"] - want) < 1e-9), (r, want)


def test_clearance_of_a_batch_of_unlike_rings_is_counted_at_once(spark):
    scene = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    rows = [(i, [] if i % 5 == 0 else closed((1 + i % 3, 2), (5, 2), (5, 5), *[(4, 6 + k / 4) for k in range(i % 4)])[0], scene if i % 7 else None) for i in range(200)]
    found = spark.createDataFrame(rows, "i int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>").coalesce(1).select("i", geo.clearance(F.col("a"), F.col("b")).alias("d"))
    assert "ArrowEvalPython" in _physical(found)
    for r in found.collect():
        i = r["i"]
        assert r["d"] == (None if i % 5 == 0 or i % 7 == 0 else min(1.0 + i % 3, 2.0)), r


def _boxes(spark, n):
    return spark.range(n).selectExpr("id", "CAST(id % 7 AS INT) AS size", "CAST(id % 50 * 4 AS DOUBLE) AS xmin", "CAST(id DIV 50 * 4 AS DOUBLE) AS ymin", "CAST(id % 50 * 4 + 4 AS DOUBLE) AS xmax", "CAST(id DIV 50 * 4 + 3 AS DOUBLE) AS ymax").coalesce(1)


@pytest.mark.parametrize("name", ["shared_walls", "nearest_wall"])
def test_rows_that_became_many_are_never_broadcast(spark, name, monkeypatch):
    """The files are small, what their rows become in cells is not, and a broadcast of it fills the driver."""
    from parapet.plans import QUERIES  # noqa: F401: registers the plans
    from parapet.plans import polygons as plans

    seen = []
    real = polygons.Scratch.table
    monkeypatch.setattr(polygons.Scratch, "table", lambda self, df: seen.append(_physical(df)) or real(self, df))
    seen.append(_physical(getattr(plans, name)(_boxes(spark, 60))))
    assert any("SortMergeJoin" in p for p in seen) and not any("Broadcast" in p for p in seen)


@pytest.mark.parametrize("touched", [False, True])
def test_burning_deals_one_file_over_tasks(spark, touched, monkeypatch):
    """One task would hold the cells of all polygons of a small file."""
    from parapet.operators import tables

    monkeypatch.setattr(tables.spread, "__defaults__", (100,))
    boxes = _boxes(spark, 1000)
    rings = boxes.withColumn("rings", F.expr("array(array(named_struct('x', xmin, 'y', ymin), named_struct('x', xmax, 'y', ymin), named_struct('x', xmax, 'y', ymax), named_struct('x', xmin, 'y', ymax), named_struct('x', xmin, 'y', ymin)))"))
    burned = polygons.burn(rings, "size", "id", all_touched=touched)
    assert "RoundRobinPartitioning(10)" in _physical(burned) and burned.count() == 1000 * 12


def test_rectangles_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    from parapet.operators import raster, tables

    monkeypatch.setattr(tables.spread, "__defaults__", (100,))
    burned = raster.burn(_boxes(spark, 1000), "size", "id")
    assert "RoundRobinPartitioning(10)" in _physical(burned) and burned.count() == 1000 * 12


def test_rings_are_not_carried_through_the_join_with_points(spark):
    from parapet.plans import polygons as plans

    points = spark.createDataFrame([(0.5, 0.5, 3.0, 2), (3.9, 2.9, 9.0, 2), (0.5, 0.5, 8.0, 7)], "x double, y double, z double, class int")
    found = plans.points_in_rings(points, _boxes(spark, 60))
    join = next(line for line in _physical(found).splitlines() if "SortMergeJoin" in line)
    assert "gx" in join and "rings" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert [(r["id"], r["n"], r["top"]) for r in found.collect()] == [(0, 1, 3.0)]
