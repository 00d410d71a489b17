"""Windows, chip reports and gap fill against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from parapet.operators import raster


@pytest.mark.parametrize("size,stride,last", [(3, 2, True), (4, 2, False), (4, 3, True), (2, 5, True), (5, 1, False), (1, 1, True)])
def test_window_sums_against_plain_sums(spark, size, stride, last):
    rng = random.Random(size * 10 + stride)
    extents = [("a", 11, 7), ("b", 4, 9), ("c", 5, 5), ("empty", 6, 6), ("small", 2, 8)]
    cells = [(k, r, c, rng.randint(-3, 9)) for k, h, w in extents if k != "empty" for r in range(h) for c in range(w) if rng.random() < 0.7]
    want = {}
    for k, h, w in extents:
        starts = lambda n: sorted({*range(0, n - size + 1, stride), *([n - size] if last and n >= size else [])})
        if h >= size and w >= size:
            for a in starts(h):
                for b in starts(w):
                    want[k, a, b] = sum(v for n, r, c, v in cells if n == k and a <= r < a + size and b <= c < b + size)
    got = raster.window_sums(spark.createDataFrame(cells, "k string, r int, c int, v int"), spark.createDataFrame(extents, "k string, height int, width int"), ["k"], {"n": F.col("v")}, size, stride, last)
    assert {(r["k"], r["row_off"], r["col_off"]): r["n"] for r in got.collect()} == want


def test_the_work_of_windows_does_not_grow_with_their_size(spark):
    """Four look-ups a window, whatever it holds: no row of the plan's joins for each cell of each window."""
    cells = spark.range(4096).select(F.lit("k").alias("k"), F.floor(F.col("id") / 64).alias("r"), (F.col("id") % 64).alias("c"))
    extents = spark.createDataFrame([("k", 64, 64)], "k string, height int, width int")
    sums = raster.window_sums(cells, extents, ["k"], {"n": F.lit(1)}, 48, 8)
    assert sums.where("n = 48 * 48").count() == 9 == sums.count()


def test_chip_reports_against_plain_components(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for chip in range(25):
        grid = {(r, c): (rng.random() < 0.6, rng.random() < (0.995 if chip % 2 else 0.9), rng.choice([None, 0.0, rng.uniform(1, 60), 10.0, 50.0]) if chip % 3 else rng.uniform(1, 12)) for r in range(8) for c in range(8)}
        if chip == 7:
            grid = {at: (False, True, 5.0) for at in grid}
        rows += [(chip, r, c, *v) for (r, c), v in grid.items()]
        building = {at for at, v in grid.items() if v[0]}
        if not building:
            continue
        left, heights = {at for at in building if (grid[at][2] or 0) > 0}, []
        good = len(left)
        while left:
            todo, part = [left.pop()], []
            while todo:
                r, c = todo.pop()
                part.append(grid[r, c][2])
                for at in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if at in left:
                        left.remove(at)
                        todo.append(at)
            if len(part) >= 3:
                heights.append(statistics.median(part))
        why = []
        if sum(grid[at][1] for at in building) / len(building) < 0.99:
            why.append("insufficient_spectral_building_coverage")
        if good / len(building) < 0.95:
            why.append("insufficient_positive_target_coverage")
        if not heights:
            why.append("no_eligible_building_components")
        edges = [0, 10, 20, 30, 40, 50, float("inf")]
        want[chip] = (len(building), len(heights), max(heights, default=None), ";".join(why), [sum(a <= h < b for h in heights) for a, b in zip(edges, edges[1:])])
    cells = spark.createDataFrame(rows, "chip int, r int, c int, mask boolean, spectral boolean, target double")
    bins = [f"bin_{a}_{b}" for a, b in ((0, 10), (10, 20), (20, 30), (30, 40), (40, 50), (50, "plus"))]
    got = {r["chip"]: (r["building_cells"], r["components"], r["max_height"], r["excluded"], [r[b] for b in bins]) for r in raster.inspect_chips(cells, "chip", 8).collect()}
    assert got == want


def test_gap_fill_against_plain_quadrants(spark):
    rng = random.Random(6)
    h, w, reach = 12, 15, 3
    grid = {(r, c): (float(rng.randint(0, 40)) if rng.random() < 0.25 and c < 10 else None) for r in range(h) for c in range(w)}
    first = dict(grid)
    for (r, c), z in grid.items():
        if z is None:
            total = weight = 0.0
            for up in (-1, 1):
                for side in (-1, 1):
                    near = [((a - r) ** 2 + (b - c) ** 2, abs(b - c), v) for (a, b), v in grid.items() if v is not None and (a - r) * up >= 0 and (b - c) * side >= 0 and (a - r) ** 2 + (b - c) ** 2 <= reach**2]
                    if near:
                        d2, _, v = min(near)
                        total, weight = total + v / d2**0.5, weight + 1 / d2**0.5
            first[r, c] = total / weight if weight else None
    want = dict(first)
    for (r, c), z in grid.items():
        if z is None and first[r, c] is not None:
            around = [first.get((r + a, c + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            want[r, c] = statistics.fmean(v for v in around if v is not None)
    got = raster.fill_gaps(spark.createDataFrame([(r, c, z) for (r, c), z in grid.items()], "r int, c int, z double"), "z", reach).collect()
    assert len(got) == h * w and any(v is None for v in want.values())
    for r in got:
        a, b = r["filled"], want[r["r"], r["c"]]
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) and r["was_empty"] == (grid[r["r"], r["c"]] is None)
    given = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "r int, c int, z double")
    assert raster.fill_gaps(given.where("r > 5"), "z", 2).count() == 0
    assert [r["filled"] for r in raster.fill_gaps(given.where("z is null"), "z", 2).collect()] == [None]


@pytest.mark.parametrize("source,target", [((8, 8), (12, 12)), ((5, 7), (3, 4)), ((4, 4), (4, 4)), ((1, 3), (2, 5))])
def test_bilinear_against_plain_neighbours(spark, source, target):
    import math

    rng = random.Random(1)
    (h, w), (out_h, out_w) = source, target
    grid = {(r, c): None if rng.random() < 0.3 or (r, c) == (0, 0) else round(rng.uniform(-5, 50), 3) for r in range(h) for c in range(w)}
    want = {}
    for r in range(out_h):
        for c in range(out_w):
            y, x = (r + 0.5) * h / out_h - 0.5, (c + 0.5) * w / out_w - 0.5
            top, left = math.floor(y), math.floor(x)
            near = [((1 - abs(y - a)) * (1 - abs(x - b)), grid.get((a, b))) for a in (top, top + 1) for b in (left, left + 1)]
            near = [(k, v) for k, v in near if k > 1e-12 and v is not None]
            want[r, c] = sum(k * v for k, v in near) / sum(k for k, _ in near) if near else None
    got = raster.resample_bilinear(spark.createDataFrame([(1, r, c, v) for (r, c), v in grid.items()], "k int, r int, c int, v double"), ["k"], "v", source, target).collect()
    assert {(r["r"], r["c"]) for r in got} == set(want)
    assert all((r["v"] is None) == (want[r["r"], r["c"]] is None) and (r["v"] is None or abs(r["v"] - want[r["r"], r["c"]]) < 1e-6) for r in got)
