"""Rasters held as tables of cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reasons
from .components import components
from .splitting import drawn
from .tables import spread


def augment(cells: DataFrame, chip: str, size: int, seed: int, row: str = "r", column: str = "c") -> DataFrame:
    """Each chip of ``size`` rows and columns turned and mirrored; the chip's hash decides how.

    The number drawn has the quarter turns (counted clockwise) in its lowest two
    bits, then whether columns and whether rows are mirrored. All columns of a cell
    move together, so a mask stays with its values.
    """
    k, r, c, last = drawn(F.lit(16), seed, chip), F.col(row), F.col(column), F.lit(size - 1)
    turns = k % 4
    turned_r = F.when(turns == 0, r).when(turns == 1, last - c).when(turns == 2, last - r).otherwise(c)
    turned_c = F.when(turns == 0, c).when(turns == 1, r).when(turns == 2, last - c).otherwise(last - r)
    new_r = F.when(F.floor(k / 8) % 2 == 1, last - turned_r).otherwise(turned_r)
    new_c = F.when(F.floor(k / 4) % 2 == 1, last - turned_c).otherwise(turned_c)
    return cells.withColumns({row: new_r.cast("int"), column: new_c.cast("int")})


def burn(boxes: DataFrame, value: str, order: str, all_touched: bool = False) -> DataFrame:
    """(r, c, burned): the value of the last rectangle by ``order`` on each unit cell.

    A rectangle takes the cells whose centre it holds, its lower borders included;
    with ``all_touched`` all cells that it shares some area with.
    """
    if all_touched:
        first, last = F.floor, lambda hi: F.ceil(hi) - 1
    else:
        first, last = lambda lo: F.ceil(lo - 0.5), lambda hi: F.ceil(hi - 0.5) - 1
    out = spread(boxes.select(value, order, "xmin", "xmax", "ymin", "ymax"))
    for name, lo, hi in (("c", "xmin", "xmax"), ("r", "ymin", "ymax")):
        a, b = first(F.col(lo)).cast("bigint"), last(F.col(hi)).cast("bigint")
        out = out.where(a <= b).withColumn(name, F.explode(F.sequence(a, b)))
    return out.groupBy("r", "c").agg(F.max_by(value, order).alias("burned"))


def _before(at: Column, block: int, last: Column) -> Column:
    """Index of the last part of an axis that ends at ``at``: two parts a block, cut at ``last`` inside it."""
    return F.when(at % block == 0, 2 * F.floor(at / block) - 1).when(at == last, 2 * F.floor(at / block)).otherwise(2 * F.floor(at / block) + 1).cast("bigint")


def window_sums(cells: DataFrame, extents: DataFrame, key: list[str], sums: dict[str, Column], size: int, stride: int, last_window: bool = False) -> DataFrame:
    """(key, row_off, col_off, sums) of every square window of ``size``, one each ``stride`` rows and columns.

    ``extents`` has (key, height, width) of each raster; cells that have no row
    count as 0. Windows lie wholly inside, so a raster smaller than ``size`` has
    none; with ``last_window`` one more row and column of windows ends at the far
    edges, where the strides don't.

    A summed-area table: cells are added up in blocks whose borders are all that
    windows can begin and end at, two running sums make prefix sums of the blocks,
    and a window is four of them. The work is that of the cells once and of the
    windows four times, however far windows overlap, and a running sum goes over
    the blocks of one row or column of one raster.
    """
    block = math.gcd(size, stride)
    far = {"row": F.col("height") - size, "col": F.col("width") - size}
    part = lambda at, last: (2 * F.floor(F.col(at) / block) + F.when((F.col(at) >= last) & (F.floor(F.col(at) / block) == F.floor(last / block)) & (last % block != 0), 1).otherwise(0)).cast("bigint")
    fits = extents.where((F.col("height") >= size) & (F.col("width") >= size))
    added = cells.join(fits, key).groupBy(*key, part("r", far["row"]).alias("i"), part("c", far["col"]).alias("j")).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    index = lambda side: F.explode(F.sequence(F.lit(0), 2 * F.ceil(F.col(side) / block).cast("bigint") - 1))
    table = fits.select(*key, index("height").alias("i"), "width").select(*key, "i", index("width").alias("j")).join(added, [*key, "i", "j"], "left")
    for along, other in (("i", "j"), ("j", "i")):
        so_far = Window.partitionBy(*key, along).orderBy(other).rowsBetween(Window.unboundedPreceding, 0)
        table = table.withColumns({n: F.sum(F.coalesce(n, F.lit(0))).over(so_far) for n in sums})
    starts = lambda last: F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last, F.lit(stride).cast("bigint")), F.array(last) if last_window else F.array().cast("array<bigint>"))))
    windows = fits.withColumn("row_off", starts(far["row"].cast("bigint"))).withColumn("col_off", starts(far["col"].cast("bigint")))
    corner = lambda down, across, sign: F.struct(_before(F.col("row_off") + down, block, far["row"]).alias("i"), _before(F.col("col_off") + across, block, far["col"]).alias("j"), F.lit(sign).alias("sign"))
    corners = windows.select(*key, "row_off", "col_off", F.explode(F.array(corner(0, 0, 1), corner(size, size, 1), corner(0, size, -1), corner(size, 0, -1))).alias("p")).select(*key, "row_off", "col_off", "p.*")
    met = corners.join(table, [*key, "i", "j"], "left")
    return met.groupBy(*key, "row_off", "col_off").agg(*[F.coalesce(F.sum(F.col("sign") * F.col(n)), F.lit(0)).alias(n) for n in sums])


def labelled(cells: DataFrame, key: str, width: int, r: str = "r", c: str = "c") -> DataFrame:
    """``cells`` with root, the place (r * width + c) of the first cell of its four-neighbour component in its raster."""
    rows = cells.withColumn("root_id", F.col(key).cast("bigint") * (width * width) + F.col(r) * width + F.col(c))
    shift = F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))
    moved = rows.withColumn("s", F.explode(shift)).select(key, (F.col(r) + F.col("s.a")).alias(r), (F.col(c) + F.col("s.b")).alias(c), F.col("root_id").alias("u"))
    edges = moved.join(rows.select(key, r, c, F.col("root_id").alias("v")), [key, r, c]).select("u", "v")
    roots = components(edges)
    return rows.join(roots, F.col("root_id") == F.col("node"), "left").withColumn("root", (F.coalesce("root", "root_id") % (width * width)).cast("int")).drop("root_id", "node")


#: Edges of the height bins, names of the bins, and the least shares that a chip must have.
HEIGHT_BINS = ((0, 10), (10, 20), (20, 30), (30, 40), (40, 50), (50, None))
MIN_SPECTRAL_COVERAGE, MIN_TARGET_COVERAGE, MIN_COMPONENT_CELLS = 0.99, 0.95, 3


def inspect_chips(cells: DataFrame, key: str, width: int) -> DataFrame:
    """One row a chip with building cells: coverages, heights of its components, counts by height bin, and why it is left out.

    ``cells`` has (key, r, c, mask, spectral, target): whether a cell is building,
    whether its spectral bands are valid, and its height (null if unknown). The
    height of a component is the median of its cells; components of fewer than
    three cells don't count.
    """
    building = cells.where("mask")
    known = F.coalesce(F.col("target") > 0, F.lit(False))
    shares = building.groupBy(key).agg(F.count(F.lit(1)).alias("building_cells"), F.count_if(F.col("spectral")).alias("spectral_cells"), F.count_if(known).alias("target_cells"))
    heights = labelled(building.where(known), key, width).groupBy(key, "root").agg(F.count(F.lit(1)).alias("cells"), F.median("target").alias("height")).where(F.col("cells") >= MIN_COMPONENT_CELLS)
    name = lambda low, high: f"bin_{low}_{'plus' if high is None else high}"
    within = lambda low, high: (F.col("height") >= low) & (F.lit(True) if high is None else F.col("height") < high)
    bins = [F.count_if(within(*b)).alias(name(*b)) for b in HEIGHT_BINS]
    profile = heights.groupBy(key).agg(F.count(F.lit(1)).alias("components"), F.median("height").alias("median_height"), F.percentile("height", F.lit(0.9)).alias("p90_height"), F.max("height").alias("max_height"), *bins)
    met = shares.join(profile, key, "left")
    count = F.coalesce("components", F.lit(0)).cast("bigint")
    spectral, target = F.col("spectral_cells") / F.col("building_cells"), F.col("target_cells") / F.col("building_cells")
    category = F.when(count == 0, "empty").when((F.col("p90_height") >= 30) | (F.col("max_height") >= 50), "highrise").when(F.col("p90_height") >= 10, "midrise").otherwise("lowrise")
    why = reasons((spectral < MIN_SPECTRAL_COVERAGE, "insufficient_spectral_building_coverage"), (target < MIN_TARGET_COVERAGE, "insufficient_positive_target_coverage"), (count == 0, "no_eligible_building_components"))
    out = met.select(key, "building_cells", spectral.alias("spectral_coverage"), target.alias("target_coverage"), count.alias("components"), "median_height", "p90_height", "max_height", category.alias("category"), why.alias("excluded"), *[F.coalesce(name(*b), F.lit(0)).cast("bigint").alias(name(*b)) for b in HEIGHT_BINS])
    return out.withColumn("eligible", F.col("excluded") == "")


def fill_gaps(cells: DataFrame, value: str, distance: int) -> DataFrame:
    """(r, c, filled, was_empty) of a dense grid: empty cells from the nearest valid one of each of four quadrants within ``distance``.

    A quadrant takes in its borders, so the cell's own row and column count on both
    sides. Of equally near cells the one in the nearer column is taken. The value
    is the mean weighted by inverse distance; empty cells with no valid one near
    stay null. Then each filled cell becomes the mean of its 3 x 3 neighbourhood,
    as far as that has values; given cells stay.

    Valid cells are carried down and up their columns by windows, so an empty cell
    looks at two cells a column, not at the area around it.
    """
    inside = Window.partitionBy("c").orderBy("r")
    held = F.when(F.col(value).isNotNull(), F.struct(F.col("r").alias("at"), F.col(value).alias("z")))
    above = F.last(held, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(held, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    columns = cells.select("r", "c", F.col(value).alias("z"), above.alias("above"), below.alias("below"))
    empty = columns.where("z IS NULL").select("r", "c", F.explode(F.sequence(F.lit(-distance), F.lit(distance))).alias("dc"))
    seen = empty.join(columns.select("r", (F.col("c")).alias("from_c"), "above", "below"), (empty["r"] == columns["r"]) & (empty["c"] + empty["dc"] == F.col("from_c"))).drop(columns["r"])
    d2 = lambda side: F.col("dc") ** 2 + (F.col("r") - F.col(f"{side}.at")) ** 2

    def nearest(side: str, across: Column) -> Column:
        near = across & (d2(side) <= distance * distance)
        return F.min(F.when(near, F.struct(d2(side).alias("d2"), F.abs("dc").alias("dc"), F.col(f"{side}.z").alias("z"))))

    left, right = F.col("dc") <= 0, F.col("dc") >= 0
    quadrants = {"q1": ("above", left), "q2": ("below", left), "q3": ("above", right), "q4": ("below", right)}
    found = seen.groupBy("r", "c").agg(*[nearest(*q).alias(n) for n, q in quadrants.items()])
    total = lambda of: reduce(lambda a, b: a + b, [F.coalesce(of(q), F.lit(0.0)) for q in quadrants])
    weights = total(lambda q: 1 / F.sqrt(F.col(f"{q}.d2")))
    mean = F.when(weights > 0, total(lambda q: F.col(f"{q}.z") / F.sqrt(F.col(f"{q}.d2"))) / weights)
    filled = columns.select("r", "c", "z").join(found.select("r", "c", mean.alias("mean")), ["r", "c"], "left")
    first = filled.select("r", "c", F.coalesce("z", "mean").cast("decimal(18,9)").alias("v"), F.col("z").isNull().alias("was_empty"), F.col("z"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = first.where("was_empty AND v IS NOT NULL").select("r", "c", around.alias("s")).select("r", "c", (F.col("r") + F.col("s.a")).alias("r2"), (F.col("c") + F.col("s.b")).alias("c2"))
    smooth = spread.join(first.select(F.col("r").alias("r2"), F.col("c").alias("c2"), "v"), ["r2", "c2"]).groupBy("r", "c").agg((F.sum("v").cast("double") / F.count("v")).alias("smooth"))
    return first.join(smooth, ["r", "c"], "left").select("r", "c", F.coalesce("z", "smooth").alias("filled"), "was_empty")


def resample_bilinear(cells: DataFrame, key: list[str], value: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(key, r, c, value) of rasters brought from ``source`` to ``target`` rows and columns.

    A target cell takes its four neighbours by distance of centres; weights are
    shared out anew among those that have values (null is no value), also at the
    edges. A cell none of whose neighbours has one is null. Each source cell goes
    to the targets that it has a share in, so there is no join, and the sums are
    of exact decimals, in any order the same.
    """
    shares = lambda at, n, m: F.expr(
        f"explode(filter(transform(sequence(0, {m - 1}), t -> struct(t as t, 1 - abs((t + 0.5D) * {n} / {m} - 0.5D - {at}) as w)), s -> s.w > 0))"
    )
    (h, w), (out_h, out_w) = source, target
    rows = cells.select(*key, "c", value, shares("r", h, out_h).alias("s")).select(*key, "c", value, F.col("s.t").alias("r2"), F.col("s.w").alias("wr"))
    both = rows.select(*key, value, "r2", "wr", shares("c", w, out_w).alias("s")).select(*key, value, F.col("r2").alias("r"), F.col("s.t").alias("c"), (F.col("wr") * F.col("s.w")).alias("w"))
    exact = lambda v: F.sum(F.when(F.col(value).isNotNull(), v.cast("decimal(28,12)"))).cast("double")
    return both.groupBy(*key, "r", "c").agg((exact(F.col("w") * F.col(value)) / F.nullif(exact(F.col("w")), F.lit(0.0))).alias(value))


def component_heights(cells: DataFrame, key: str, width: int, least_cells: int = MIN_COMPONENT_CELLS) -> DataFrame:
    """(key, root, cells, means and medians of target and predicted, error) of each component of building cells with a known target.

    ``cells`` has (key, r, c, mask, target, predicted). ``error`` is the median
    predicted less the median target; components of fewer than ``least_cells`` are
    left out.
    """
    valid = cells.where(F.col("mask") & (F.col("target") > 0) & F.col("predicted").isNotNull())
    exact = lambda n: F.sum(F.col(n).cast("decimal(28,9)")).cast("double") / F.count(n)
    stats = [f(n).alias(f"{n}_{name}") for n in ("target", "predicted") for name, f in (("mean", exact), ("median", F.median))]
    out = labelled(valid, key, width).groupBy(key, "root").agg(F.count(F.lit(1)).alias("cells"), *stats).where(F.col("cells") >= least_cells)
    return out.withColumn("error", F.col("predicted_median") - F.col("target_median"))


def merge_windows(predictions: DataFrame, extents: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, r, c, mean, variance, n) of every cell of rasters that overlapping windows predict.

    ``extents`` has (key, height, width). A cell that no window covers raises when
    the row is read, as do null predictions alone.
    """
    exact = lambda v: F.sum(v.cast("decimal(38,12)")).cast("double")
    v = F.col(value)
    merged = predictions.groupBy(*key, "r", "c").agg(exact(v).alias("sum"), exact(v * v).alias("squares"), F.count(v).alias("n"))
    across = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    cells = extents.where("height > 0 AND width > 0").select(*key, across("height").alias("r"), "width").select(*key, "r", across("width").alias("c"))
    met = cells.join(merged, [*key, "r", "c"], "left")
    name = F.concat_ws(", ", F.lit("no window covers"), *[F.col(k).cast("string") for k in (*key, "r", "c")])
    n = F.when(F.coalesce("n", F.lit(0)) == 0, F.raise_error(name).cast("bigint")).otherwise(F.col("n"))
    mean = F.col("sum") / F.col("n")
    return met.withColumn("n", n).select(*key, "r", "c", mean.alias("mean"), F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"), "n")


def gains(bands: DataFrame, chip: str, band: str, value: str, seed: int) -> DataFrame:
    """``value`` of each chip times a gain of the chip (0.90 to 1.10) and one of its band (0.97 to 1.03), 0 at least; hashes draw them."""
    share = lambda *keys: drawn(F.lit(1_000_000), seed, *keys) / 1_000_000
    common, own = 0.90 + 0.20 * share(chip), 0.97 + 0.06 * share(chip, band)
    return bands.withColumn(value, F.greatest(F.col(value) * common * own, F.lit(0.0)))


def grid_audit(rasters: DataFrame, templates: DataFrame, on: str) -> DataFrame:
    """``rasters`` with failed: what of its grid differs from its template's, '' if nothing; 'template' if it has none.

    Both have (on, crs, x0, y0, dx, dy, width, height): origin, signed cell sizes,
    and numbers of cells.
    """
    grid = ("crs", "x0", "y0", "dx", "dy", "width", "height")
    met = rasters.join(templates.select(on, *[F.col(c).alias(f"__t_{c}") for c in grid], F.lit(True).alias("__t")), on, "left")
    differs = lambda *names: reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__t_{c}")) for c in names])
    end = lambda p, origin, step, n: F.col(p + origin) + F.col(p + step) * F.col(p + n)
    bounds = differs("x0", "y0") | ~end("", "x0", "dx", "width").eqNullSafe(end("__t_", "x0", "dx", "width")) | ~end("", "y0", "dy", "height").eqNullSafe(end("__t_", "y0", "dy", "height"))
    turned = F.abs("dx") != F.abs("__t_dx")
    resolution = F.coalesce(turned | (F.abs("dy") != F.abs("__t_dy")), F.lit(True))
    failed = reasons((differs("crs"), "crs"), (differs("x0", "y0", "dx", "dy"), "transform"), (differs("width"), "width"), (differs("height"), "height"), (bounds, "bounds"), (resolution, "resolution"))
    return met.select(*rasters.columns, F.when(F.col("__t").isNull(), "template").otherwise(failed).alias("failed"))


def stack_scenes(plan: DataFrame, bands: DataFrame, key: list[str], expected: int) -> DataFrame:
    """(chip, key, values, names): the bands of a chip's scenes one after the other, in plan order, as unsigned 16-bit numbers.

    ``plan`` has (chip, place, scene, prefix, indexes): which bands of a scene to
    take, in order. ``bands`` has (scene, key, band, v), band counted from 1. Values
    are rounded half to even. A cell with another number of bands than
    ``expected`` raises when it is read. A cell holds as many values as the plan has
    bands.
    """
    wanted = plan.select("chip", "place", "scene", "prefix", F.posexplode("indexes").alias("at", "band"))
    number = F.least(F.greatest(F.bround("v", 0), F.lit(0.0)), F.lit(65535.0)).cast("int")
    met = wanted.join(bands, ["scene", "band"]).select("chip", *key, F.struct("place", "at", number.alias("v"), F.concat_ws("_", "prefix", F.col("band").cast("string")).alias("name")).alias("x"))
    stacked = met.groupBy("chip", *key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    wrong = F.concat_ws(" ", F.lit("bands of"), F.col("chip").cast("string"), F.lit(":"), F.size("x").cast("string"))
    values = F.when(F.size("x") == expected, F.transform("x", lambda y: y["v"])).otherwise(F.raise_error(wrong).cast("array<int>"))
    return stacked.select("chip", *key, values.alias("values"), F.transform("x", lambda y: y["name"]).alias("names"))
