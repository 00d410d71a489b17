"""Grid joins over rectangles and points, and components of touching shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components as connected


def cells(df: DataFrame, size: float, xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> DataFrame:
    """Each row once for every grid cell its rectangle covers, as columns gx and gy."""
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return df.withColumn("gx", F.explode(steps(xmin, xmax))).withColumn("gy", F.explode(steps(ymin, ymax)))


def touching_pairs(boxes: DataFrame, size: float = 16.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b), a < b, of rectangles that meet or overlap; columns of both, the ``carry`` ones too, as a_... and b_....

    An equi-join on grid cells; a pair is taken in the cell of its shared
    rectangle's lower corner alone, so none comes twice. Sides of such joins are
    merged, never broadcast: what they become in cells is many times their files.
    """
    side = lambda p: cells(boxes, size).select("gx", "gy", *[F.col(c).alias(p + c) for c in ("id", "xmin", "ymin", "xmax", "ymax", *carry)])
    a, b = side("a_"), side("b_")
    meet = (F.col("a_xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("a_xmax")) & (F.col("a_ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("a_ymax"))
    own = (F.floor(F.greatest("a_xmin", "b_xmin") / size) == F.col("gx")) & (F.floor(F.greatest("a_ymin", "b_ymin") / size) == F.col("gy"))
    return a.join(b.hint("merge"), ["gx", "gy"]).where((F.col("a_id") < F.col("b_id")) & meet & own)


def boxes_of_points(points: DataFrame, boxes: DataFrame, size: float = 16.0) -> DataFrame:
    """Each point with each rectangle that holds it, borders included."""
    p = points.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return p.join(cells(boxes, size).hint("merge"), ["gx", "gy"]).where(inside).drop("gx", "gy")


def eroded(boxes: DataFrame, steps: tuple[float, ...]) -> DataFrame:
    """Rectangles drawn in on all sides by the first of ``steps`` that leaves some area, else as they are; ``erosion`` tells by how much."""
    least = F.least(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    by = F.coalesce(*[F.when(least > 2 * s, F.lit(s)) for s in steps], F.lit(0.0))
    out = boxes.withColumn("erosion", by)
    return out.withColumns({"xmin": F.col("xmin") + by, "ymin": F.col("ymin") + by, "xmax": F.col("xmax") - by, "ymax": F.col("ymax") - by})


def ring_points(points: DataFrame, boxes: DataFrame, inner: float, outer: float, size: float = 16.0) -> DataFrame:
    """Each point with each rectangle from which it lies ``inner`` to ``outer`` away, without points inside any rectangle."""
    free = points.join(boxes_of_points(points, boxes, size).select("x", "y").distinct().hint("merge"), ["x", "y"], "left_anti")
    wide = boxes.select("id", "xmin", "ymin", "xmax", "ymax", *[(F.col(lo) - outer).alias("o" + lo) for lo in ("xmin", "ymin")], *[(F.col(hi) + outer).alias("o" + hi) for hi in ("xmax", "ymax")])
    near = free.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size)).join(cells(wide, size, "oxmin", "oymin", "oxmax", "oymax").hint("merge"), ["gx", "gy"])
    away = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.lit(0.0), F.col(v) - F.col(hi))
    distance = F.sqrt(away("x", "xmin", "xmax") ** 2 + away("y", "ymin", "ymax") ** 2)
    return near.withColumn("distance", distance).where(F.col("distance").between(inner, outer)).drop("gx", "gy", "oxmin", "oymin", "oxmax", "oymax")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the pairs (a, b): least node of its component."""
    return connected.components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))


def covered_area(boxes: DataFrame, by: list[str], size: float = 16.0) -> DataFrame:
    """Area of the union of rectangles of each group: ``by`` and area.

    Rectangles are cut at the cells of a grid, so that a group's work is spread.
    Inside a cell the borders make upright slabs, and in each slab the part of a
    rectangle that those below it leave uncovered counts.
    """
    edge = lambda pick, own, at: pick(F.col(own), at * size)
    cut = cells(boxes, size).select(
        *by, "gx", "gy", edge(F.greatest, "xmin", F.col("gx")).alias("x0"), edge(F.least, "xmax", F.col("gx") + 1).alias("x1"), edge(F.greatest, "ymin", F.col("gy")).alias("y0"), edge(F.least, "ymax", F.col("gy") + 1).alias("y1")
    ).where("x0 < x1 AND y0 < y1")
    key = [*by, "gx", "gy"]
    borders = cut.select(*key, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = borders.withColumn("next", F.lead("x").over(Window.partitionBy(*key).orderBy("x"))).where("next IS NOT NULL")
    inside = cut.join(slabs.hint("merge"), key).where("x0 <= x AND next <= x1")
    below = F.max("y1").over(Window.partitionBy(*key, "x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(below, F.col("y0"))))
    return inside.select(*by, ((F.col("next") - F.col("x")) * fresh).alias("area")).groupBy(*by).agg(F.sum("area").alias("area"))
