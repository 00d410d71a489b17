"""Polygons of closed rings on grids: scanlines, touched cells, burning.

A polygon is an array of closed rings of struct(x, y): its borders and its holes in
any order and direction, for insides are told by odd crossings. Coordinates are in
cells. Null and empty polygons cover nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, drop_table, new_path, spread, write_to


def edges(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """A row an edge: all other columns, and x1, y1, x2, y2."""
    own = [c for c in polygons.columns if c != rings]
    ring = F.explode(F.filter(rings, lambda r: F.size(r) > 1)).alias("ring")
    pairs = F.explode(F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e")
    at = polygons.select(*own, ring).select(*own, pairs)
    return at.select(*own, *[F.col(f"e.{end}.{axis}").alias(f"{axis}{i}") for i, end in ((1, "a"), (2, "b")) for axis in ("x", "y")])


def _runs(first: Column, last: Column, name: str) -> Column:
    """Whole numbers from first to last as rows; none if last is before first."""
    return F.explode(F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))).alias(name)


def spans(polygons: DataFrame, key: list[str], rings: str = "rings") -> DataFrame:
    """(key, r, first, last): the stretches of cells of each row whose centres are inside.

    An edge crosses the centres of the rows between its ends; its crossings of a
    row, in order, are where the inside begins and ends by turns. So a polygon
    makes as many rows as its border is high, whatever its area. A border that
    runs through a centre has it inside if the polygon lies to its right or above.
    """
    sides = edges(polygons.select(*key, rings), rings)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crossed = sides.select(*key, "x1", "y1", "x2", "y2", _runs(F.ceil(low - 0.5), F.ceil(high - 0.5) - 1, "r"))
    at = F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rows = crossed.select(*key, "r", at.alias("x")).groupBy(*key, "r").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # as many as the polygon has edges there
    turns = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.ceil(F.get("xs", 2 * k) - 0.5).cast("bigint").alias("first"), (F.ceil(F.get("xs", 2 * k + 1) - 0.5) - 1).cast("bigint").alias("last")))
    return rows.select(*key, "r", F.explode(turns).alias("s")).where("s.first <= s.last").select(*key, "r", "s.first", "s.last")


def cells_inside(polygons: DataFrame, key: list[str], rings: str = "rings") -> DataFrame:
    """(key, r, c) of the cells whose centre is inside."""
    return spans(polygons, key, rings).select(*key, "r", _runs(F.col("first"), F.col("last"), "c"))


def cells_on_border(polygons: DataFrame, key: list[str], rings: str = "rings") -> DataFrame:
    """(key, r, c) of the cells that an edge passes through; one along a border between cells is in neither."""
    return _cells_of_edges(polygons, key, rings).distinct()


def _cells_of_edges(polygons: DataFrame, key: list[str], rings: str) -> DataFrame:
    """(key, r, c) of the cells that each edge passes through, once an edge."""
    sides = edges(polygons.select(*key, rings), rings)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    last = F.greatest(F.ceil(high) - 1, F.when((low == high) & (F.floor(low) != low), F.floor(low)))
    rows = sides.select(*key, "x1", "y1", "x2", "y2", _runs(F.floor(low), last, "r"))
    least, most = F.least("x1", "x2"), F.greatest("x1", "x2")

    def at(y: Column) -> Column:  # rounding must not lead past the ends
        along = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
        return F.when(F.col("y1") != F.col("y2"), F.greatest(least, F.least(most, along)))

    one, two = at(F.greatest(low, F.col("r"))), at(F.least(high, F.col("r") + 1))
    left, right = F.coalesce(F.least(one, two), least), F.coalesce(F.greatest(one, two), most)
    across = rows.select(*key, "r", left.alias("left"), right.alias("right"))
    to = F.greatest(F.ceil("right") - 1, F.when((F.col("left") == F.col("right")) & (F.floor("left") != F.col("left")), F.floor("left")))
    return across.select(*key, "r", _runs(F.floor("left"), to, "c"))


def burn(polygons: DataFrame, value: str, order: str, rings: str = "rings", all_touched: bool = False) -> DataFrame:
    """(r, c, burned): on each cell the value of the last polygon by ``order`` that holds its centre; with ``all_touched``, that covers any of it.

    Polygons without a value burn nothing.
    """
    key = [order, value]
    given = spread(polygons.where(F.col(value).isNotNull()).select(*key, rings))
    cells = cells_inside(given, key, rings)
    if all_touched:
        cells = cells.unionByName(_cells_of_edges(given, key, rings))  # a cell that comes twice has the same value
    return cells.groupBy("r", "c").agg(F.max_by(value, order).alias("burned"))


def edge_cells(sides: DataFrame, size: float) -> DataFrame:
    """Each edge once for every grid cell that it comes to, borders included, as columns gx and gy."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = sides.withColumn("gy", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    least, most = F.least("x1", "x2"), F.greatest("x1", "x2")

    def at(y: Column) -> Column:
        along = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
        return F.greatest(least, F.least(most, along))

    one, two = at(F.greatest(low, F.col("gy") * size)), at(F.least(high, (F.col("gy") + 1) * size))
    flat = F.col("y1") == F.col("y2")
    left, right = F.when(flat, least).otherwise(F.least(one, two)), F.when(flat, most).otherwise(F.greatest(one, two))
    return rows.withColumn("gx", F.explode(F.sequence(F.floor(left / size), F.floor(right / size))))


def edge_distance(x: Column, y: Column) -> Column:
    """Distance of a point from the edge x1, y1, x2, y2 of its row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    part = ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0))))
    return F.hypot(x - F.col("x1") - part * dx, y - F.col("y1") - part * dy)


#: Edges whose directions differ by less than this are parallel, and lines nearer than this are the same.
_TURN, _NEAR = 1e-6, 1e-7


def shared_walls(polygons: DataFrame, key: str = "id", rings: str = "rings", size: float = 16.0) -> DataFrame:
    """(a, b, shared, ratio), a < b: the length of border that two polygons share, and its part of the shorter border.

    Edges meet in the grid cells that they come to, by direction (two edges just
    on either side of a step of directions too), so neither a long street of
    walls nor crossing walls make pairs. What an edge shares with several of one
    neighbour is merged before it is added up.
    """
    steps = round(math.pi / _TURN)
    sides = edges(spread(polygons.select(F.col(key).alias("id"), rings)), rings).where("x1 <> x2 OR y1 <> y2")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    border = sides.groupBy("id").agg(F.sum(length).alias("border"))
    turn = F.round(F.pmod(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.lit(math.pi)) / _TURN).cast("bigint") % steps
    met = edge_cells(sides.withColumns({"turn": turn, "length": length}), size)
    side = lambda df, p: df.select("gx", "gy", "turn", *[F.col(c).alias(p + c) for c in ("id", "x1", "y1", "x2", "y2", "length")])
    around = met.withColumn("turn", F.explode(F.array(*[F.pmod(F.col("turn") + d, F.lit(steps)) for d in (-1, 0, 1)])))
    pairs = side(met, "a_").join(side(around, "b_").hint("merge"), ["gx", "gy", "turn"]).where("a_id < b_id").drop("gx", "gy", "turn").distinct()
    ux, uy = (F.col("a_x2") - F.col("a_x1")) / F.col("a_length"), (F.col("a_y2") - F.col("a_y1")) / F.col("a_length")
    off = lambda i: F.abs(ux * (F.col(f"b_y{i}") - F.col("a_y1")) - uy * (F.col(f"b_x{i}") - F.col("a_x1")))
    along = lambda i: ux * (F.col(f"b_x{i}") - F.col("a_x1")) + uy * (F.col(f"b_y{i}") - F.col("a_y1"))
    stretch = F.struct(F.greatest(F.lit(0.0), F.least(along(1), along(2))).alias("lo"), F.least(F.col("a_length"), F.greatest(along(1), along(2))).alias("hi"))
    on_line = pairs.where((off(1) < _NEAR) & (off(2) < _NEAR)).withColumn("s", stretch).where(F.col("s.hi") - F.col("s.lo") > _NEAR)
    held = on_line.groupBy("a_id", "b_id", "a_x1", "a_y1", "a_x2", "a_y2").agg(F.array_sort(F.collect_list("s")).alias("s"))  # edges of one neighbour on one edge
    merged = F.aggregate(
        "s",
        F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("until")),
        lambda acc, x: F.struct((acc["sum"] + F.greatest(F.lit(0.0), x["hi"] - F.greatest(x["lo"], acc["until"]))).alias("sum"), F.greatest(acc["until"], x["hi"]).alias("until")),
        lambda acc: acc["sum"],
    )
    total = held.groupBy("a_id", "b_id").agg(F.sum(merged).alias("shared"))
    of = lambda p: border.select(F.col("id").alias(f"{p}_id"), F.col("border").alias(f"{p}_border"))
    with_borders = total.join(of("a").hint("merge"), "a_id").join(of("b").hint("merge"), "b_id")
    return with_borders.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "shared", (F.col("shared") / F.least("a_border", "b_border")).alias("ratio"))


def nearest_edges(points: DataFrame, sides: DataFrame, size: float, key: str = "id", owner: str = "id") -> DataFrame:
    """(key, nearest, distance) of each point (key, x, y): the edge nearest to it that isn't its own, by edge owner.

    Cells around a point are searched in rings that grow twofold. A point is done
    when its best distance is at most what the searched rings reach on all sides,
    so no edge outside them can be nearer; the others go on. So a point meets the
    edges near it alone, and the rounds grow with the logarithm of the distance in
    cells. Points at the same distance from several take the smallest owner. Where
    there are no edges of others at all, a point has none. The rounds are written
    tables, and so are the edges by cell; the result is read from the points done
    in each round. Joins merge: what a point becomes in cells must not be broadcast.
    """
    spark = points.sparkSession
    scratch, held, by_cell = Scratch(spark, "nearest"), new_path(spark, "nearest-found"), new_path(spark, "nearest-edges")
    cells = write_to(edge_cells(sides, size).select("gx", "gy", F.col(owner).alias("owner"), "x1", "y1", "x2", "y2"), by_cell)
    box = cells.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("gx", "gy") for f in (F.min, F.max)]).first()
    id_type = points.schema[key].dataType.simpleString()
    waiting = scratch.table(points.select(key, "x", "y", F.lit(None).cast("double").alias("distance"), F.lit(None).cast(cells.schema["owner"].dataType).alias("nearest")))
    from_ring, to_ring, parts = 0, 0, []
    while box["min_gx"] is not None and not waiting.isEmpty():
        own_x, own_y = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
        across, down = F.col("gx") - own_x, F.col("gy") - own_y
        window = lambda own, lo, hi: F.explode(F.when(F.greatest(own - to_ring, F.lit(lo)) <= F.least(own + to_ring, F.lit(hi)), F.sequence(F.greatest(own - to_ring, F.lit(lo)), F.least(own + to_ring, F.lit(hi)))))
        looked = waiting.withColumn("gx", window(own_x, box["min_gx"], box["max_gx"])).withColumn("gy", window(own_y, box["min_gy"], box["max_gy"])).where(F.greatest(F.abs(across), F.abs(down)) >= from_ring)
        seen = looked.join(cells.hint("merge"), ["gx", "gy"]).where(~F.col("owner").eqNullSafe(F.col(key)))
        best = seen.groupBy(key, "x", "y").agg(F.min(F.struct(edge_distance(F.col("x"), F.col("y")).alias("distance"), F.col("owner"))).alias("found"))
        now = waiting.join(best.hint("merge"), [key, "x", "y"], "left")
        nearer = F.least(F.struct("distance", F.col("nearest").alias("owner")), F.col("found"))
        pick = F.when(F.col("found").isNull(), F.struct("distance", F.col("nearest").alias("owner"))).when(F.col("distance").isNull(), F.col("found")).otherwise(nearer)
        rows = scratch.table(now.select(key, "x", "y", pick.alias("p")).select(key, "x", "y", F.col("p.distance").alias("distance"), F.col("p.owner").alias("nearest")))
        far = F.greatest(own_x - box["min_gx"], box["max_gx"] - own_x, own_y - box["min_gy"], box["max_gy"] - own_y)
        done = F.coalesce(F.col("distance") <= to_ring * size, F.lit(False)) | (far <= to_ring)
        parts.append(f"{held}/round={len(parts)}")
        rows.where(done).select(key, "nearest", "distance").write.parquet(parts[-1])
        waiting = scratch.table(rows.where(~done))
        from_ring, to_ring = to_ring + 1, max(1, 2 * to_ring)
        scratch.drop(keep=1)
    schema = f"{key} {id_type}, nearest {cells.schema['owner'].dataType.simpleString()}, distance double"
    found = spark.read.schema(schema).parquet(*parts) if parts else waiting.select(key, "nearest", "distance")
    drop_table(spark, by_cell)
    return found
