"""Angles, distances and planar shapes as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rings

#: Fixed value: mean radius of the Earth in metres.
EARTH_RADIUS = 6371008.8
SECTORS_8 = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def wrapped(angle: Column) -> Column:
    """An angle in degrees, from 0 to under 360, whatever its sign."""
    return F.pmod(angle, F.lit(360.0))


def sector4(bearing: Column) -> Column:
    """N, E, S or W; edges at 45, 135, 225 and 315 go to the later sector."""
    b = wrapped(bearing)
    return F.when((b >= 315) | (b < 45), "N").when(b < 135, "E").when(b < 225, "S").otherwise("W")


def sector8(bearing: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SECTORS_8)), (F.floor((wrapped(bearing) + 22.5) / 45) % 8 + 1).cast("int"))


def bearing_of(dx: Column, dy: Column) -> Column:
    """Compass bearing of a planar offset."""
    return wrapped(F.degrees(F.atan2(dx, dy)))


def season(lat: Column, month: Column) -> Column:
    """summer or winter in the two months around a solstice at that latitude, else null."""
    june, december = month.isin(6, 7), month.isin(12, 1)
    return F.when(F.when(lat >= 0, june).otherwise(december), "summer").when(F.when(lat >= 0, december).otherwise(june), "winter")


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point."""
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def destination(lon: Column, lat: Column, bearing: Column, metres: Column) -> Column:
    """struct(lon, lat) reached from a point along a great circle."""
    p, l, b, d = F.radians(lat), F.radians(lon), F.radians(bearing), metres / EARTH_RADIUS
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    over = l + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.struct((F.pmod(F.degrees(over) + 540, F.lit(360.0)) - 180).alias("lon"), F.degrees(to).alias("lat"))


def geodesic_buffer(lon: Column, lat: Column, metres: Column, every: int = 5) -> Column:
    """Closed ring of points around a centre, one each ``every`` degrees."""
    return F.transform(F.concat(F.sequence(F.lit(0), F.lit(360 - every), F.lit(every)), F.array(F.lit(0))), lambda b: destination(lon, lat, b.cast("double"), metres))


def equal_area(lon: Column, lat: Column) -> Column:
    """struct(x, y) in the cylindrical equal-area projection (EPSG:6933) on the WGS84 ellipsoid."""
    a, e2 = 6378137.0, 0.00669437999014
    e = math.sqrt(e2)
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - e2 * math.sin(math.radians(30)) ** 2)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return F.struct((a * k0 * F.radians(lon)).alias("x"), (a * q / (2 * k0)).alias("y"))


def shoelace(ring: Column) -> Column:
    """Area of a closed ring of struct(x, y)."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)) / 2


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a closed ring, by counting crossings of a ray to the right."""
    crossed = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1),
        F.slice(ring, 2, F.size(ring) - 1),
        lambda a, b: F.when((a["y"] > y) != (b["y"] > y), F.when(x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"], 1).otherwise(0)).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def inside_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point is in a polygon of closed rings, the first its border and the others holes: inside an odd number of them."""
    return F.aggregate(polygon, F.lit(0), lambda s, ring: s + F.when(inside_ring(x, y, ring), 1).otherwise(0)) % 2 == 1


def overlap(a: str, b: str) -> Column:
    """Area shared by the rectangles <a>xmin... and <b>xmin..., 0 if they don't meet."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)))
    return side("xmin", "xmax") * side("ymin", "ymax")


def shared_boundary(a: str, b: str) -> Column:
    """Length of the border that two touching, not overlapping rectangles share."""
    run = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)))
    touch = lambda lo, hi: (F.col(a + hi) == F.col(b + lo)) | (F.col(b + hi) == F.col(a + lo))
    return F.when(touch("xmin", "xmax"), run("ymin", "ymax")).when(touch("ymin", "ymax"), run("xmin", "xmax")).otherwise(0.0)


def coverage_percent(ring: Column, area: Column) -> Column:
    """Per cent of a convex closed ring ``area`` that a closed ring covers, from 0 to 100; null where ``area`` has none."""

    @F.arrow_udf("double")
    def percent(ring: pa.Array, area: pa.Array) -> pa.Array:
        value, none = rings.coverage(ring, area)
        return pa.array(value, pa.float64(), mask=none)

    return percent(ring, area)


#: The WGS84 ellipsoid, and the scale and false origin of UTM.
_A, _F = 6378137.0, 1 / 298.257223563
_K0, _EAST, _SOUTH = 0.9996, 500_000.0, 10_000_000.0


def kruger() -> tuple[float, float, list[float], list[float]]:
    """Eccentricity, radius of the rectifying sphere, and the forward and inverse coefficients of the series to the sixth order."""
    n = _F / (2 - _F)
    powers = lambda first, *terms: sum(t * n ** (first + i) for i, t in enumerate(terms))
    forward = [
        powers(1, 1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
        powers(2, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
        powers(3, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
        powers(4, 49561 / 161280, -179 / 168, 6601661 / 7257600),
        powers(5, 34729 / 80640, -3418889 / 1995840),
        powers(6, 212378941 / 319334400),
    ]
    inverse = [
        powers(1, 1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
        powers(2, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
        powers(3, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
        powers(4, 4397 / 161280, -11 / 504, -830251 / 7257600),
        powers(5, 4583 / 161280, -108847 / 3991680),
        powers(6, 20648693 / 638668800),
    ]
    return math.sqrt(_F * (2 - _F)), _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256), forward, inverse


def _waves(series: list[float], across: Column, along: Column) -> tuple[Column, Column]:
    """Sums of c sin(2jx) cosh(2jy) and of c cos(2jx) sinh(2jy)."""
    two = [sum((c * f(2 * j * across) * g(2 * j * along) for j, c in enumerate(series, 1)), F.lit(0.0)) for f, g in ((F.sin, F.cosh), (F.cos, F.sinh))]
    return two[0], two[1]


def utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct(x, y) in metres of a point in the UTM zone ``epsg`` (326zz north, 327zz south), by the Krüger series."""
    e, radius, forward, _ = kruger()
    s, away = F.sin(F.radians(lat)), F.radians(lon - (6 * (epsg % 100) - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    flat = F.struct(F.atan2(t, F.cos(away)).alias("xi"), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) ** 2)).alias("eta"))

    def project(p: Column) -> Column:
        north, east = _waves(forward, p["xi"], p["eta"])
        return F.struct((_EAST + _K0 * radius * (p["eta"] + east)).alias("x"), (F.when(epsg >= 32700, _SOUTH).otherwise(0.0) + _K0 * radius * (p["xi"] + north)).alias("y"))

    return F.element_at(F.transform(F.array(flat), project), 1)


def utm_inverse(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lon, lat) of a point in the UTM zone ``epsg``."""
    e, radius, _, inverse = kruger()
    plane = F.struct(((y - F.when(epsg >= 32700, _SOUTH).otherwise(0.0)) / (_K0 * radius)).alias("xi"), ((x - _EAST) / (_K0 * radius)).alias("eta"))

    def ball(p: Column) -> Column:
        north, east = _waves(inverse, p["xi"], p["eta"])
        return F.struct((p["xi"] - north).alias("xi"), (p["eta"] - east).alias("eta"))

    def latitude(goal: Column) -> Column:
        """The tangent of the latitude whose conformal tangent is ``goal``, by Newton's method."""

        def closer(t: Column, _: Column) -> Column:
            s = F.sinh(e * F.atanh(e * t / F.sqrt(1 + t * t)))
            got = t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)
            return t + (goal - got) / F.sqrt(1 + got * got) * (1 + (1 - e * e) * t * t) / ((1 - e * e) * F.sqrt(1 + t * t))

        return F.aggregate(F.sequence(F.lit(1), F.lit(5)), goal, closer)

    def place(p: Column) -> Column:
        goal = F.sin(p["xi"]) / F.sqrt(F.sinh(p["eta"]) ** 2 + F.cos(p["xi"]) ** 2)
        return F.struct((F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))) + 6 * (epsg % 100) - 183).alias("lon"), F.degrees(F.atan(latitude(goal))).alias("lat"))

    return F.element_at(F.transform(F.transform(F.array(plane), ball), place), 1)


def clearance(ring: Column, convex: Column) -> Column:
    """Least distance between the border of a closed ring and that of a closed convex ring that covers it; 0 if it doesn't.

    Inside a convex ring the nearest border is that of the nearest edge's line,
    and the least of a ring is at one of its corners.
    """

    @F.arrow_udf("double")
    def least(ring: pa.Array, convex: pa.Array) -> pa.Array:
        value, none = rings.clearance(ring, convex)
        return pa.array(value, pa.float64(), mask=none)

    return least(ring, convex)


def scene_measures(ring: Column, area: Column) -> Column:
    """struct(coverage, lon, lat, dx, dy) of a scene's closed ring and a convex closed ring, both in degrees.

    The per cent of ``area`` that the scene covers, the scene's centre in degrees, and
    the offset in metres of its centre from that of ``area``; areas and offsets are
    measured in the equal-area projection. Null without area.
    """

    @F.arrow_udf("coverage double, lon double, lat double, dx double, dy double")
    def measures(ring: pa.Array, area: pa.Array) -> pa.Array:
        return rings.scene_measures(ring, area)

    return measures(ring, area)


def centroid(ring: Column) -> Column:
    """struct(x, y): the centre of area of a closed ring; null without area."""
    o = F.get(ring, F.lit(0))
    at = lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y"))
    near = F.transform(ring, at)
    pairs = F.zip_with(F.slice(near, 1, F.size(near) - 1), F.slice(near, 2, F.size(near) - 1), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("w"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in "wxy"])
    total = F.aggregate(pairs, zero, lambda s, p: F.struct((s["w"] + p["w"]).alias("w"), (s["x"] + p["w"] * p["x"]).alias("x"), (s["y"] + p["w"] * p["y"]).alias("y")))
    return F.when(total["w"] != 0, F.struct((o["x"] + total["x"] / (3 * total["w"])).alias("x"), (o["y"] + total["y"] / (3 * total["w"])).alias("y")))
