"""Measures of closed rings, a batch of rows at a time in numpy: coverage, clearance, centres.

A batch of rings is three arrays: where each row's points begin, and all x and y.
Coordinates keep their rows apart, so rings of any number of points share a batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Rings:
    """Open rings of a batch: ``begin`` has one number more than there are rows."""

    begin: np.ndarray
    x: np.ndarray
    y: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.begin)

    def rows(self) -> np.ndarray:
        """The row of each point."""
        return np.repeat(np.arange(len(self.begin) - 1), self.sizes)

    def following(self) -> np.ndarray:
        """The place of the point after each, the first after the last."""
        after, full = np.arange(1, len(self.x) + 1), self.sizes > 0
        after[self.begin[1:][full] - 1] = self.begin[:-1][full]
        return after

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the points' values by row."""
        return np.bincount(self.rows(), weights=values, minlength=len(self.begin) - 1)

    def from_first(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates from each row's first point, for small shapes far from the origin."""
        o = np.repeat(self.begin[:-1], self.sizes)
        return self.x - self.x[o], self.y - self.y[o]

    def turned_areas(self) -> np.ndarray:
        """Twice the area of each ring, negative if it turns right."""
        x, y, to = *self.from_first(), self.following()
        return self.sums(x * y[to] - x[to] * y)

    def left(self) -> Rings:
        """The same rings, all turning left."""
        turns = np.repeat(self.turned_areas() < 0, self.sizes)
        mirrored = np.repeat(self.begin[:-1] + self.begin[1:] - 1, self.sizes) - np.arange(len(self.x))
        at = np.where(turns, mirrored, np.arange(len(self.x)))
        return Rings(self.begin, self.x[at], self.y[at])


def opened(column: pa.Array) -> tuple[Rings, np.ndarray]:
    """Closed rings (lists of struct(x, y)) without their last points, and which rows are null or hold a null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    points = lists.flatten()
    x, y = (pc.struct_field(points, name) for name in ("x", "y"))
    empty = pc.or_(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False)
    missing = lists.is_null().to_numpy(zero_copy_only=False) | (np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=empty, minlength=len(sizes)) > 0)
    ends = np.cumsum(sizes)
    kept = np.ones(len(points), dtype=bool)
    kept[ends[sizes > 0] - 1] = False
    number = lambda a: a.cast(pa.float64()).to_numpy(zero_copy_only=False)[kept]
    return Rings(np.concatenate(([0], np.cumsum(np.maximum(sizes - 1, 0)))), number(x), number(y)), missing


def _side(convex: Rings, k: int, rows: np.ndarray):
    """Ends of the k-th edge of the rows' rings, and which of them have one."""
    has = convex.sizes[rows] > k
    a = np.where(has, convex.begin[:-1][rows] + k, 0)
    b = np.where(has, convex.begin[:-1][rows] + (k + 1) % np.maximum(1, convex.sizes[rows]), 0)
    return has, convex.x[a], convex.y[a], convex.x[b], convex.y[b]


def clip(rings: Rings, convex: Rings) -> Rings:
    """The part of each ring inside its row's convex ring that turns left: cut by the half-plane of each edge in turn.

    The cut ring may run along an edge and back where a hollow ring falls into
    parts; its area is right. Nothing is left of rings that only touch.
    """
    for k in range(int(convex.sizes.max(initial=0))):
        if not len(rings.x):
            break
        rows, to = rings.rows(), rings.following()
        has, ax, ay, bx, by = _side(convex, k, rows)
        depth = np.where(has, (bx - ax) * (rings.y - ay) - (by - ay) * (rings.x - ax), 0.0)
        inside = ~(depth < 0)
        crosses = inside != inside[to]
        n = inside.astype(np.int64) + crosses
        at = np.concatenate(([0], np.cumsum(n)))
        x, y = np.empty(at[-1]), np.empty(at[-1])
        x[at[:-1][inside]], y[at[:-1][inside]] = rings.x[inside], rings.y[inside]
        p, q = np.flatnonzero(crosses), to[crosses]
        along = depth[p] / (depth[p] - depth[q])
        put = at[1:][crosses] - 1
        x[put], y[put] = rings.x[p] + along * (rings.x[q] - rings.x[p]), rings.y[p] + along * (rings.y[q] - rings.y[p])
        rings = Rings(at[rings.begin], x, y)
    return rings


def coverage(ring: pa.Array, area: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per cent of each convex ring ``area`` that its ring covers, and which rows have none."""
    (own, no_ring), (convex, no_area) = opened(ring), opened(area)
    return _covered(own, convex), no_ring | no_area | ~(np.abs(convex.turned_areas()) > 0)


def _covered(own: Rings, convex: Rings) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = clip(own, convex.left())
        return np.minimum(100.0, 100 * np.abs(np.where(cut.sizes > 2, cut.turned_areas(), 0.0)) / np.abs(convex.turned_areas()))


def clearance(ring: pa.Array, convex: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of each ring from the border of its row's convex ring, 0 if that doesn't cover it, and which rows have none."""
    (own, no_ring), (scene, no_scene) = opened(ring), opened(convex)
    scene, rows = scene.left(), own.rows()
    least = np.full(len(own.x), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(int(scene.sizes.max(initial=0))):
            has, ax, ay, bx, by = _side(scene, k, rows)
            has &= (ax != bx) | (ay != by)
            depth = ((bx - ax) * (own.y - ay) - (by - ay) * (own.x - ax)) / np.hypot(bx - ax, by - ay)
            least = np.where(has, np.minimum(least, depth), least)
    out = np.full(len(own.begin) - 1, np.inf)
    np.minimum.at(out, rows, least)
    return np.maximum(out, 0.0), no_ring | no_scene | np.isposinf(out)


def centroids(rings: Rings) -> tuple[np.ndarray, np.ndarray]:
    """Centres of area; not a number without area."""
    x, y, to = *rings.from_first(), rings.following()
    w = x * y[to] - x[to] * y
    whole, full = rings.sums(w), rings.sizes > 0
    out = np.full((2, len(whole)), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i, (own, v) in enumerate(((rings.x, x), (rings.y, y))):
            out[i, full] = own[rings.begin[:-1][full]]
            out[i] += np.where(whole != 0, rings.sums(w * (v + v[to])) / (3 * whole), np.nan)
    return out[0], out[1]


def equal_area(rings: Rings) -> Rings:
    """Rings in degrees in the cylindrical equal-area projection (EPSG:6933) on the WGS84 ellipsoid."""
    a, e2 = 6378137.0, 0.00669437999014
    e = math.sqrt(e2)
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - e2 * math.sin(math.radians(30)) ** 2)
    s = np.sin(np.radians(rings.y))
    q = (1 - e2) * (s / (1 - e2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return Rings(rings.begin, a * k0 * np.radians(rings.x), a * q / (2 * k0))


def scene_measures(ring: pa.Array, area: pa.Array) -> pa.Array:
    """struct(coverage, lon, lat, dx, dy) of scenes and the areas of their cities in degrees.

    Coverage in per cent and the offset of centres in metres are measured in the
    equal-area projection; lon and lat are the centre in degrees.
    """
    (own, no_ring), (convex, no_area) = opened(ring), opened(area)
    flat, plane = equal_area(own), equal_area(convex)
    covered, whole = _covered(flat, plane), np.abs(plane.turned_areas())
    (lon, lat), (x, y), (mx, my) = centroids(own), centroids(flat), centroids(plane)
    numbers = {"coverage": (covered, no_ring | no_area | ~(whole > 0)), "lon": (lon, no_ring), "lat": (lat, no_ring), "dx": (x - mx, no_ring | no_area), "dy": (y - my, no_ring | no_area)}
    return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=none | np.isnan(v)) for v, none in numbers.values()], names=list(numbers))
