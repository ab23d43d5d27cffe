"""Geometry of nested arrays (polygons of rings of points) as column expressions, with numpy for hulls and touching.

A geometry is array<array<array<struct<x, y>>>>: polygons, each an outer ring and holes; rings repeat their first point.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

POLYGONS = "array<array<array<struct<x: double, y: double>>>>"


def present(g: Column) -> Column:
    return g.isNotNull() & (F.size(g) > 0)


def rings(g: Column) -> Column:
    return F.flatten(g)


def points(g: Column) -> Column:
    return F.flatten(F.flatten(g))


def bounds(g: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    p = points(g)
    xs, ys = p["x"], p["y"]
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def edges(ring: Column) -> Column:
    """struct<a, b> of consecutive points."""
    n = F.size(ring)
    return F.when(n > 1, F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it, also inside lambdas."""
    return F.transform(F.array(value), f)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _cross(e: Column, ox: Column, oy: Column) -> Column:
    return (e["a"]["x"] - ox) * (e["b"]["y"] - oy) - (e["b"]["x"] - ox) * (e["a"]["y"] - oy)


def signed_area(ring: Column) -> Column:
    o = ring[0]
    return total(F.transform(edges(ring), lambda e: _cross(e, o["x"], o["y"]))) / 2


def polygon_area(p: Column) -> Column:
    return F.abs(signed_area(p[0])) - total(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda r: F.abs(signed_area(r))))


def area(g: Column) -> Column:
    return total(F.transform(g, polygon_area))


def perimeter(g: Column) -> Column:
    """Length of all rings, holes too."""
    length = lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], F.lit(2)) + F.pow(e["b"]["y"] - e["a"]["y"], F.lit(2)))
    return total(F.flatten(F.transform(rings(g), lambda r: F.transform(edges(r), length))))


def centroid(g: Column) -> Column:
    """struct<x, y> weighted by area, holes taken off; the mean of the vertices if there is no area.

    Moments are taken about the first vertex.
    """
    o = g[0][0][0]

    def moments(ring: Column, sign: Column) -> Column:
        """struct<a, mx, my>, positive for an outer ring."""
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

        def add(s: Column, e: Column) -> Column:
            k = _cross(e, o["x"], o["y"])
            return F.struct((s["a"] + k / 2).alias("a"), (s["mx"] + k * (e["a"]["x"] + e["b"]["x"] - 2 * o["x"]) / 6).alias("mx"), (s["my"] + k * (e["a"]["y"] + e["b"]["y"] - 2 * o["y"]) / 6).alias("my"))

        def turn(s: Column) -> Column:
            way = sign * F.signum(s["a"])
            return F.struct((s["a"] * way).alias("a"), (s["mx"] * way).alias("mx"), (s["my"] * way).alias("my"))

        return F.aggregate(edges(ring), start, add, turn)

    each = F.flatten(F.transform(g, lambda p: F.transform(p, lambda r, k: moments(r, F.when(k == 0, 1.0).otherwise(-1.0)))))
    v = points(g)
    mean = lambda f: total(v[f]) / F.size(v)
    sums = lambda e: F.struct(total(e["a"]).alias("a"), total(e["mx"]).alias("mx"), total(e["my"]).alias("my"))
    place = lambda s: F.when(s["a"] > 0, F.struct((o["x"] + F.try_divide(s["mx"], s["a"])).alias("x"), (o["y"] + F.try_divide(s["my"], s["a"])).alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))
    return let(let(each, sums), place)


def _ray(e: Column, x: Column, y: Column) -> Column:
    """1 if the edge crosses the ray to the right of the point."""
    a, b = e["a"], e["b"]
    crosses = (a["y"] > y) != (b["y"] > y)
    return F.when(crosses & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]), 1).otherwise(0)


def _on(e: Column, x: Column, y: Column) -> Column:
    a, b = e["a"], e["b"]
    flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
    return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def contains(g: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside (on the boundary: no)."""
    every = F.flatten(F.transform(rings(g), edges))
    crossings = F.aggregate(every, F.lit(0), lambda s, e: s + _ray(e, x, y))
    return (crossings % 2 == 1) & ~F.exists(every, lambda e: _on(e, x, y))


def intersects_box(g: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the geometry and the box share a point, touching included.

    Either an edge meets the box (Liang-Barsky on both axes), or the box lies inside the geometry.
    """

    def meets(e: Column) -> Column:
        a, b = e["a"], e["b"]

        def span(p: Column, q: Column, low: Column, high: Column) -> tuple[Column, Column]:
            d = q - p
            t0, t1 = F.try_divide(low - p, d), F.try_divide(high - p, d)
            flat_in = (d == 0) & p.between(low, high)
            return F.when(flat_in, F.lit(0.0)).when(d == 0, F.lit(2.0)).otherwise(F.least(t0, t1)), F.when(flat_in, F.lit(1.0)).when(d == 0, F.lit(-2.0)).otherwise(F.greatest(t0, t1))

        (ax, bx), (ay, by) = span(a["x"], b["x"], x0, x1), span(a["y"], b["y"], y0, y1)
        return F.greatest(ax, ay, F.lit(0.0)) <= F.least(bx, by, F.lit(1.0))

    every = F.flatten(F.transform(rings(g), edges))
    return F.coalesce(present(g) & (F.exists(every, meets) | contains(g, x0, y0)), F.lit(False))


def circularity(a: Column, p: Column) -> Column:
    return F.when(p > 0, 4 * math.pi * a / F.when(p > 0, p * p)).otherwise(0.0)


def shape_index(a: Column, p: Column) -> Column:
    return F.when(a > 0, p / (4 * F.sqrt(F.when(a > 0, a)))).otherwise(0.0)


def fractal_dimension(a: Column, p: Column) -> Column:
    ok = (a > 1.001) & (p > 1.001)
    return F.when(ok, 2 * F.log(F.when(ok, p)) / F.log(F.when(ok, a))).otherwise(1.0)


def shannon_shape(g: Column) -> Column:
    """Entropy in bits of the vertices' shares of the distance from the centroid; outer ring with its closing vertex; 0 for
    several polygons."""
    away = lambda c: F.transform(g[0][0], lambda p: F.sqrt(F.pow(p["x"] - c["x"], F.lit(2)) + F.pow(p["y"] - c["y"], F.lit(2))))
    term = lambda share: F.when(share > 0, -share * F.log2(F.when(share > 0, share))).otherwise(0.0)
    shares = lambda d: let(total(d), lambda s: F.transform(d, lambda v: F.coalesce(F.try_divide(v, s), F.lit(0.0))))
    entropy = let(let(let(centroid(g), away), shares), lambda q: total(F.transform(q, term)))
    return F.when(F.size(g) == 1, entropy).otherwise(0.0)


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull of points, counter-clockwise (monotone chain)."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(rows: list) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def hull_measures(p: np.ndarray) -> tuple[float, float]:
    """Area of the hull, and the ratio of the sides of the least rotated rectangle around it (1 if degenerate)."""
    h = hull(p)
    if len(h) < 3:
        return 0.0, 1.0
    nxt = np.roll(h, -1, axis=0)
    a = abs((h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1]).sum()) / 2
    e = nxt - h
    u = e / np.linalg.norm(e, axis=1)[:, None]
    along, across = h @ u.T, h @ np.stack([-u[:, 1], u[:, 0]])
    w, v = np.ptp(along, axis=0), np.ptp(across, axis=0)
    k = (w * v).argmin()
    low, high = min(w[k], v[k]), max(w[k], v[k])
    return float(a), float(low / high) if high > 0 and low > 0 else 1.0


def hull_shape(g: Column) -> Column:
    """struct<hull_area, elongation>."""

    @F.pandas_udf(StructType([StructField("hull_area", DoubleType()), StructField("elongation", DoubleType())]))
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for xs, ys in batches:
            yield pd.DataFrame([hull_measures(np.stack([x, y], 1).astype(float)) for x, y in zip(xs, ys, strict=True)], columns=["hull_area", "elongation"])

    p = points(g)  # flat, as rings of several lengths make no array
    return measure(p["x"], p["y"])


def segments(g: list) -> np.ndarray:
    """(n, 4) edges of all rings."""
    out = []
    for poly in g:
        for ring in poly:
            p = np.array([(q["x"], q["y"]) for q in ring], float)
            out.append(np.hstack([p[:-1], p[1:]]))
    return np.concatenate(out) if out else np.zeros((0, 4))


def inside(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which points lie inside the rings given by their edges."""
    x, y = p[:, :1], p[:, 1:]
    cross = (e[:, 1] > y) != (e[:, 3] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
    return ((cross & (x < at)).sum(1) % 2) == 1


def touches(a: list, b: list, tolerance: float = 1e-9) -> bool:
    """Whether the boundaries meet and the interiors don't.

    Every edge is cut where edges of the other geometry meet it; interiors meet if the midpoint of a piece lies inside the
    other geometry, or if a point inside one lies inside the other.  ``tolerance`` is relative to the extent of both.
    """
    ea, eb = segments(a), segments(b)
    if not len(ea) or not len(eb):
        return False
    eps = tolerance * max(np.ptp(np.concatenate([ea, eb]).reshape(-1, 2), axis=0).max(), 1e-300)

    def gap(e: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Distances of points from edges, (points, edges)."""
        d = e[:, 2:] - e[:, :2]
        t = np.clip(np.einsum("pek,ek->pe", p[:, None] - e[None, :, :2], d) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return np.linalg.norm(e[None, :, :2] + t[..., None] * d - p[:, None], axis=2)

    def crossings(e: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
        """For each edge of e, parameters at which edges of f meet it."""
        out = []
        d = f[:, 2:] - f[:, :2]
        for x in e:
            r = x[2:] - x[:2]
            det = r[0] * d[:, 1] - r[1] * d[:, 0]
            w = f[:, :2] - x[:2]
            with np.errstate(divide="ignore", invalid="ignore"):
                t, s = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / det, (w[:, 0] * r[1] - w[:, 1] * r[0]) / det
            meet = np.isfinite(t) & np.isfinite(s) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
            ends = np.concatenate([f[:, :2], f[:, 2:]])
            along = ((ends - x[:2]) @ r) / max(r @ r, 1e-300)
            near = np.abs((ends - x[:2]) @ np.array([-r[1], r[0]])) / max(np.sqrt(r @ r), 1e-300) <= eps
            out.append(np.unique(np.concatenate([[0, 1], t[meet], along[near & (along > 0) & (along < 1)]])))
        return out

    contact = min(gap(eb, ea[:, :2]).min(), gap(ea, eb[:, :2]).min()) <= eps
    for e, f in ((ea, eb), (eb, ea)):
        cuts = crossings(e, f)
        contact = contact or any(len(c) > 2 for c in cuts)
        mids = np.concatenate([x[:2] + ((c[:-1] + c[1:]) / 2)[:, None] * (x[2:] - x[:2]) for x, c in zip(e, cuts, strict=True)])
        strict = inside(f, mids) & (gap(f, mids).min(1) > eps)
        if strict.any():
            return False
    if not contact:
        return False
    for g, e, f in ((a, ea, eb), (b, eb, ea)):  # equal or nested along the boundary
        p = interior_point(g, e)
        if p is not None and inside(f, p[None])[0] and gap(f, p[None]).min() > eps:
            return False
    return True


def interior_point(g: list, e: np.ndarray) -> np.ndarray | None:
    """A point inside: the middle of the widest stretch of a horizontal line through the first polygon."""
    ys = np.unique(e[:, [1, 3]])
    for y in (ys[:-1] + ys[1:]) / 2:
        hit = e[(e[:, 1] > y) != (e[:, 3] > y)]
        x = np.sort((hit[:, 2] - hit[:, 0]) * (y - hit[:, 1]) / (hit[:, 3] - hit[:, 1]) + hit[:, 0])
        if len(x) > 1:
            k = (x[1::2] - x[0::2]).argmax()
            return np.array([(x[2 * k] + x[2 * k + 1]) / 2, y])
    return None
