"""Variogram models, their fit, and local variograms of objects.

A model is linear in nugget and sill once its range is fixed, so a fit searches the range on a grid and by golden section, and
solves the bounded least squares in the other two exactly.  This finds the best fit within the bounds; where the usual start
values lie outside the bounds, they are returned as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.stats import valid

DESCRIPTORS = ["nugget", "sill", "range", "RMF", "RSF", "FDO", "SDT", "FML", "MFM", "VFM", "AFM", "DMS", "HA"]


def spherical(h: np.ndarray, a: float) -> np.ndarray:
    """Share of the sill reached at distance h."""
    u = np.minimum(np.asarray(h, float) / max(a, 1e-12), 1)
    return 1.5 * u - 0.5 * u**3


def hole_effect(h: np.ndarray, a: float) -> np.ndarray:
    u = np.pi * np.asarray(h, float) / max(a, 1e-12)
    return 1 - np.sinc(u / np.pi)


def bounded(x: np.ndarray, y: np.ndarray, low: tuple[float, float], high: tuple[float, float]) -> tuple[float, float, float]:
    """(squared error, p, q) of the least squares of y by p + q x within bounds of p and q."""
    n, sx, sy, sxx, sxy = len(x), x.sum(), y.sum(), (x * x).sum(), (x * y).sum()
    det = n * sxx - sx * sx
    tries = []
    if det > 1e-14 * max(1.0, n * sxx):
        tries.append(((sxx * sy - sx * sxy) / det, (n * sxy - sx * sy) / det))
    for p in (low[0], high[0]):
        tries.append((p, (sxy - p * sx) / sxx if sxx > 0 else low[1]))
    for q in (low[1], high[1]):
        tries.append(((sy - q * sx) / n, q))
    out = []
    for k, (p, q) in enumerate(tries):
        free = k == 0 and len(tries) == 5
        if free and not (low[0] <= p <= high[0] and low[1] <= q <= high[1]):
            continue
        p, q = min(max(p, low[0]), high[0]), min(max(q, low[1]), high[1])
        out.append((float(((y - p - q * x) ** 2).sum()), float(p), float(q)))
    return min(out)


def fit(h: np.ndarray, y: np.ndarray, shape: Callable, nugget: tuple[float, float], sill: tuple[float, float], span: tuple[float, float], whole_sill: bool, steps: int = 200) -> tuple[float, float, float, float]:
    """(squared error, nugget, sill, range).  ``whole_sill``: the sill's bounds hold for nugget + partial sill."""

    def at(a: float) -> tuple[float, float, float]:
        s = shape(h, a)
        if whole_sill:  # n (1 - s) + sill s
            x, rest = s, 1 - s
            n = [min(max(v, nugget[0]), nugget[1]) for v in (nugget[0], nugget[1])]
            m = np.array([[rest @ rest, rest @ x], [rest @ x, x @ x]])
            b = np.array([rest @ y, x @ y])
            tries = []
            if abs(np.linalg.det(m)) > 1e-14:
                tries.append(np.linalg.solve(m, b))
            tries += [np.array([v, (x @ (y - v * rest)) / max(x @ x, 1e-300)]) for v in n]
            tries += [np.array([(rest @ (y - v * x)) / max(rest @ rest, 1e-300), v]) for v in sill]
            tries = [np.array([min(max(t[0], nugget[0]), nugget[1]), min(max(t[1], sill[0]), sill[1])]) for t in tries]
            return min((float(((y - t[0] * rest - t[1] * x) ** 2).sum()), float(t[0]), float(t[1])) for t in tries)
        return bounded(s, y, (nugget[0], sill[0]), (nugget[1], sill[1]))

    grid = np.linspace(max(span[0], span[1] * 1e-3), span[1], steps)
    errors = [at(a)[0] for a in grid]
    k = int(np.argmin(errors))
    low, high = grid[max(0, k - 1)], grid[min(steps - 1, k + 1)]
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        x, z = high - golden * (high - low), low + golden * (high - low)
        if at(x)[0] <= at(z)[0]:
            high = z
        else:
            low = x
    best = min((at(a) + (float(a),) for a in (grid[k], (low + high) / 2)), key=lambda t: t[0])
    return best


def fit_many(h: np.ndarray, y: np.ndarray, held: np.ndarray, variance: np.ndarray, far: np.ndarray, steps: int = 200) -> np.ndarray:
    """Rows of (nugget, sill, range): ``fit`` of the spherical model with ``whole_sill`` for many local variograms at once.

    A row of ``h`` and ``y`` is a variogram, ``held`` tells which of its lags there are.
    """

    def at(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = np.minimum(h[:, None] / np.maximum(a, 1e-12)[..., None], 1)
        x = 1.5 * u - 0.5 * u**3
        rest, x, z = (1 - x) * held[:, None], x * held[:, None], np.broadcast_to((y * held)[:, None], x.shape)
        rr, rx, xx, ry, xz = (np.einsum("nsl,nsl->ns", p, q) for p, q in ((rest, rest), (rest, x), (x, x), (rest, z), (x, z)))
        det = rr * xx - rx * rx
        whole = np.abs(det) > 1e-14
        safe = np.where(whole, det, 1)
        most_n, most_s = 2 * variance[:, None], 3 * variance[:, None]
        tries = [((xx * ry - rx * xz) / safe, (rr * xz - rx * ry) / safe)]
        tries += [(v + 0 * rr, (xz - v * rx) / np.maximum(xx, 1e-300)) for v in (0.0, most_n)]
        tries += [((ry - v * rx) / np.maximum(rr, 1e-300), v + 0 * rr) for v in (0.0, most_s)]
        best = None
        for k, (p, q) in enumerate(tries):
            p, q = np.minimum(np.maximum(p, 0), most_n), np.minimum(np.maximum(q, 0), most_s)
            error = ((z - p[..., None] * rest - q[..., None] * x) ** 2).sum(-1)
            if k == 0:
                best = np.where(whole, error, np.inf), p, q
                continue
            better = error < best[0]
            best = tuple(np.where(better, new, old) for new, old in zip((error, p, q), best, strict=True))
        return best

    last = 1.5 * far
    first = np.maximum(10.0, last * 1e-3)
    grid = first[:, None] + (last - first)[:, None] * (np.arange(steps) / (steps - 1))
    k = at(grid)[0].argmin(1)
    row = np.arange(len(h))
    low, high, start = grid[row, np.maximum(0, k - 1)], grid[row, np.minimum(steps - 1, k + 1)], grid[row, k]
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        x, z = high - golden * (high - low), low + golden * (high - low)
        error = at(np.stack([x, z], 1))[0]
        left = error[:, 0] <= error[:, 1]
        low, high = np.where(left, low, x), np.where(left, z, high)
    ends = np.stack([start, (low + high) / 2], 1)
    error, p, q = at(ends)
    j = error.argmin(1)
    return np.stack([p[row, j], q[row, j], ends[row, j]], 1)


def fit_global(h: np.ndarray, gamma: np.ndarray, variance: float, cutoff: float) -> dict:
    """The better of spherical and hole-effect by squared error (hole only if strictly better); sill = nugget + partial sill."""
    start = (float(gamma[0]), variance - float(gamma[0]), cutoff / 2)
    if variance <= 0 or not (0 <= start[0] <= 2 * variance) or start[1] < 0:
        return {"modelo": "esferico", "nugget": start[0], "sill": variance, "range": start[2], "mse": None}
    bounds = ((0.0, 2 * variance), (0.0, 5 * variance), (0.0, 1.5 * cutoff))
    found = [(name, *fit(h, gamma, f, *bounds, whole_sill=False)) for name, f in (("esferico", spherical), ("hoyo", hole_effect))]
    name, error, nugget, part, a = found[1] if found[1][1] < found[0][1] else found[0]
    return {"modelo": name, "nugget": nugget, "sill": nugget + part, "range": a, "mse": error / len(h)}


def semivariogram_fit(lags: DataFrame, points: DataFrame) -> DataFrame:
    """One row: modelo, nugget, sill, range, mse, from a table of lags (15 rows) and the objects' values."""
    rows = lags.orderBy("lag").collect()
    variance = points.agg(F.var_pop("value").alias("v")).head()["v"] or 0.0
    h, gamma = np.array([r["h"] for r in rows], float), np.array([r["gamma"] for r in rows], float)
    found = fit_global(h, gamma, variance, 2 * h[0] * len(h) if len(h) else 0.0)
    row = [v if v is None or isinstance(v, str) else float(v) for v in found.values()]
    return lags.sparkSession.createDataFrame([row], "modelo string, nugget double, sill double, range double, mse double")


PER_BLOCK = 2048


def local_lags(pixels: DataFrame, value: str = "v", bins: int = 5, key: str = "objeto_id") -> DataFrame:
    """(key, lag, h, gamma, pairs): mean semivariance of an object's pixels by distance, in bins up to the greatest distance;
    empty bins have no row.  Pixels without a place or a value are left out; pixels at one place make no pair.

    Pixels are dealt to blocks of about PER_BLOCK by a hash of their place, and two blocks are one task's group, so that an
    object of any size is spread over as many groups as it has pairs of blocks.  Pairs are never rows: a group gives a row for
    each bin.  Objects of several blocks are gone over twice, first for their greatest distance.
    """
    rows = pixels.select(key, *(F.col(c).cast("double").alias(n) for c, n in (("pixel_x", "x"), ("pixel_y", "y"), (value, "v"))))
    rows = rows.where(valid(F.col("x")) & valid(F.col("y")) & valid(F.col("v")))
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / PER_BLOCK).cast("int").alias("blocks")).persist()
    dealt = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")
    group = [key, "lo", "hi"]
    named = rows.select(key).schema[0]
    schema = lambda rest: f"`{key}` {named.dataType.simpleString()}, {rest}"

    def farthest(table: pa.Table) -> pa.Table:
        far = max((float(d.max()) for d, _ in block_gaps(table) if len(d)), default=0.0)
        return pa.table({key: table.column(key)[:1], "far": pa.array([far])})

    def sums(table: pa.Table) -> pa.Table:
        far, parts = table.column("far")[0].as_py(), block_gaps(table)
        if far is None:  # all in this group
            parts = list(parts)
            far = max((float(d.max()) for d, _ in parts if len(d)), default=0.0)
        n, g, width = np.zeros(bins), np.zeros(bins), far / bins
        for d, v in parts if far > 0 else ():
            lag = np.minimum(d / width, bins).astype(np.int64)
            n += np.bincount(lag, minlength=bins)[:bins]
            g += np.bincount(lag, weights=v, minlength=bins)[:bins]
        some = np.flatnonzero(n)
        return pa.table({key: pa.chunked_array([pa.concat_arrays([table.column(key)[:1].combine_chunks()] * len(some))]) if len(some) else table.column(key)[:0], "lag": pa.array(some.astype(np.int32)), "width": pa.array(np.full(len(some), width)), "g": pa.array(g[some]), "n": pa.array(n[some].astype(np.int64))})

    if sizes.where("blocks > 1").isEmpty():
        dealt = dealt.withColumn("far", F.lit(None).cast("double"))
    else:
        fars = dealt.where("blocks > 1").groupBy(group).applyInArrow(farthest, schema("far double")).groupBy(key).agg(F.max("far").alias("far"))
        dealt = dealt.join(fars, key, "left")
    binned = dealt.select(*group, "own", "far", "x", "y", "v").groupBy(group).applyInArrow(sums, schema("lag int, width double, g double, n long"))
    return binned.groupBy(key, "lag").agg(F.first((F.col("lag") + 0.5) * F.col("width")).alias("h"), (F.sum("g") / F.sum("n")).alias("gamma"), F.sum("n").alias("pairs"))


def block_gaps(table: pa.Table, step: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distances, semivariances) of the pairs of the blocks ``lo`` and ``hi`` of an object, once each, some rows at a time."""
    own, x, y, v = (table.column(c).to_numpy() for c in ("own", "x", "y", "v"))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    a = np.flatnonzero(own == lo)
    b = a if lo == hi else np.flatnonzero(own == hi)
    for k in range(0, len(a), step):
        i, j = a[k : k + step], b[k:] if lo == hi else b
        d = np.sqrt((x[i, None] - x[j]) ** 2 + (y[i, None] - y[j]) ** 2)
        use = d > 0
        if lo == hi:
            use[:, : len(i)] &= np.arange(len(i))[:, None] < np.arange(len(i))
        yield d[use], ((v[i, None] - v[j]) ** 2)[use] / 2


def descriptors(h: np.ndarray, g: np.ndarray, nugget: float, sill: float, a: float) -> dict[str, float]:
    """What a local variogram looks like: ratios and slopes at the origin, the first two maxima, and areas around them."""
    out = {"nugget": nugget, "sill": sill, "range": a}
    n = len(g)
    if n < 3:
        return out | {"RMF": nugget / sill if sill > 0 else 0.0, "RSF": 1.0, "FDO": 0.0, "SDT": 0.0, "FML": a, "MFM": sill, "VFM": 0.0, "AFM": 0.0, "DMS": 0.0, "HA": 0.0}
    step = h[1] - h[0]
    peaks = [k for k in range(1, n) if g[k] >= g[k - 1] and (k == n - 1 or g[k] >= g[k + 1])]
    m1 = peaks[0] if peaks else int(g.argmax())
    m2 = peaks[1] if len(peaks) > 1 else n - 1
    m2 = m2 if m2 > m1 else n - 1
    out |= {"RMF": g.max() / g[0] if g[0] > 0 else 0.0, "RSF": g[1] / g[0] if g[0] > 0 else 1.0, "FDO": (g[1] - g[0]) / step}
    out |= {"SDT": (g[3] - 2 * g[2] + g[1]) / step**2 if n >= 4 else 0.0, "FML": h[m1], "MFM": g[: m1 + 1].mean(), "VFM": g[: m1 + 1].var()}
    out["AFM"] = step / 2 * (g[0] + 2 * g[1:m1].sum() + g[m1]) - g[0] * (h[m1] - h[0])
    box = 0.5 * (h[m2] - h[m1]) * (g[m2] + g[m1])
    later = m2 > m1
    out["DMS"] = h[m2] - h[m1] if later else 0.0
    out["HA"] = step / 2 * (g[m1] + 2 * g[m1 + 1 : m2].sum() + g[m2]) / box if later and box != 0 else 0.0
    return {k: float(v) for k, v in out.items()}


def local_variograms(pixels: DataFrame, value: str = "pc1", key: str = "objeto_id") -> DataFrame:
    """(key, var_*): the descriptors of each object, from all its pixels; null ones for objects of fewer than 5 pixels or
    without extent."""
    rows = pixels.withColumn("v", F.col(value))
    lags = local_lags(rows, "v", 5, key)
    base = rows.groupBy(key).agg(F.count("*").alias("n"), F.var_pop("v").alias("variance"))
    listed = base.join(lags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lag", "h", "gamma"))).alias("lags"), (F.max(F.col("h") / (F.col("lag") + 0.5)) * 5).alias("far")), key, "left")
    schema = f"{key} long, " + ", ".join(f"var_{d} double" for d in DESCRIPTORS)

    def each(batches):  # noqa: ANN001, ANN202
        for whole in batches:
            for first in range(0, len(whole), 256):
                yield described(whole.iloc[first : first + 256])

    def described(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, tuple] = {}
        for i, (n, variance, lags_, far) in enumerate(zip(pdf["n"], pdf["variance"], pdf["lags"], pdf["far"], strict=True)):
            if n >= 5 and lags_ is not None and far and far > 0:
                found[i] = np.array([x["h"] for x in lags_]), np.array([x["gamma"] for x in lags_]), (0.05 * variance, variance, 0.5 * far)
        fitted = {i: start for i, (_, _, start) in found.items()}
        if asked := [i for i, (h, _, start) in found.items() if len(h) >= 3 and start[1] > 0 and 10 <= start[2]]:
            h, g, held = (np.zeros((len(asked), 5)) for _ in range(3))
            for k, i in enumerate(asked):
                n = len(found[i][0])
                h[k, :n], g[k, :n], held[k, :n] = found[i][0], found[i][1], 1
            start = np.array([found[i][2] for i in asked])
            fitted |= dict(zip(asked, fit_many(h, g, held, start[:, 1], start[:, 2] / 0.5), strict=True))
        out = []
        for i, (k, variance) in enumerate(zip(pdf[key], pdf["variance"], strict=True)):
            out.append((descriptors(*found[i][:2], *map(float, fitted[i])) if i in found else {"nugget": 0.0, "sill": float(variance), "range": 30.0}) | {key: k})
        frame = pd.DataFrame(out, columns=[key, *DESCRIPTORS])
        return frame.rename(columns={d: f"var_{d}" for d in DESCRIPTORS})

    # a number of its own, as few bytes with much work (a fit for each object) must not be drawn together into one task
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select(key, "n", "variance", "lags", "far").repartition(parts, key).mapInPandas(each, schema)
