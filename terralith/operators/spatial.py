"""Distances between objects: Moran's I, semivariograms, nearest neighbours; pixel extraction and zonal statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralith.functions import geometry as G
from terralith.operators.stats import valid
from terralith.sources.parts import settled


def centroids(objects: DataFrame, key: str = "objeto_id", polygons: str = "polygons") -> DataFrame:
    """(key, cx, cy) of the objects that have a geometry."""
    c = G.centroid(F.col(polygons))
    return objects.where(G.present(F.col(polygons))).select(key, c["x"].alias("cx"), c["y"].alias("cy"))


def distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.sqrt(F.pow(F.col(ax) - F.col(bx), 2) + F.pow(F.col(ay) - F.col(by), 2))


PER_BLOCK = 4000


def block_pairs(points: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, key: str) -> DataFrame:
    """``kernel(a, b, same)`` of each two blocks of points, once: blocks of about PER_BLOCK rows, cut by a hash of the key.

    Work over all pairs is quadratic by definition; here a task takes the pairs of two blocks, pairs are never rows, and a point
    is sent once for each block.
    """
    blocks = max(1, -(-points.count() // PER_BLOCK))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = points.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = rows.withColumns({"__u": F.least("__own", "__other"), "__v": F.greatest("__own", "__other")}).drop("__other")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = pdf["__u"].iloc[0], pdf["__v"].iloc[0]
        return kernel(pdf[pdf["__own"] == u], pdf[pdf["__own"] == v], u == v)

    return dealt.groupBy("__u", "__v").applyInPandas(run, schema)


def gaps(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    return np.sqrt((a["cx"].to_numpy()[:, None] - b["cx"].to_numpy()) ** 2 + (a["cy"].to_numpy()[:, None] - b["cy"].to_numpy()) ** 2)


def morans_i(points: DataFrame, key: str = "objeto_id") -> DataFrame:
    """One row: moran_i and expected, from (key, cx, cy, value).  Weights are inverse distances, row-standardised; objects at
    the same place are no neighbours.  Null for fewer than two objects or equal values."""
    rows = points.where(valid(F.col("value"))).select(key, "cx", "cy", "value")
    mean = rows.agg(F.avg("value").alias("mean"))
    z = rows.crossJoin(F.broadcast(mean)).withColumn("value", F.col("value") - F.col("mean")).drop("mean")  # one row is broadcast

    def weigh(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        ours, theirs = np.zeros((2, len(a))), np.zeros((2, len(b)))
        z = b["value"].to_numpy()
        for k in range(0, len(a), 256):  # some rows at a time, so that no matrix of the blocks is held
            part = a.iloc[k : k + 256]
            d = gaps(part, b)
            w = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
            ours[:, k : k + 256] = w.sum(1), w @ z
            theirs += w.sum(0), part["value"].to_numpy() @ w
        sides = [(a, ours)] if same else [(a, ours), (b, theirs)]
        return pd.concat([pd.DataFrame({"i": x[key].to_numpy(), "w": w, "wz": wz}) for x, (w, wz) in sides])

    sums = block_pairs(z, weigh, "i long, w double, wz double", key).groupBy("i").agg(F.try_divide(F.sum("wz"), F.sum("w")).alias("lag"))
    lagged = z.join(sums, z[key] == sums["i"], "left")
    one = lagged.agg(F.sum(F.col("value") * F.coalesce("lag", F.lit(0.0))).alias("top"), F.sum(F.col("value") * F.col("value")).alias("below"), F.count("*").alias("n"))
    return one.select(F.when(F.col("n") > 1, F.try_divide("top", "below")).alias("moran_i"), F.when(F.col("n") > 1, -1 / (F.col("n") - 1)).alias("expected"))


def semivariogram(points: DataFrame, lags: int = 15, key: str = "objeto_id") -> DataFrame:
    """(lag, h, gamma, pairs): mean semivariance by distance, in ``lags`` bins up to half the greatest distance.

    Bins are half-open; an empty one has gamma 0.  The cutoff is so wide that most pairs fall under it: their sums are taken by
    pairs of blocks.
    """
    rows = points.where(valid(F.col("value"))).select(key, "cx", "cy", "value")
    far = extreme_points(rows)  # the greatest distance is that of two corners of the convex hull
    cutoff = far.alias("a").crossJoin(far.alias("b")).agg((F.max(distance("a.cx", "a.cy", "b.cx", "b.cy")) / 2).alias("cutoff"))
    placed = rows.crossJoin(F.broadcast(cutoff))  # one row

    def bin_(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        most, n, g = a["cutoff"].iloc[0] if len(a) else np.nan, np.zeros(lags), np.zeros(lags)
        for k in range(0, len(a), 512):
            part = a.iloc[k : k + 512]
            d = np.sqrt((part["cx"].to_numpy()[:, None] - b["cx"].to_numpy()) ** 2 + (part["cy"].to_numpy()[:, None] - b["cy"].to_numpy()) ** 2)
            use = d < most
            if same:
                use &= part[key].to_numpy()[:, None] < b[key].to_numpy()
            lag = np.minimum(np.floor(d[use] / (most / lags)), lags - 1).astype(int)
            diff = (part["value"].to_numpy()[:, None] - b["value"].to_numpy())[use]
            n += np.bincount(lag, minlength=lags)
            g += np.bincount(lag, weights=diff * diff / 2, minlength=lags)
        return pd.DataFrame({"lag": np.arange(lags), "n": n, "g": g})

    sums = block_pairs(placed, bin_, "lag int, n double, g double", key)
    binned = sums.groupBy("lag").agg(F.try_divide(F.sum("g"), F.sum("n")).alias("gamma"), F.sum("n").cast("long").alias("pairs"))
    every = cutoff.select(F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag"), "cutoff")
    return every.join(binned, "lag", "left").select("lag", ((F.col("lag") + 0.5) * F.col("cutoff") / lags).alias("h"), F.coalesce("gamma", F.lit(0.0)).alias("gamma"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def extreme_points(points: DataFrame) -> DataFrame:
    """(cx, cy) of the corners of the convex hull: first of the points of each task, then of those hulls' corners."""

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.zeros((0, 2))
        for pdf in batches:
            known = G.hull(np.concatenate([known, pdf[["cx", "cy"]].to_numpy(float)]))
        if len(known):
            yield pd.DataFrame(known, columns=["cx", "cy"])

    schema = "cx double, cy double"
    return points.select("cx", "cy").mapInPandas(corners, schema).repartition(1).mapInPandas(corners, schema)  # hulls' corners alone meet


def nearest(points: DataFrame, k: int = 3, key: str = "objeto_id", per_cell: int = 8, crowd: int = 64) -> DataFrame:
    """(key, proximity): mean distance to the k nearest other objects, or to as many as there are; null for a single one.

    Objects at one place count as often as they stand there.  Places lie in square cells of about ``per_cell`` each; cells of more
    than ``crowd`` places are cut into 16, and so on, so each place starts in a cell of at most ``crowd`` (closer than 2^-40 of the
    extent, cells are cut no more).  From the narrowest cells up, a place that finds its k nearest within one cell's width is done,
    and the others join those that start in cells four times as wide.  Of places that aren't done, less than k lie near each other,
    so a wide cell that holds a cluster is met by few.
    """
    rows = points.select(key, "cx", "cy").persist()
    places = rows.groupBy("cx", "cy").agg(F.count("*").alias("times")).persist()
    box = places.agg(F.sum("times").alias("n"), F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1")).head()
    n = box["n"] or 0
    if n < 2:
        return rows.select(key, F.lit(None).cast("double").alias("proximity"))
    side = max(box["x1"] - box["x0"], box["y1"] - box["y0"])

    def celled(df: DataFrame, width: float) -> DataFrame:
        return df.withColumns({"gx": F.floor((F.col("cx") - box["x0"]) / width).cast("long"), "gy": F.floor((F.col("cy") - box["y0"]) / width).cast("long")})

    def found(asked: DataFrame, width: float, last: bool) -> DataFrame:
        """``asked`` with proximity, null where a place doesn't have its k nearest within the width."""
        open_, ring = asked.select("cx", "cy", "times"), F.array(*map(F.lit, (-1, 0, 1)))
        asked = celled(asked.select("cx", "cy"), width).withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring))
        asked = asked.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
        there = celled(places, width).withColumnsRenamed({"cx": "bx", "cy": "by"})
        same = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
        d = asked.join(there, ["gx", "gy"]).select("ax", "ay", distance("ax", "ay", "bx", "by").alias("d"), (F.col("times") - same.cast("int")).alias("times"))
        d = d.where("times > 0") if last else d.where((F.col("times") > 0) & (F.col("d") <= 0.99 * width))  # far from where cells' numbers are rounded
        nearer = F.coalesce(F.sum("times").over(Window.partitionBy("ax", "ay").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        top = d.withColumn("take", F.least("times", F.lit(k) - nearer)).where("take > 0")
        top = top.groupBy(F.col("ax").alias("cx"), F.col("ay").alias("cy")).agg((F.sum(F.col("d") * F.col("take")) / F.sum("take")).alias("proximity"), F.sum("take").alias("found"))
        top = (top if last else top.where(F.col("found") == min(k, n - 1))).select("cx", "cy", "proximity")
        return settled(open_.join(top, ["cx", "cy"], "left"), "nearest")

    width = max(side * math.sqrt(per_cell / n), side / 2**20) or 1.0
    starts, inside = [], places
    while True:  # places by the width of the cells in which they start
        cells = celled(inside, width)
        crowded = cells.groupBy("gx", "gy").agg(F.count("*").alias("m")).where(F.col("m") > crowd).persist()
        if width / 4 < side / 2**40 or crowded.isEmpty():
            starts.append((width, inside))
            break
        parted = settled(cells.join(crowded, ["gx", "gy"], "left").select("cx", "cy", "times", "m"), "crowded")
        starts.append((width, parted.where("m IS NULL").drop("m")))
        inside = parted.where("m IS NOT NULL").drop("m")
        width /= 4

    done, open_ = None, None
    while True:
        if starts:
            width, some = starts.pop()
            open_ = some if open_ is None else open_.unionByName(some)
        last = width >= side
        asked = found(open_, width, last)
        full, open_ = asked.where("proximity IS NOT NULL").drop("times"), asked.where("proximity IS NULL").drop("proximity")
        done = full if done is None else done.unionByName(full)
        if not starts and (last or open_.isEmpty()):
            return rows.join(done, ["cx", "cy"]).select(key, "proximity")
        width *= 4


def extract_pixels(grid: DataFrame, objects: DataFrame, meta: dict, bands: list[str], key: str = "objeto_id", clase: str = "clase", polygons: str = "polygons", tile: int | None = None, rule: str = "no pixel") -> DataFrame:
    """(key, clase, pixel_x, pixel_y, row, col, bands): pixels of ``grid`` (row, col, bands) whose centre lies inside an object.

    Objects and pixels meet by square tiles of ``tile`` pixels (None: about half as wide as the mean object) inside the raster, then
    by ray casting (boundary points are outside).  Pixels inside are settled as a table, as they tell which objects have none.  An object
    without a pixel gets the one at its centroid, clamped to the raster: under the rule "no pixel" if none lies inside, under
    "no valid" if none of those inside has values in all bands.  Pixels with a missing band are dropped at the end.

    ``meta``: x0, dx, y0, dy (dy negative), width, height; a rotated raster has to be resampled first.
    """
    if meta.get("rx") or meta.get("ry"):
        raise ValueError("rotated rasters are not supported")
    x0, dx, y0, dy = (float(meta[k]) for k in ("x0", "dx", "y0", "dy"))
    shapes = objects.where(G.present(F.col(polygons))).select(key, clase, F.col(polygons).alias("__g"), G.bounds(F.col(polygons)).alias("__b"))
    if tile is None:  # a pixel meets the boxes of its tile, a box is sent to each of its tiles
        wide = shapes.agg(F.avg(F.least(F.col("__b.x1") - F.col("__b.x0"), F.lit(abs(dx) * meta["width"])) / abs(dx)).alias("w")).head()["w"] or 64.0
        tile = 2 ** max(3, min(8, round(math.log2(max(wide, 1.0))) - 1))

    def tiles(a: str, b: str, origin: float, step: float, cells: int) -> Column:
        """The tiles from one side of a box to the other, but for those beyond the raster."""
        first, last = (F.floor((F.col(f"__b.{c}") - origin) / step / tile) for c in (a, b))
        first, last = F.greatest(first, F.lit(0)).cast("long"), F.least(last, F.lit((cells - 1) // tile)).cast("long")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    shapes = shapes.withColumn("tc", F.explode(tiles("x0", "x1", x0, dx, meta["width"]))).withColumn("tr", F.explode(tiles("y1", "y0", y0, dy, meta["height"])))
    placed = grid.withColumns({"pixel_x": x0 + (F.col("col") + 0.5) * dx, "pixel_y": y0 + (F.col("row") + 0.5) * dy, "tc": F.floor(F.col("col") / tile), "tr": F.floor(F.col("row") / tile)})
    x, y = F.col("pixel_x"), F.col("pixel_y")
    in_box = x.between(F.col("__b.x0"), F.col("__b.x1")) & y.between(F.col("__b.y0"), F.col("__b.y1"))
    columns = [key, clase, "pixel_x", "pixel_y", "row", "col", *bands]
    inside = placed.join(shapes, ["tc", "tr"]).where(in_box).where(G.contains(F.col("__g"), x, y)).select(columns)
    inside = settled(inside, "inside")
    full = inside.dropna(subset=bands)
    found = inside if rule == "no pixel" else full
    c = G.centroid(F.col(polygons))
    clamp = lambda v, most: F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(most - 1))
    alone = objects.where(G.present(F.col(polygons))).join(found.select(key).distinct(), key, "left_anti")
    alone = alone.select(key, clase, clamp((c["x"] - x0) / dx, meta["width"]).alias("col"), clamp((c["y"] - y0) / dy, meta["height"]).alias("row"))
    alone = settled(alone, "alone")
    if alone.isEmpty():
        return full
    fallback = alone.join(placed.drop("tc", "tr"), ["row", "col"]).select(columns)
    return full.unionByName(fallback.dropna(subset=bands))


def zonal_mean(pixels: DataFrame, objects: DataFrame, band: str, key: str = "objeto_id", missing: float | None = 0.0) -> DataFrame:
    """(key, value): mean of a band by object; objects without a valid pixel get ``missing``."""
    means = pixels.where(valid(F.col(band))).groupBy(key).agg(F.avg(band).alias("value"))
    out = objects.select(key).join(means, key, "left")
    return out if missing is None else out.fillna(missing, subset=["value"])
