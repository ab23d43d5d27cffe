"""Grey-level co-occurrence and edges of objects, on grids of cells (objeto_id, r, c, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULTS = {"contrast": 0.0, "homogeneity": 1.0, "asm": 1.0, "entropy": 0.0, "mean": 0.0, "variance": 0.0, "correlation": 0.0}


def local_component(pixels: DataFrame, bands: list[str], key: str = "objeto_id") -> DataFrame:
    """``pixels`` with pc1: the first component of the object's centred bands; the first band for objects of one pixel or
    rasters of one band.  Covariances are aggregated; only the small matrices go through numpy.  The greatest loading is
    positive."""
    if len(bands) == 1:
        return pixels.withColumn("pc1", F.col(bands[0]).cast("double"))
    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    sums = pixels.groupBy(key).agg(F.count("*").alias("__n"), F.array(*(F.avg(b) for b in bands)).alias("__m"), F.array(*(F.coalesce(F.covar_samp(bands[i], bands[j]), F.lit(0.0)) for i, j in pairs)).alias("__c"))

    @F.pandas_udf("array<double>")
    def first_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        upper = tuple(np.array(pairs).T)
        for s in batches:
            out = []
            for c in s:
                m = np.zeros((len(bands), len(bands)))
                m[upper] = c
                v = np.linalg.eigh(m, UPLO="U")[1][:, -1]
                out.append((v * (1 if v[np.abs(v).argmax()] > 0 else -1)).tolist())
            yield pd.Series(out)

    vectors = sums.select(key, "__n", "__m", first_vector("__c").alias("__v"))
    score = sum((F.col(b) - F.col("__m")[i]) * F.col("__v")[i] for i, b in enumerate(bands))
    return pixels.join(vectors, key).withColumn("pc1", F.when(F.col("__n") > 1, score).otherwise(F.col(bands[0]))).drop("__n", "__m", "__v")


def cells(pixels: DataFrame, value: str, key: str = "objeto_id", mode: str = "exact", xmin: str = "xmin", pixel: float = 30.0, order: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """(key, r, c, v, n): the object's grid.

    "exact" takes row and column of the raster.  "reference" places a pixel at its centre's distance from the object's left and
    upper edge (columns ``xmin``, ymax) over the pixel size, rounded half to even, and keeps the last pixel of a cell.
    """
    by = Window.partitionBy(key)
    if mode == "exact":
        placed = pixels.select(key, F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("v"))
    else:
        r, c = F.rint((F.col("ymax") - F.col("pixel_y")) / pixel).cast("int"), F.rint((F.col("pixel_x") - F.col(xmin)) / pixel).cast("int")
        placed = pixels.select(key, r.alias("r"), c.alias("c"), F.struct(*order).alias("o"), F.col(value).alias("v")).groupBy(key, "r", "c").agg(F.max_by("v", "o").alias("v"))
    return placed.withColumns({"r": F.col("r") - F.min("r").over(by), "c": F.col("c") - F.min("c").over(by), "n": F.count("*").over(by)})


def quantized(grid: DataFrame, key: str = "objeto_id", levels: int = 8) -> DataFrame:
    """``grid`` with q: the value's level, from 0; all 0 if the object is constant."""
    by = Window.partitionBy(key)
    low, high = F.min("v").over(by), F.max("v").over(by)
    return grid.withColumn("q", F.coalesce(F.try_divide(F.col("v") - low, high - low) * (levels - 0.001), F.lit(0.0)).cast("int"))


def neighbours(grid: DataFrame, key: str, value: str) -> DataFrame:
    """``grid`` with the values to the right and below, null if there is none."""
    across, down = Window.partitionBy(key, "r").orderBy("c"), Window.partitionBy(key, "c").orderBy("r")
    right = F.when(F.lead("c").over(across) == F.col("c") + 1, F.lead(value).over(across))
    below = F.when(F.lead("r").over(down) == F.col("r") + 1, F.lead(value).over(down))
    return grid.withColumns({"right": right, "below": below})


def cooccurrence(grid: DataFrame, key: str = "objeto_id") -> DataFrame:
    """(key, i, j, n): symmetric counts of levels of neighbours, to the right and below; objects of 4 cells or more."""
    both = neighbours(grid.where("n >= 4"), key, "q").select(key, "q", F.explode(F.array("right", "below")).alias("other")).where("other IS NOT NULL")
    ways = both.select(key, F.explode(F.array(F.struct(F.col("q").alias("i"), F.col("other").alias("j")), F.struct(F.col("other").alias("i"), F.col("q").alias("j")))).alias("p"))
    return ways.groupBy(key, "p.i", "p.j").agg(F.count("*").alias("n"))


def texture(counts: DataFrame, objects: DataFrame, key: str = "objeto_id") -> DataFrame:
    """(key, contrast, homogeneity, asm, entropy, mean, variance, correlation) of each of ``objects``; defaults without pairs."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    rows = counts.withColumn("p", p)
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    d2 = (i - j) * (i - j)
    sums = rows.groupBy(key).agg(
        F.sum(d2 * p).alias("contrast"), F.sum(p / (1 + d2)).alias("homogeneity"), F.sum(p * p).alias("asm"), F.sum(-p * F.log2(p + 1e-10)).alias("entropy"),
        F.sum(i * p).alias("mean"), F.sum(i * i * p).alias("ii"), F.sum(i * j * p).alias("ij"),
    )
    variance = F.greatest(F.col("ii") - F.col("mean") * F.col("mean"), F.lit(0.0))
    correlation = F.when(F.sqrt(F.col("variance")) > 1e-10, F.try_divide(F.col("ij") - F.col("mean") * F.col("mean"), F.col("variance"))).otherwise(0.0)
    measured = sums.withColumn("variance", variance).withColumn("correlation", correlation).select(key, *DEFAULTS)
    return objects.select(key).distinct().join(measured, key, "left").fillna(DEFAULTS)


def edge_strength(grid: DataFrame, key: str = "objeto_id") -> DataFrame:
    """(key, edge_mean, edge_std): of the lengths of forward differences, over cells with one at least."""
    g = neighbours(grid.where("n >= 4"), key, "v").where("right IS NOT NULL OR below IS NOT NULL")
    step = lambda c: F.coalesce(F.col(c) - F.col("v"), F.lit(0.0))
    size = F.sqrt(step("right") * step("right") + step("below") * step("below"))
    return g.select(key, size.alias("m")).groupBy(key).agg(F.avg("m").alias("edge_mean"), F.stddev_pop("m").alias("edge_std"))


def texture_features(grid: DataFrame, key: str = "objeto_id", levels: int = 8) -> DataFrame:
    """Texture and edges, as columns glcm_*."""
    ids = grid.select(key).distinct()
    t = texture(cooccurrence(quantized(grid, key, levels), key), ids, key)
    e = ids.join(edge_strength(grid, key), key, "left").fillna(0.0)
    return t.join(e, key).select(key, *(F.col(c).alias(f"glcm_{c}") for c in [*DEFAULTS, "edge_mean", "edge_std"]))
