"""The feature table: one row of descriptors for each object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions import geometry as G
from terralith.operators import stats, texture, topology, variogram

# Sensor presets, as 1-based band numbers of green, red and near infrared.
SENSORS = {"landsat8": (3, 4, 5), "landsat9": (3, 4, 5), "sentinel2": (3, 4, 8)}

BAND_STATISTICS = ["mean", "median", "std", "min", "max", "p25", "p75", "skew", "kurt", "mad", "entropy"]
INDEX_STATISTICS = ["mean", "std", "min", "max"]
GEOMETRY = ["area", "perimeter", "circularity", "convexity", "elongation", "shape_index", "shannon_shape", "fractal_dim"]
#: What an object without pixels gets instead of nulls.
WITHOUT_PIXELS = {f"geom_{g}": 0.0 for g in GEOMETRY} | {"geom_convexity": 1.0, "geom_elongation": 1.0, "geom_fractal_dim": 1.0, "top_neighbors": 0.0}


def feature_names(n_bands: int) -> list[str]:
    """All descriptors in the table's order (greedy pruning depends on it)."""
    bands = [f"b{k}_{s}" for k in range(1, n_bands + 1) for s in BAND_STATISTICS]
    texture_names = [f"glcm_{t}" for t in [*texture.DEFAULTS, "edge_mean", "edge_std"]]
    return [*bands, *(f"{i}_{s}" for i in ("ndvi", "ndwi") for s in INDEX_STATISTICS), *texture_names, *(f"var_{d}" for d in variogram.DESCRIPTORS), *(f"geom_{g}" for g in GEOMETRY), "top_neighbors", "top_proximity"]


def band(number: int | None, bands: list[str]) -> str | None:
    """The column of a 1-based band number; None if there is no such band."""
    return bands[number - 1] if number and 1 <= number <= len(bands) else None


def extract_features(pixels: DataFrame, objects: DataFrame, bands: list[str], sensor: str | tuple[int, int, int] | None = None, key: str = "objeto_id", clase: str = "clase", grid: str = "exact") -> DataFrame:
    """key, clase and ``feature_names``: from pixels (key, row, col, pixel_x, pixel_y, bands) and objects (key, clase, polygons).

    Each family is a grouping by object; they are joined by key, which they are all partitioned by.  Indices are null without
    the bands they need.  An object without pixels gets WITHOUT_PIXELS and nulls.  A ``clase`` that the objects lack is
    'Desconocida'.
    """
    if clase not in objects.columns:
        objects = objects.withColumn(clase, F.lit("Desconocida"))
    objects = objects.where(G.present(F.col("polygons")))
    full = pixels.dropna(subset=bands).persist()
    renamed = {b: f"b{k}" for k, b in enumerate(bands, 1)}
    long = stats.object_band_statistics(full.withColumnsRenamed(renamed), list(renamed.values()), key)
    wide = long.groupBy(key).pivot("band", list(renamed.values())).agg(*(F.first(s).alias(s) for s in BAND_STATISTICS))
    green, red, nir = (band(n, bands) for n in (SENSORS[sensor] if isinstance(sensor, str) else sensor or (None, None, None)))
    parts = [wide]
    for name, a, b in (("ndvi", nir, red), ("ndwi", green, nir)):
        if a and b:
            parts.append(stats.normalized_index(full, a, b, name, key))
    scored = texture.local_component(full, bands, key)
    parts.append(texture.texture_features(texture.cells(scored, "pc1", key, grid), key))
    parts.append(variogram.local_variograms(scored, "pc1", key))
    parts.append(topology.shapes(objects, key))
    parts.append(topology.neighbourhood(objects, key))
    out = objects.select(key, clase)
    for part in parts:
        out = out.join(part, key, "left")
    empty = F.col("b1_mean").isNull()
    names = feature_names(len(bands))
    fixed = {c: F.when(empty, F.lit(v)).otherwise(F.col(c)) for c, v in WITHOUT_PIXELS.items()} | {"top_proximity": F.when(~empty, F.col("top_proximity"))}
    out = out.withColumns({c: F.lit(None).cast("double") for c in names if c not in out.columns}).withColumns(fixed)
    return out.select(key, clase, *(F.col(c).cast("double").alias(c) for c in names))
