"""The two diagnoses, composed of the operators: observability of a raster by a layer, and separability of its classes.

Each section is a small DataFrame of its own; pixels and features stay tables.  Nothing but rows of a fixed number (a row for
each band, lag, class pair or K) is meant to be collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import crs
from terralith.operators import compat, features, indexes, separability, spatial, stats, tsne, variogram
from terralith.sources import pixels as pixel_tables
from terralith.sources import raster, vector

NO_PAIRS = "a string, b string, r double"


def load(spark: SparkSession, raster_path: str, layer_path: str, class_field: str, layer_epsg: str | None = None) -> tuple[DataFrame, dict, DataFrame]:
    """(pixels, meta, objects) in the raster's coordinate system, validated.  ``layer_epsg`` is the layer's code, if it is another."""
    grid, meta = raster.read_raster(spark, raster_path)
    objects = vector.read_layer(spark, layer_path)
    if layer_epsg and meta.get("epsg"):
        objects = crs.aligned(objects, layer_epsg, meta["epsg"])
    objects = objects.persist()  # each reference to the polygons would parse the layer's text anew
    compat.validate(objects, meta, class_field)
    return grid, meta, objects


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    return stats.pearson(rows, columns) if len(columns) > 1 else rows.sparkSession.createDataFrame([], NO_PAIRS)


def observability(grid: DataFrame, meta: dict, objects: DataFrame, bands: list[str], class_field: str = "clase", band: str | None = None) -> dict[str, DataFrame]:
    """Sections extents, coverage, resolution, scale_histogram, spectral_stats, pearson, spearman, pca, moran, semivariogram_lags, semivariogram,
    toi; and the table pixels.  ``band`` is the one of the spatial structure (the first, if not given)."""
    band = band or bands[0]
    pixels = spatial.extract_pixels(grid, objects, meta, bands, clase=class_field).persist()
    means = spatial.zonal_mean(pixels, objects, band)
    points = spatial.centroids(objects).join(means, "objeto_id").persist()
    out = {
        "extents": compat.extents(objects, meta), "coverage": compat.coverage(objects, meta), "resolution": compat.resolution(objects, abs(meta["dx"] * meta["dy"])),
        "spectral_stats": stats.band_statistics(grid, bands), "pearson": correlations(grid, bands), "pca": stats.pca(grid, bands), "moran": spatial.morans_i(points),
        "semivariogram_lags": spatial.semivariogram(points),
    }
    out["scale_histogram"] = compat.scale_histogram(objects, abs(meta["dx"] * meta["dy"]))
    out["spearman"] = stats.spearman(grid, bands) if len(bands) > 1 else out["pearson"]
    out["semivariogram"] = variogram.semivariogram_fit(out["semivariogram_lags"], points)
    entropy = out["spectral_stats"].agg(F.avg("entropia").alias("entropy"))
    one = out["coverage"].crossJoin(out["resolution"]).crossJoin(entropy).crossJoin(stats.mean_abs_correlation(out["pearson"], len(bands))).crossJoin(out["moran"])  # one row each
    out["toi"] = one.select(*(c.alias(k) for k, c in indexes.toi(F.col("coverage_pct"), F.col("ratio_median"), F.col("entropy"), F.col("mean_abs_correlation"), F.col("moran_i")).items()))
    return out | {"pixels": pixels}


def separable(table: DataFrame, class_field: str = "clase", nulls: str = "error", filter_collinearity: bool = False, with_tsne: bool = True, most_clusters: int = 8, starts: int = 10) -> dict[str, DataFrame]:
    """Sections collinearity, pca, loadings, mutual_info, clustering, clusters, correspondence, purity, distances, tli (and tsne),
    and the table features with the columns that were kept."""
    names = separability.feature_columns(table, clase=class_field)
    rows = separability.without_missing(table, names, nulls).persist()
    if filter_collinearity:
        names = separability.prune_collinear(rows, names, class_field)
    pairs = separability.collinear_pairs(rows, names) if len(names) > 1 else rows.sparkSession.createDataFrame([], NO_PAIRS)
    pca = stats.pca(rows, names).persist()
    dimensions = pca.head()["effective_dim"]
    clustering, clusters = separability.kmeans(rows, names, most=most_clusters, starts=starts)
    labelled = rows.select("objeto_id", class_field).join(clusters, "objeto_id").persist()
    distances = separability.class_distances(stats.standardized(rows, names), names, class_field, dimensions)
    best = clustering.where("selected").agg(F.max("silhouette").alias("silhouette"))
    one = separability.mean_mahalanobis(distances).crossJoin(separability.global_purity(labelled, class_field)).crossJoin(best).crossJoin(separability.redundant_ratio(pairs, len(names)))  # one row each
    score = indexes.tli(F.col("mean_mahalanobis"), F.col("global_purity"), F.col("silhouette"), F.col("redundant_ratio"))
    out = {
        "collinearity": pairs, "pca": pca, "loadings": stats.loadings(rows, names), "mutual_info": separability.mutual_information(rows, names, class_field), "clustering": clustering,
        "clusters": clusters, "correspondence": separability.crosstab(labelled, class_field), "purity": separability.purity(labelled, class_field), "distances": distances,
        "tli": one.select(*(c.alias(k) for k, c in score.items())), "features": rows.select("objeto_id", class_field, *names),
    }
    return out | ({"tsne": tsne.tsne(rows, names)} if with_tsne else {})


def separability_of(grid: DataFrame, meta: dict, objects: DataFrame, bands: list[str], class_field: str = "clase", pixels: DataFrame | str | None = None, sensor: str | tuple[int, int, int] | None = None, **options: object) -> dict[str, DataFrame]:
    """``separable`` on the features of the layer's objects.  ``pixels`` (an earlier extraction, or the path of its CSV) saves the
    join; objects that it lacks are extracted from the raster, and all are if it can't be read."""
    if isinstance(pixels, str):
        pixels = pixel_tables.pixels_or(grid.sparkSession, pixels, bands, lambda: spatial.extract_pixels(grid, objects, meta, bands, clase=class_field))
    if pixels is not None and not {"row", "col"} <= set(pixels.columns):
        cell = lambda c, at, step: F.floor((F.col(c) - float(meta[at])) / float(meta[step])).cast("int")
        pixels = pixels.withColumns({"row": cell("pixel_y", "y0", "dy"), "col": cell("pixel_x", "x0", "dx")})
    if pixels is None or not set(bands) <= set(pixels.columns):
        pixels = spatial.extract_pixels(grid, objects, meta, bands, clase=class_field)
    else:
        missing = objects.join(pixels.select("objeto_id").distinct(), "objeto_id", "left_anti")
        pixels = pixels.unionByName(spatial.extract_pixels(grid, missing, meta, bands, clase=class_field).select(pixels.columns))
    return separable(features.extract_features(pixels, objects, bands, sensor, clase=class_field), class_field, **options)
