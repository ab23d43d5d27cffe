"""Fitness of a raster and a polygon layer for each other: CRS, extents, coverage, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import geometry as G


class ValidationError(ValueError):
    """Input that no analysis can use."""


def same_crs(epsg_a: str | None, epsg_b: str | None, wkt_a: str | None, wkt_b: str | None) -> bool:
    """By EPSG code where both have one, else by WKT without regard to case."""
    if epsg_a and epsg_b:
        return epsg_a == epsg_b
    return bool(wkt_a and wkt_b) and wkt_a.strip().lower() == wkt_b.strip().lower()


def layer_bounds(objects: DataFrame, polygons: str = "polygons") -> DataFrame:
    """One row: x0, y0, x1, y1 of all geometries."""
    b = objects.where(G.present(F.col(polygons))).select(G.bounds(F.col(polygons)).alias("b"))
    return b.agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


def raster_bounds(meta: dict) -> tuple[float, float, float, float]:
    xs = sorted((meta["x0"], meta["x0"] + meta["width"] * meta["dx"]))
    ys = sorted((meta["y0"], meta["y0"] + meta["height"] * meta["dy"]))
    return float(xs[0]), float(ys[0]), float(xs[1]), float(ys[1])


def extents(objects: DataFrame, meta: dict, polygons: str = "polygons") -> DataFrame:
    """One row: the layer's and the raster's boxes, whether they overlap (touching: no), and the share of the layer's box in
    percent, 100 at most."""
    rx0, ry0, rx1, ry1 = map(F.lit, raster_bounds(meta))
    b = layer_bounds(objects, polygons)
    ix0, iy0, ix1, iy1 = F.greatest("x0", rx0), F.greatest("y0", ry0), F.least("x1", rx1), F.least("y1", ry1)
    overlap = (ix0 < ix1) & (iy0 < iy1)
    share = F.try_divide((ix1 - ix0) * (iy1 - iy0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) * 100
    return b.withColumns({"overlaps": overlap, "overlap_pct": F.when(overlap, F.least(F.coalesce(share, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)})


def coverage(objects: DataFrame, meta: dict, polygons: str = "polygons") -> DataFrame:
    """One row: total, inside (objects that meet the raster's box, touching included), coverage_pct."""
    hit = G.intersects_box(F.col(polygons), *map(F.lit, raster_bounds(meta)))
    n = F.count("*")
    return objects.agg(n.alias("total"), F.count_if(hit).alias("inside"), F.coalesce(F.try_divide(F.count_if(hit) * 100.0, n), F.lit(0.0)).alias("coverage_pct"))


def resolution(objects: DataFrame, pixel_area: float, polygons: str = "polygons") -> DataFrame:
    """One row: least, greatest, mean and population deviation of the areas above 0, and mean and median share of a pixel in
    them; nulls if there are none."""
    rows = objects.where(G.present(F.col(polygons))).select(G.area(F.col(polygons)).alias("a")).where("a > 0")
    ratio: Column = F.lit(float(pixel_area)) / F.col("a")
    return rows.agg(F.count("*").alias("n"), F.min("a").alias("area_min"), F.max("a").alias("area_max"), F.avg("a").alias("area_mean"), F.stddev_pop("a").alias("area_std"), F.avg(ratio).alias("ratio_mean"), F.median(ratio).alias("ratio_median"))


def scale_histogram(objects: DataFrame, pixel_area: float, bins: int = 20, polygons: str = "polygons", key: str = "objeto_id") -> DataFrame:
    """(bin, low, high, n): objects by a pixel's share of their area, in bins of equal width; bins without an object are left out."""
    shares = ratios(objects, pixel_area, polygons, key).select("ratio")
    span = shares.agg(F.min("ratio").alias("r0"), F.max("ratio").alias("r1"))
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("ratio") - F.col("r0"), F.col("r1") - F.col("r0")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = shares.crossJoin(F.broadcast(span)).groupBy(place.alias("bin"), "r0", "r1").agg(F.count("*").alias("n"))  # one row on the right
    edge = lambda k: F.col("r0") + (F.col("r1") - F.col("r0")) * k / bins
    return counts.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n")


def ratios(objects: DataFrame, pixel_area: float, polygons: str = "polygons", key: str = "objeto_id") -> DataFrame:
    """(key, ratio): a pixel's share of each object's area."""
    return objects.where(G.present(F.col(polygons))).select(key, (F.lit(float(pixel_area)) / G.area(F.col(polygons))).alias("ratio")).where("ratio > 0")


def validate(objects: DataFrame, meta: dict, class_field: str, polygons: str = "polygons") -> None:
    """Raises ValidationError unless the layer has the class column and objects, and meets the raster."""
    if class_field not in objects.columns:
        raise ValidationError(f"the layer has no column {class_field!r}; it has {', '.join(objects.columns)}")
    row = extents(objects, meta, polygons).head()
    if row["x0"] is None:
        raise ValidationError("the layer has no geometry")
    if not row["overlaps"]:
        raise ValidationError("the layer and the raster don't overlap")
