"""Shapes and neighbourhoods of objects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions import geometry as G
from terralith.operators.spatial import centroids, nearest


def shapes(objects: DataFrame, key: str = "objeto_id", polygons: str = "polygons") -> DataFrame:
    """(key, geom_*): area, perimeter and ratios of them; hull and rectangle come from one numpy pass."""
    g = F.col(polygons)
    rows = objects.where(G.present(g)).select(key, polygons, G.area(g).alias("a"), G.perimeter(g).alias("p"), G.hull_shape(g).alias("h"))
    a, p = F.col("a"), F.col("p")
    return rows.select(
        key, a.alias("geom_area"), p.alias("geom_perimeter"), G.circularity(a, p).alias("geom_circularity"),
        F.coalesce(F.try_divide(a, F.when(F.col("h.hull_area") > 0, F.col("h.hull_area"))), F.lit(1.0)).alias("geom_convexity"), F.col("h.elongation").alias("geom_elongation"),
        G.shape_index(a, p).alias("geom_shape_index"), G.shannon_shape(g).alias("geom_shannon_shape"), G.fractal_dimension(a, p).alias("geom_fractal_dim"),
    )


def touch_degree(objects: DataFrame, key: str = "objeto_id", polygons: str = "polygons", tolerance: float = 1e-9) -> DataFrame:
    """(key, neighbors): number of other objects whose boundary an object's boundary meets while their interiors don't.

    Candidates are objects whose boxes meet.  They are found on a grid of levels: the cells of a level are twice as wide as those
    of the next finer one, and a box's own level is the first whose cells are as wide as itself.  There it lies in four cells at
    most, and so it does on the coarser levels that some box has for its own, where it meets larger boxes.  A pair is looked at
    on the level of the larger box, in the one cell that holds the lower left corner of what the boxes share.
    """
    g = F.col(polygons)
    rows = objects.where(G.present(g)).select(F.col(key).alias("k"), g.alias("g"), G.bounds(g).alias("b"))
    size = F.greatest(F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0"))
    width = rows.agg(F.avg(size).alias("w")).head()["w"] or 1.0
    slack = tolerance * max(width, 1e-300)
    # boxes that are millions of times finer than the mean share a level
    rows = rows.withColumn("own", F.ceil(F.log2(F.greatest(size, F.lit(max(width, 1e-300) * 2.0**-20)))).cast("int"))
    levels = F.array(*(F.lit(r["own"]) for r in sorted(rows.select("own").distinct().collect())))  # no more than a double has exponents
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), "level")).cast("long")
    span = lambda axis: F.sequence(cell(F.col(f"b.{axis}0")), cell(F.col(f"b.{axis}1")))
    cells = rows.withColumn("level", F.explode(F.filter(levels, lambda v: v >= F.col("own")))).withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    place = ["level", "gx", "gy"]
    large = cells.where("level = own").select(*place, *(F.col(c).alias(f"{c}1") for c in "kgb"))
    small = cells.select(*place, "own", *(F.col(c).alias(f"{c}2") for c in "kgb"))
    meet = (F.col("b1.x0") <= F.col("b2.x1") + slack) & (F.col("b2.x0") <= F.col("b1.x1") + slack) & (F.col("b1.y0") <= F.col("b2.y1") + slack) & (F.col("b2.y0") <= F.col("b1.y1") + slack)
    corner = lambda axis: F.least(F.greatest(f"b1.{axis}0", f"b2.{axis}0"), F.col(f"b1.{axis}1"), F.col(f"b2.{axis}1"))
    once = (cell(corner("x")) == F.col("gx")) & (cell(corner("y")) == F.col("gy")) & ((F.col("own") < F.col("level")) | (F.col("k1") < F.col("k2")))
    pairs = large.join(small, place).where(meet & once)

    @F.pandas_udf("boolean")
    def touching(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([G.touches(json.loads(x), json.loads(y), tolerance) for x, y in zip(a, b, strict=True)], dtype=bool)

    # as text: rings of several lengths make no array
    hits = pairs.where(touching(F.to_json("g1"), F.to_json("g2"))).select(F.explode(F.array("k1", "k2")).alias("k"))
    return rows.select(F.col("k").alias(key)).join(hits.groupBy(F.col("k").alias(key)).agg(F.count("*").alias("neighbors")), key, "left").fillna(0, subset=["neighbors"])


def neighbourhood(objects: DataFrame, key: str = "objeto_id", polygons: str = "polygons") -> DataFrame:
    """(key, top_neighbors, top_proximity)."""
    near = nearest(centroids(objects, key, polygons), 3, key)
    degree = touch_degree(objects, key, polygons)
    return degree.join(near, key, "left").select(key, F.col("neighbors").cast("double").alias("top_neighbors"), F.col("proximity").alias("top_proximity"))
