"""Polygon layers: GeoJSON, shapefile and GeoPackage, as (objeto_id, attributes, polygons).

``objeto_id`` is the place of a feature in its file, from 1; features without a geometry keep theirs, with null polygons.  A
path may name a layer: ``file.gpkg|layername=x``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from terralith.sources.geopackage import GeoPackage, layers
from terralith.sources.parts import part_files
from terralith.sources.shapefile import Shapefile

LAYER = "|layername="


def split_path(path: str) -> tuple[str, str | None]:
    """(file, layer)."""
    name, _, layer = path.partition(LAYER)
    return name, layer or None


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Attributes become columns of the types that Spark infers.  The file is one JSON document, so one task parses it."""
    doc = spark.read.json(path, multiLine=True)
    if "features" not in doc.columns:
        raise ValueError(f"{path} holds no features")
    rows = doc.select(F.posexplode("features").alias("pos", "f"))
    fields = {f.name for f in rows.schema["f"].dataType.fields}
    attributes = [c.name for c in rows.schema["f"].dataType["properties"].dataType.fields] if "properties" in fields and isinstance(rows.schema["f"].dataType["properties"].dataType, StructType) else []
    text = F.to_json("f.geometry") if "geometry" in fields else F.lit(None).cast("string")
    return rows.select((F.col("pos") + 1).cast("long").alias("objeto_id"), *(F.col(f"f.properties.`{a}`").alias(a) for a in attributes), geometry(text).alias("polygons"))


def geometry(text: Column) -> Column:
    """Polygons of a GeoJSON geometry; null for anything but (multi)polygons and for empty ones."""
    kind = F.get_json_object(text, "$.type")
    coordinates = F.get_json_object(text, "$.coordinates")
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    raw = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    g = F.transform(raw, lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))
    return F.when(F.size(F.flatten(g)) > 0, g)


def read_shapefile(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, records: int = 20_000) -> DataFrame:
    """A .shp file or a folder of them, ``records`` features a task; attributes are text.  ``box`` leaves features whose box meets it."""
    return _load(spark, Shapefile, path, box, records)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, box: tuple[float, float, float, float] | None = None, records: int = 20_000) -> DataFrame:
    """A layer of a GeoPackage, or of a folder of them (the first feature table, if none is named); as ``read_shapefile``."""
    return _load(spark, GeoPackage, path, box, records, layer=layer)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(path, layer, title, geometry_type, epsg) of the layers and rasters in a folder; a path that ``read_layer`` or ``read_raster`` takes."""
    from terralith.sources import raster

    rows: list[tuple[str, str, str, str | None, int | None]] = []
    for ending in (".asc", ".tif", ".tiff", ".geojson", ".shp", ".gpkg"):
        for file in part_files(folder, ending):
            name = os.path.splitext(os.path.basename(file))[0]
            if ending == ".gpkg":
                rows += [(f"{file}{LAYER}{layer}", layer, title, kind, srs if srs > 0 else None) for layer, title, _, kind, srs in layers(file)]
            elif ending in (".tif", ".tiff"):
                code = raster.tiff_meta(file)["epsg"]
                rows.append((file, name, name, "RASTER", int(code.split(":")[1]) if code else None))
            else:
                rows.append((file, name, name, "RASTER" if ending == ".asc" else "MULTIPOLYGON" if ending == ".shp" else None, None))
    return spark.createDataFrame(rows, "path string, layer string, title string, geometry_type string, epsg int")


def _load(spark: SparkSession, source: type[DataSource], path: str, box: tuple | None, records: int, **options: str | None) -> DataFrame:
    spark.dataSource.register(source)
    options |= {"records": str(records), "box": ",".join(map(repr, map(float, box))) if box else None}
    return spark.read.format(source.name()).options(**{k: v for k, v in options.items() if v is not None}).load(path)


def read_layer(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """By the file's ending.  ``box`` (xmin, ymin, xmax, ymax) leaves features whose box meets it, where the format can tell."""
    file, layer = split_path(path)
    ending = os.path.splitext(file)[1].lower()
    if ending in (".geojson", ".json"):
        out = read_geojson(spark, file)
    elif ending == ".shp":
        out = read_shapefile(spark, file, box)
    elif ending == ".gpkg":
        out = read_geopackage(spark, file, layer, box)
    else:
        raise ValueError(f"{path}: layers are .geojson, .shp or .gpkg")
    if out.isEmpty():
        raise ValueError(f"{path} holds no features")
    return out
