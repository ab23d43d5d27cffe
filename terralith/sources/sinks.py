"""Where results go: Parquet and CSV tables, layers as GeoJSON, GeoPackage and shapefile, ASCII grids, and HTML reports of small sections."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from terralith.operators import stats
from terralith.sources import charts
from terralith.sources.geopackage import GeoPackage
from terralith.sources.parts import local, polygon_columns
from terralith.sources.shapefile import Shapefile


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header, UTF-8."""
    df.write.option("header", True).option("encoding", "UTF-8").csv(path)


def write_geojson(features: DataFrame, objects: DataFrame, path: str, key: str = "objeto_id", polygons: str = "polygons") -> None:
    """Features with their geometry, joined by key, as lines of GeoJSON features (one text file for each partition)."""
    joined = features.drop(polygons).join(objects.select(key, polygons), key)
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.transform(F.col(polygons), lambda g: F.transform(g, ring)).alias("coordinates"))
    properties = F.struct(*(c for c in joined.columns if c != polygons))
    joined.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))).alias("value")).write.text(path)


def write_geopackage(features: DataFrame, path: str, layer: str = "objects", epsg: int = 0, overwrite: bool = False) -> None:
    """A folder of .gpkg files, one for each task, each with a spatial index; ``features`` has one column of polygons.

    A job that fails leaves nothing.  Numbers and truth values keep their types, all else is text.
    """
    _write(features, GeoPackage, path, overwrite, layer=layer, srs=str(epsg))


def write_shapefile(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder of shapefiles, one for each task, as ``write_geopackage``.  Names are cut to ten letters and told apart by numbers."""
    _write(features, Shapefile, path, overwrite)


def _write(features: DataFrame, source: type[DataSource], path: str, overwrite: bool, **options: str) -> None:
    if len(polygon_columns(features.schema)) != 1:
        raise ValueError("a layer has one column of polygons")
    if not overwrite and os.path.isdir(local(path)) and os.listdir(local(path)):
        raise FileExistsError(path)
    features.sparkSession.dataSource.register(source)
    features.write.format(source.name()).options(**options).mode("overwrite" if overwrite else "append").save(path)


def write_ascii_grid(pixels: DataFrame, meta: dict, path: str, band: str = "b1", nodata: float = -9999.0) -> None:
    """A folder of text parts that are an ASCII grid one after the other: a line for each row of ``pixels`` (row, col, band).

    Cells without a value, or without a row in ``pixels``, are ``nodata``.  A task holds a row of the grid at a time.
    """
    head = {"ncols": meta["width"], "nrows": meta["height"], "xllcorner": meta["x0"], "yllcorner": meta["y0"] + meta["dy"] * meta["height"], "cellsize": meta["dx"], "nodata_value": nodata}
    inside = pixels.where(F.col("row").between(0, meta["height"] - 1) & F.col("col").between(0, meta["width"] - 1))
    cell = F.struct(F.col("col").cast("int").alias("col"), F.coalesce(F.col(band).cast("string"), F.lit(str(nodata))).alias("text"))
    cells = inside.groupBy("row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = pixels.sparkSession.range(meta["height"]).select(F.col("id").cast("int").alias("row")).join(cells, "row", "left")
    # each value is told with the empty cells before it, so that a line takes as many steps as it has values
    empty = lambda n: F.when(n < 0, F.raise_error(F.lit("two values for one cell of the grid"))).otherwise(F.repeat(F.lit(f" {nodata}"), n))
    until = lambda i: F.coalesce(F.get("cells", i)["col"], F.lit(-1))
    told = F.transform("cells", lambda c, i: F.concat(empty(c["col"] - until(i - 1) - 1), F.lit(" "), c["text"]))
    line = F.concat(F.array_join(told, ""), empty(F.lit(meta["width"] - 1) - until(F.size("cells") - 1)))
    lines = rows.select("row", F.substring(F.coalesce(line, F.repeat(F.lit(f" {nodata}"), F.lit(meta["width"]))), 2, 1 << 30).alias("value"))
    first = pixels.sparkSession.createDataFrame([(-1, "\n".join(f"{k} {v!r}" for k, v in head.items()))], "row int, value string")
    lines.unionByName(first).orderBy("row").select("value").write.text(path)


def top(df: DataFrame, by: str, k: int, *ties: str) -> tuple[list[Row], int]:
    """(the ``k`` rows with the greatest ``by``, the number of all rows): ranked in Spark, equal ones by ``ties``."""
    rows = df.orderBy(F.desc_nulls_last(by), *ties).limit(k).collect()
    return rows, df.count() if len(rows) == k else len(rows)


def table(rows: list[Row], columns: list[str], total: int | None = None) -> str:
    """Rows as an HTML table; with a total that is greater, a line says so."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else html.escape(str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in columns) + "</tr>" for r in rows)
    more = f"<p>{len(rows)} of {total} rows</p>" if total is not None and total > len(rows) else ""
    return f"<table><tr>{head}</tr>{body}</table>{more}"


def page(title: str, parts: dict[str, str]) -> str:
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
    return head + "".join(f"<h2>{html.escape(name)}</h2>{part}" for name, part in parts.items()) + "</body></html>"


def report(title: str, sections: dict[str, DataFrame], most: int | None = None) -> str:
    """An HTML page of the sections, which are tables of a bounded size by nature, in the order of their rows' values.

    All rows are shown, or the first ``most`` with a line that states how many there are.
    """
    parts = {}
    for name, df in sections.items():
        ordered = df.orderBy(*df.columns)
        rows = (ordered if most is None else ordered.limit(most)).collect()
        drawn = charts.lines(name, {"gamma": [(r["h"], r["gamma"]) for r in rows]}, "h", "gamma") if {"h", "gamma"} <= set(df.columns) else ""
        parts[name] = drawn + table(rows, df.columns, None if most is None else df.count())
    return page(title, parts)


def observability_report(sections: dict[str, DataFrame], title: str = "Observability") -> str:
    """The first diagnosis as HTML: the index and its parts, band statistics, and four charts."""
    one = {name: sections[name].collect() for name in ("toi", "extents", "coverage", "resolution", "moran", "semivariogram")}
    small = {name: table(rows, sections[name].columns) for name, rows in one.items()}
    bands = sections["spectral_stats"].orderBy("band").collect()
    pairs = {(r["a"], r["b"]): r["r"] for r in sections["pearson"].collect()}  # a row for each two bands
    pca = sections["pca"].orderBy("component").collect()
    total = 0.0
    summed = [(r["component"], total := total + (r["ratio"] or 0.0)) for r in pca]
    lags = sections["semivariogram_lags"].orderBy("h").collect()
    fit = one["semivariogram"][0] if one["semivariogram"] else None
    series = {"lags": [(r["h"], r["gamma"]) for r in lags]}
    if fit is not None and lags and fit["range"]:
        span = [lags[-1]["h"] * k / 60 for k in range(61)]
        rises = lambda h: min(1.0, 1.5 * h / fit["range"] - 0.5 * (h / fit["range"]) ** 3 if h < fit["range"] else 1.0)
        series["spherical"] = [(h, fit["nugget"] + (fit["sill"] - fit["nugget"]) * rises(h)) for h in span]
    histogram = sections["scale_histogram"].orderBy("bin").collect()
    return page(
        title,
        {
            "Index": small["toi"],
            "Extents": small["extents"] + small["coverage"],
            "Scale": charts.bars("Cells to objects, by ratio of areas", [(f"{r['low']:.3g}", r["n"]) for r in histogram], "ratio", "objects") + small["resolution"],
            "Bands": table(bands, sections["spectral_stats"].columns),
            "Redundancy": charts.matrix("Correlation of bands", sorted({b for p in pairs for b in p}), pairs),
            "Components": charts.lines("Share of variance", {"each": [(r["component"], r["ratio"]) for r in pca], "summed": summed}, "component", "share", ["each"]),
            "Space": small["moran"] + charts.lines("Semivariogram", series, "distance", "semivariance", ["lags"]) + small["semivariogram"],
        },
    )


def separability_report(sections: dict[str, DataFrame], title: str = "Learnability", best: int = 12, heaviest: int = 6, redundant: int = 8, cells: int = 60) -> str:
    """The second diagnosis as HTML: the index, the ``best`` descriptors by mutual information, the ``heaviest`` loadings of the
    first component, the first ``redundant`` pairs, and five charts; lists state of how many rows they are the first."""
    mutual, n = top(sections["mutual_info"], "mi", best, "variable")
    names = [r["variable"] for r in mutual]
    pairs, n_pairs = top(sections["collinearity"].withColumn("size", F.abs("r")), "size", redundant, "a", "b")
    known = {(r["a"], r["b"]): r["r"] for r in sections["collinearity"].where(F.col("a").isin(names) & F.col("b").isin(names)).collect()}
    if "features" in sections and len(names) > 1:
        known = {(r["a"], r["b"]): r["r"] for r in stats.wide_pearson(sections["features"], names).collect()}
    first = sections["loadings"].where("component = 1").withColumn("size", F.abs("loading"))
    loadings, n_loadings = top(first, "size", heaviest, "variable")
    clustering = sections["clustering"].orderBy("k").collect()
    parts = {
        "Index": table(sections["tli"].collect(), sections["tli"].columns),
        "Descriptors": charts.bars("Mutual information with the class", [(r["variable"], r["mi"]) for r in mutual]) + table(mutual, ["variable", "mi"], n),
        "Correlation": charts.matrix("Correlation of the best descriptors", names, known) + table(pairs, ["a", "b", "r"], n_pairs),
        "First component": table(loadings, ["variable", "loading"], n_loadings),
        "Clusters": charts.lines("Clusters by number", {"silhouette": [(r["k"], r["silhouette"]) for r in clustering], "inertia, share of the first": [(r["k"], r["inertia"] / clustering[0]["inertia"]) for r in clustering if clustering[0]["inertia"]]}, "k")
        + table(clustering, sections["clustering"].columns),
        "Classes": table(sections["purity"].orderBy("clase").collect(), sections["purity"].columns) + table(sections["distances"].orderBy("a", "b").collect(), sections["distances"].columns),
    }
    if "tsne" in sections:
        who = sections["features"].select("objeto_id", "clase").join(sections["clusters"], "objeto_id")
        places = sections["tsne"].join(who, "objeto_id")
        drawn = []
        for by in ("clase", "cluster"):
            # one dot for each cell and group, whatever the number of objects
            span = places.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
            at = lambda c: F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")), F.lit(0.0)) * (cells - 1))
            dots = places.crossJoin(F.broadcast(span)).groupBy(F.col(by).cast("string").alias("g"), at("x").alias("gx"), at("y").alias("gy")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("g", "gx", "gy").collect()
            groups: dict[str, list[tuple[float, float]]] = {}
            for r in dots:
                groups.setdefault(str(r["g"]), []).append((r["x"], r["y"]))
            drawn.append(charts.lines(f"Objects in the plane, by {by}", groups, dots=list(groups)))
        parts["Plane"] = "".join(drawn)
    return page(title, parts)
