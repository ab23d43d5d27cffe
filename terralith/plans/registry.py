"""Registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import geometry as G
from terralith.operators import compat, features, indexes, separability, spatial, stats, texture, topology, tsne, variogram
from terralith.plans import engine
from terralith.plans import fixtures as X
from terralith.sources import raster, sinks, vector
from terralith.sources.parts import shared_folder
from terralith.sources.shapefile import apart

BANDS = ["b1", "b2", "b3", "b4", "b5"]
NUMERIC = ["f0", "f1", "f2", "f3", "f4", "f5", "f_sig", "f_col"]
META = {"x0": -1007.0, "dx": 30.0, "y0": 3000.0, "dy": -30.0, "width": 700, "height": 80}

EVERY = [*(f"f{i}" for i in range(X.EVERY)), "f_sig", "f_col"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, digits: int = 5, **more: int) -> Callable:
    """Registers a function by its name; doubles of its result are rounded, as those of the oracle are (``more``: by column)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            # adding 0 turns a negative zero into a plain one
            return df.select(*((F.round(c, more.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(x: str, name: str, digits: int = 5) -> str:
    return f"round({x}, {digits}) + 0.0e0 AS {name}"


def melt(bands: list[str], source: str = "pixels") -> str:
    return " UNION ALL ".join(f"SELECT objeto_id, '{b}' AS band, {b} AS x FROM {source}" for b in bands)


LONG = X.WITH + f", long AS ({melt(BANDS)}), mid AS (SELECT *, avg(x) OVER w AS mu, median(x) OVER w AS med, min(x) OVER w AS low, max(x) OVER w AS high, count(*) OVER w AS n FROM long WINDOW w AS (PARTITION BY objeto_id, band))"
SKEW = "CASE WHEN count(*) > 2 AND var_pop(x) > 0 THEN avg(power(x - mu, 3)) / nullif(power(var_pop(x), 1.5e0), 0) ELSE 0 END"
KURT = "CASE WHEN count(*) > 2 AND var_pop(x) > 0 THEN avg(power(x - mu, 4)) / nullif(power(var_pop(x), 2), 0) - 3 ELSE 0 END"


def entropy_sql(bins: int) -> str:
    bin_ = f"least(CASE WHEN high > low THEN floor((x - low) / (high - low) * {bins}) ELSE 0 END, {bins - 1})"
    return f"SELECT objeto_id, band, abs(sum(-p * log2(p))) AS entropy FROM (SELECT objeto_id, band, count(*) / max(n) AS p FROM mid GROUP BY objeto_id, band, {bin_}) h GROUP BY objeto_id, band"


#: Quantiles and means of the tables' decimals are decimals of some more places; rounding them earlier would meet ties.
EXACT = {"mean": 8, "median": 8, "min": 8, "max": 8, "p25": 8, "p75": 8, "mad": 8}


@query(
    LONG + f""", e AS ({entropy_sql(16)}), s AS (SELECT objeto_id, band, count(*) AS n, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std, min(x) AS min, max(x) AS max,
      quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, {SKEW} AS skew, {KURT} AS kurt, median(abs(x - med)) AS mad FROM mid GROUP BY objeto_id, band)
    SELECT s.objeto_id, s.band, n, """ + ", ".join(r(c, c, EXACT.get(c, 5)) for c in ("mean", "median", "std", "min", "max", "p25", "p75", "skew", "kurt", "mad", "entropy")) + " FROM s JOIN e ON s.objeto_id = e.objeto_id AND s.band = e.band",
    **EXACT,
)
def object_band_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.object_band_statistics(X.pixels(spark, d), BANDS)


@query(
    X.WITH + f""", long AS ({melt(['b1', 'b2', 'b3', 'b4', 'b8'])}), mid AS (SELECT *, avg(x) OVER w AS mu, min(x) OVER w AS low, max(x) OVER w AS high, count(*) OVER w AS n FROM long WINDOW w AS (PARTITION BY band)),
    e AS (SELECT band, abs(sum(-p * log2(p))) AS entropia FROM (SELECT band, count(*) / max(n) AS p FROM mid GROUP BY band, least(CASE WHEN high > low THEN floor((x - low) / (high - low) * 256) ELSE 0 END, 255)) h GROUP BY band),
    s AS (SELECT band, avg(x) AS media, var_pop(x) AS varianza, stddev_pop(x) AS std, avg(power(x - mu, 3)) / power(var_pop(x), 1.5e0) AS asimetria, avg(power(x - mu, 4)) / power(var_pop(x), 2) - 3 AS curtosis, count(*) AS total_pixeles FROM mid GROUP BY band)
    SELECT s.band, total_pixeles, """ + ", ".join(r(c, c, 4) for c in ("media", "varianza", "std", "asimetria", "curtosis", "entropia")) + " FROM s JOIN e ON s.band = e.band", 4,
)
def band_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.band_statistics(X.pixels(spark, d), ["b1", "b2", "b3", "b4", "b8"])


CORR = ["b1", "b2", "b3", "b4", "b5", "b6"]
PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]


@query(X.WITH + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r', 4)} FROM pixels" for a, b in PAIRS), 4)
def band_pearson(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson(X.pixels(spark, d), CORR)


RANKS = ", ".join(f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0e0 AS {b}" for b in CORR)


@query(X.WITH + f", ranks AS (SELECT {RANKS} FROM pixels) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r', 4)} FROM ranks" for a, b in PAIRS), 4)
def band_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(X.pixels(spark, d), CORR)


@query(X.WITH + " SELECT round((" + " + ".join(f"abs(corr({a}, {b}))" for a, b in PAIRS) + f") * 2 / {len(CORR) * (len(CORR) - 1)}, 4) + 0.0e0 AS mean_abs_correlation FROM pixels", 4)
def mean_abs_correlation(spark: SparkSession, d: str) -> DataFrame:
    return stats.mean_abs_correlation(stats.pearson(X.pixels(spark, d), CORR), len(CORR))


def index_sql(a: str, b: str, name: str) -> str:
    v = f"CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) ELSE 0 END"
    return X.WITH + f" SELECT objeto_id, {r(f'avg({v})', name + '_mean')}, {r(f'stddev_pop({v})', name + '_std')}, {r(f'min({v})', name + '_min')}, {r(f'max({v})', name + '_max')} FROM pixels GROUP BY objeto_id"


NODATA = ["b1", "b3", "b4"]


def with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Pixels whose value 0 means that there is none."""
    return X.pixels(spark, d).withColumns({b: F.nullif(F.col(b).cast("double"), F.lit(0.0)) for b in NODATA})


NUMBERED = ", ".join(f"n{b} AS (SELECT row_number() OVER (ORDER BY objeto_id, r, c) AS k, CAST({b} AS DOUBLE) AS {b} FROM pixels WHERE {b} <> 0)" for b in NODATA)


@query(X.WITH + f", {NUMBERED} SELECT nb1.k, " + ", ".join(r(b, b) for b in NODATA) + " FROM nb1 JOIN nb3 ON nb1.k = nb3.k JOIN nb4 ON nb1.k = nb4.k")
def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.positional(with_gaps(spark, d), NODATA, ["objeto_id", "r", "c"])


@query(
    X.WITH + f", {NUMBERED}, z AS (SELECT b1, b3, b4 FROM nb1 JOIN nb3 ON nb1.k = nb3.k JOIN nb4 ON nb1.k = nb4.k) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')} FROM z" for a, b in (("b1", "b3"), ("b1", "b4"), ("b3", "b4")))
)
def positional_pearson(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson(stats.positional(with_gaps(spark, d), NODATA, ["objeto_id", "r", "c"]), NODATA)


@query(index_sql("b1", "b3", "ndvi"))
def object_ndvi(spark: SparkSession, d: str) -> DataFrame:
    return stats.ndvi(X.pixels(spark, d), "b1", "b3")


@query(index_sql("b3", "b4", "ndwi"))
def object_ndwi(spark: SparkSession, d: str) -> DataFrame:
    return stats.ndwi(X.pixels(spark, d), "b3", "b4")


@query(X.WITH + f" SELECT o.objeto_id, {r('coalesce(avg(p.b2), 0)', 'value')} FROM objects o LEFT JOIN pixels p ON o.objeto_id = p.objeto_id GROUP BY o.objeto_id")
def zonal_mean(spark: SparkSession, d: str) -> DataFrame:
    return spatial.zonal_mean(X.pixels(spark, d), X.objects(spark, d), "b2")


def raster_of(pixels: DataFrame, meta: dict) -> DataFrame:
    """A raster made of the pixels: row, col of ``meta``, with bands."""
    col, row = F.floor((F.col("pixel_x") - meta["x0"]) / meta["dx"]).cast("int"), F.floor((F.col("pixel_y") - meta["y0"]) / meta["dy"]).cast("int")
    return pixels.select(row.alias("row"), col.alias("col"), "b1", "b2").groupBy("row", "col").agg(F.max("b1").alias("b1"), F.max("b2").alias("b2"))


def whole_meta(spark: SparkSession, d: str) -> dict:
    """A raster of 30 by 30 from the upper left corner of all objects, as wide and high as objects and pixels reach."""
    o = X.objects(spark, d).agg(F.min("xmin").alias("x0"), F.max("ymax").alias("y0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y1")).head()
    p = X.pixels(spark, d).agg(F.min("pixel_x").alias("x0"), F.max("pixel_y").alias("y0"), F.max("pixel_x").alias("x1"), F.min("pixel_y").alias("y1")).head()
    x0, y0 = min(o["x0"], p["x0"] - 15), max(o["y0"], p["y0"] + 15)
    return {"x0": x0, "dx": 30.0, "y0": y0, "dy": -30.0, "width": math.ceil((max(o["x1"], p["x1"] + 15) - x0) / 30), "height": math.ceil((y0 - min(o["y1"], p["y1"] - 15)) / 30)}


EXTRACTION = X.WITH + """, o AS (SELECT min(xmin) AS x0, max(ymax) AS y0, max(xmax) AS x1, min(ymin) AS y1 FROM objects), p AS (SELECT min(pixel_x) - 15.0e0 AS x0, max(pixel_y) + 15.0e0 AS y0, max(pixel_x) + 15.0e0 AS x1, min(pixel_y) - 15.0e0 AS y1 FROM pixels),
    b AS (SELECT least(o.x0, p.x0) AS x0, greatest(o.y0, p.y0) AS y0, greatest(o.x1, p.x1) AS x1, least(o.y1, p.y1) AS y1 FROM o, p), meta AS (SELECT x0, y0, CAST(ceil((x1 - x0) / 30.0e0) AS INT) AS width, CAST(ceil((y0 - y1) / 30.0e0) AS INT) AS height FROM b),
    grid AS (SELECT CAST(floor((pixel_y - y0) / -30.0e0) AS INT) AS "row", CAST(floor((pixel_x - x0) / 30.0e0) AS INT) AS col, max(b1) AS b1, max(b2) AS b2 FROM pixels, meta GROUP BY 1, 2),
    placed AS (SELECT g.*, x0 + (col + 0.5e0) * 30.0e0 AS pixel_x, y0 - ("row" + 0.5e0) * 30.0e0 AS pixel_y FROM grid g, meta),
    inside AS (SELECT o.objeto_id, o.clase, g.* FROM placed g JOIN objects o ON g.pixel_x > o.xmin AND g.pixel_x < o.xmax AND g.pixel_y > o.ymin AND g.pixel_y < o.ymax),
    alone AS (SELECT objeto_id, clase, least(greatest(CAST(trunc(((xmin + xmax) / 2 - x0) / 30.0e0) AS INT), 0), width - 1) AS col, least(greatest(CAST(trunc(((ymin + ymax) / 2 - y0) / -30.0e0) AS INT), 0), height - 1) AS "row"
      FROM objects, meta WHERE objeto_id NOT IN (SELECT objeto_id FROM inside)),
    every AS (SELECT objeto_id, clase, pixel_x, pixel_y, "row", col, b1, b2 FROM inside UNION ALL
      SELECT a.objeto_id, a.clase, g.pixel_x, g.pixel_y, g."row", g.col, g.b1, g.b2 FROM alone a JOIN placed g ON a."row" = g."row" AND a.col = g.col)"""


@query(EXTRACTION + " SELECT objeto_id, clase, " + ", ".join(r(c, c) for c in ("pixel_x", "pixel_y", "b1", "b2")) + ', "row", col FROM every'
)
def pixel_extraction_pip(spark: SparkSession, d: str) -> DataFrame:
    meta = whole_meta(spark, d)
    return spatial.extract_pixels(raster_of(X.pixels(spark, d), meta), X.with_polygons(X.objects(spark, d)), meta, ["b1", "b2"])


def with_far_polygons(objects: DataFrame) -> DataFrame:
    """``with_polygons`` with a hole in each rectangle and, for every second object, a second rectangle 20 units wide above it."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col

    def ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0), point(x0, y0))

    main = F.array(ring(c("xmin"), c("ymin"), c("xmax"), c("ymax")), ring(c("xmin") + 10, c("ymin") + 10, c("xmin") + 30, c("ymin") + 40))
    more = F.array(ring(c("xmin"), c("ymax") + 1, c("xmin") + 20, c("ymax") + 11))
    return objects.withColumn("polygons", F.when(c("objeto_id") % 2 == 0, F.array(main, more)).otherwise(F.array(main)))


LAYER_SQL = X.WITH + """, a AS (SELECT objeto_id, clase, (xmax - xmin) * (ymax - ymin) - 600.0e0 + CASE WHEN objeto_id % 2 = 0 THEN 200.0e0 ELSE 0.0e0 END AS geom_area,
  2 * (xmax - xmin + ymax - ymin) + 100.0e0 + CASE WHEN objeto_id % 2 = 0 THEN 60.0e0 ELSE 0.0e0 END AS geom_perimeter, xmin, ymax FROM objects)
SELECT objeto_id, clase, xmin + ymax / 3 AS reference_value, ymax - 1 AS reference_value_above, """ + r("geom_area", "geom_area") + ", " + r("geom_perimeter", "geom_perimeter") + " FROM a"


def reread(spark: SparkSession, d: str, write: Callable, read: Callable, cut: int) -> DataFrame:
    """All objects with two long-named values, written as a layer of several files and read back, with sizes of what was read.

    ``cut`` letters of the values' names are kept by the format.
    """
    objects = with_far_polygons(X.objects(spark, d))
    values = objects.select("clase", F.col("objeto_id").alias("number"), (F.col("xmin") + F.col("ymax") / 3).alias("reference_value"), (F.col("ymax") - 1).alias("reference_value_above"), "polygons")
    path = shared_folder(spark, "layer")
    write(values.repartition(4, "number"), path)
    one, other = apart(["reference_value", "reference_value_above"], (), cut)
    g = F.col("polygons")
    return read(spark, path).select(
        F.col("number").cast("long").alias("objeto_id"), "clase", F.col(one).cast("double").alias("reference_value"), F.col(other).cast("double").alias("reference_value_above"),
        G.area(g).alias("geom_area"), G.perimeter(g).alias("geom_perimeter"),
    )


@query(LAYER_SQL, reference_value=12, reference_value_above=12)
def geopackage_layer(spark: SparkSession, d: str) -> DataFrame:
    return reread(spark, d, sinks.write_geopackage, lambda s, path: vector.read_geopackage(s, path, records=64), 1 << 20)


@query(LAYER_SQL, reference_value=12, reference_value_above=12)
def shapefile_layer(spark: SparkSession, d: str) -> DataFrame:
    return reread(spark, d, sinks.write_shapefile, lambda s, path: vector.read_shapefile(s, path, records=64), 10)


WINDOW = (2000.0, 500.0, 9000.0, 1900.0)


@query(
    X.WITH + f""" SELECT objeto_id, {r('(xmax - xmin) * (ymax - ymin) - 600.0e0 + CASE WHEN objeto_id % 2 = 0 THEN 200.0e0 ELSE 0.0e0 END', 'geom_area')} FROM objects
    WHERE xmin <= {WINDOW[2]}e0 AND xmax >= {WINDOW[0]}e0 AND ymin <= {WINDOW[3]}e0 AND ymax + CASE WHEN objeto_id % 2 = 0 THEN 11.0e0 ELSE 0.0e0 END >= {WINDOW[1]}e0"""
)
def layer_window(spark: SparkSession, d: str) -> DataFrame:
    """Objects whose box meets a window, by the spatial index of each file."""
    path = shared_folder(spark, "layer")
    sinks.write_geopackage(with_far_polygons(X.objects(spark, d)).select("objeto_id", "polygons").repartition(4, "objeto_id"), path)
    found = vector.read_geopackage(spark, path, box=WINDOW, records=64)
    return found.select(F.col("objeto_id_1").cast("long").alias("objeto_id"), G.area(F.col("polygons")).alias("geom_area"))


@query(
    X.WITH + """, o AS (SELECT min(xmin) AS x0, max(ymax) AS y0, max(xmax) AS x1, min(ymin) AS y1 FROM objects), p AS (SELECT min(pixel_x) - 15.0e0 AS x0, max(pixel_y) + 15.0e0 AS y0, max(pixel_x) + 15.0e0 AS x1, min(pixel_y) - 15.0e0 AS y1 FROM pixels),
    b AS (SELECT least(o.x0, p.x0) AS x0, greatest(o.y0, p.y0) AS y0, greatest(o.x1, p.x1) AS x1, least(o.y1, p.y1) AS y1 FROM o, p),
    g AS (SELECT CAST(floor((pixel_y - y0) / -30.0e0) AS INT) AS "row", CAST(floor((pixel_x - x0) / 30.0e0) AS INT) AS col, max(b2) AS b1 FROM pixels, b GROUP BY 1, 2)
    SELECT "row", count(*) AS n, CAST(sum(col) AS BIGINT) AS cols, """ + ", ".join(r(f"{e}(b1)", c, 6) for e, c in (("sum", "total"), ("min", "low"), ("max", "high"))) + ' FROM g GROUP BY "row"',
    6,
)
def ascii_grid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a raster of all pixels, written as an ASCII grid and read back by splits of its text."""
    meta = whole_meta(spark, d)
    path = shared_folder(spark, "grid")
    sinks.write_ascii_grid(raster_of(X.pixels(spark, d), meta), meta, path, "b2")
    grid, _ = raster.read_ascii_grid(spark, path)
    return grid.where("b1 IS NOT NULL").groupBy("row").agg(F.count("*").alias("n"), F.sum("col").alias("cols"), F.sum("b1").alias("total"), F.min("b1").alias("low"), F.max("b1").alias("high"))


@query(
    X.WITH + f""", a AS (SELECT 900.0e0 / ((xmax - xmin) * (ymax - ymin)) AS x FROM objects), s AS (SELECT min(x) AS r0, max(x) AS r1 FROM a),
    c AS (SELECT CAST(least(CASE WHEN r1 > r0 THEN floor((x - r0) / (r1 - r0) * 20) ELSE 0 END, 19) AS INT) AS bin, r0, r1, count(*) AS n FROM a, s GROUP BY 1, 2, 3)
    SELECT bin, {r('r0 + (r1 - r0) * bin / 20', 'low', 8)}, {r('r0 + (r1 - r0) * (bin + 1) / 20', 'high', 8)}, n FROM c""", 8,
)
def scale_histogram(spark: SparkSession, d: str) -> DataFrame:
    return compat.scale_histogram(X.with_polygons(X.objects(spark, d)), 900.0)


FAR = "sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2))"
CLIPPED = "least(greatest({}, 0), 100)"


@query(
    EXTRACTION + f""", size AS (SELECT *, (xmax - xmin) * (ymax - ymin) AS area, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM objects),
    cover AS (SELECT count(*) FILTER (WHERE xmin <= x0 + 30 * width AND xmax >= x0 AND ymin <= y0 AND ymax >= y0 - 30 * height) * 100.0e0 / count(*) AS pct, median(900.0e0 / area) AS ratio FROM size, meta),
    long AS (SELECT 'b1' AS band, b1 AS x FROM grid UNION ALL SELECT 'b2', b2 FROM grid), mid AS (SELECT *, min(x) OVER w AS low, max(x) OVER w AS high, count(*) OVER w AS n FROM long WINDOW w AS (PARTITION BY band)),
    e AS (SELECT band, abs(sum(-p * log2(p))) AS h FROM (SELECT band, count(*) / max(n) AS p FROM mid GROUP BY band, least(CASE WHEN high > low THEN floor((x - low) / (high - low) * 256) ELSE 0 END, 255)) q GROUP BY band),
    v AS (SELECT o.objeto_id, o.cx, o.cy, coalesce(avg(p.b2), 0) AS value FROM size o LEFT JOIN every p ON o.objeto_id = p.objeto_id GROUP BY ALL), z AS (SELECT objeto_id, cx, cy, value - (SELECT avg(value) FROM v) AS z FROM v),
    lagged AS (SELECT a.objeto_id, max(a.z) AS z, sum(b.z / {FAR}) / sum(1 / {FAR}) AS lag FROM z a JOIN z b ON a.objeto_id <> b.objeto_id GROUP BY a.objeto_id),
    s AS (SELECT {CLIPPED.format('pct')} AS cobertura, {CLIPPED.format('(1 - ratio) * 100')} AS resolucion, {CLIPPED.format('(SELECT avg(h) FROM e) / 8 * 100')} AS informacion,
      {CLIPPED.format('(1 - (SELECT abs(corr(b1, b2)) FROM grid)) * 100')} AS redundancia, {CLIPPED.format('(SELECT sum(z * lag) FROM lagged) / (SELECT sum(z * z) FROM z) * 100')} AS estructura FROM cover),
    t AS (SELECT *, 0.2e0 * cobertura + 0.25e0 * resolucion + 0.25e0 * informacion + 0.15e0 * redundancia + 0.15e0 * estructura AS toi FROM s)
    SELECT CASE WHEN toi >= 80 THEN '{indexes.TOI_LABELS[0]}' WHEN toi >= 60 THEN '{indexes.TOI_LABELS[1]}' WHEN toi >= 40 THEN '{indexes.TOI_LABELS[2]}' ELSE '{indexes.TOI_LABELS[3]}' END AS categoria, """
    + ", ".join(r(c, c, 4) for c in ("toi", "cobertura", "resolucion", "informacion", "redundancia", "estructura")) + " FROM t", 4,
)
def observability_index(spark: SparkSession, d: str) -> DataFrame:
    """The first diagnosis as a whole, over a raster of all pixels and a layer of all objects."""
    meta = whole_meta(spark, d)
    grid = raster_of(X.pixels(spark, d), meta)
    return engine.observability(grid, meta, X.with_polygons(X.objects(spark, d)), ["b1", "b2"], band="b2")["toi"]


@query()
def learnability_index(spark: SparkSession, d: str) -> DataFrame:
    """The second diagnosis as a whole, over all columns of the feature table.  K-means has no SQL."""
    features = X.all_features(spark, d).drop("label", "f_const", "cluster")
    return engine.separable(features, with_tsne=False)["tli"]


@query(
    f"""WITH long AS (SELECT vec_id, i, 'f' || i AS v, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range({X.EVERY}) t(i)
      UNION ALL SELECT vec_id, {X.EVERY}, 'f_sig', CAST(embedding[2] AS DOUBLE) + 0.1e0 * label FROM embeddings
      UNION ALL SELECT vec_id, {X.EVERY + 1}, 'f_col', 0.95e0 * CAST(embedding[2] AS DOUBLE) + 0.05e0 * CAST(embedding[3] AS DOUBLE) FROM embeddings),
    c AS (SELECT a.v AS a, b.v AS b, corr(a.x, b.x) AS r FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.v, b.v)
    SELECT a, b, {r('r', 'r')} FROM c ORDER BY abs(r) DESC, a, b LIMIT 8"""
)
def redundant_pairs_top8(spark: SparkSession, d: str) -> DataFrame:
    """The eight pairs of all columns that are most alike, as the report shows them."""
    pairs = stats.wide_pearson(X.all_features(spark, d), EVERY)
    return pairs.orderBy(F.desc_nulls_last(F.abs("r")), "a", "b").limit(8)


BOX = "-1007.0e0 AS rx0, 600.0e0 AS ry0, 19993.0e0 AS rx1, 3000.0e0 AS ry1"


@query(
    X.WITH + f""", b AS (SELECT min(xmin) AS x0, min(ymin) AS y0, max(xmax) AS x1, max(ymax) AS y1, {BOX} FROM objects)
    SELECT {r('x0', 'x0')}, {r('y0', 'y0')}, {r('x1', 'x1')}, {r('y1', 'y1')}, greatest(x0, rx0) < least(x1, rx1) AND greatest(y0, ry0) < least(y1, ry1) AS overlaps,
    {r('CASE WHEN greatest(x0, rx0) < least(x1, rx1) AND greatest(y0, ry0) < least(y1, ry1) THEN least(100, (least(x1, rx1) - greatest(x0, rx0)) * (least(y1, ry1) - greatest(y0, ry0)) / ((x1 - x0) * (y1 - y0)) * 100) ELSE 0 END', 'overlap_pct')} FROM b"""
)
def extent_overlap(spark: SparkSession, d: str) -> DataFrame:
    return compat.extents(X.with_polygons(X.objects(spark, d)), META)


@query(X.WITH + f", b AS (SELECT *, {BOX} FROM objects), h AS (SELECT xmin <= rx1 AND xmax >= rx0 AND ymin <= ry1 AND ymax >= ry0 AS hit FROM b) SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS inside, {r('count(*) FILTER (WHERE hit) * 100.0e0 / count(*)', 'coverage_pct')} FROM h")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return compat.coverage(X.with_polygons(X.objects(spark, d)), META)


@query(
    X.WITH + ", a AS (SELECT (xmax - xmin) * (ymax - ymin) AS a FROM objects) SELECT count(*) AS n, "
    + ", ".join(r(e, c) for e, c in (("min(a)", "area_min"), ("max(a)", "area_max"), ("avg(a)", "area_mean"), ("stddev_pop(a)", "area_std"), ("avg(900.0e0 / a)", "ratio_mean"), ("median(900.0e0 / a)", "ratio_median"))) + " FROM a"
)
def observational_resolution(spark: SparkSession, d: str) -> DataFrame:
    return compat.resolution(X.with_polygons(X.objects(spark, d)), 900.0)


@query(
    X.WITH + ", m AS (SELECT objeto_id, (xmax - xmin) AS w, (ymax - ymin) AS h, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM objects) SELECT objeto_id, "
    + ", ".join(r(e, c) for e, c in (("w * h", "geom_area"), ("2 * (w + h)", "geom_perimeter"), ("4 * pi() * w * h / power(2 * (w + h), 2)", "geom_circularity"), ("1.0e0", "geom_convexity"), ("least(w, h) / greatest(w, h)", "geom_elongation"), ("2 * (w + h) / (4 * sqrt(w * h))", "geom_shape_index"), ("log2(5.0e0)", "geom_shannon_shape"), ("2 * ln(2 * (w + h)) / ln(w * h)", "geom_fractal_dim"), ("cx", "cx"), ("cy", "cy"))) + " FROM m"
)
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    objects = X.with_polygons(X.objects(spark, d))
    return topology.shapes(objects).join(spatial.centroids(objects), "objeto_id")


@query(
    X.WITH + """ SELECT a.objeto_id, count(b.objeto_id) AS neighbors FROM objects a LEFT JOIN objects b ON a.objeto_id <> b.objeto_id
      AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax
      AND NOT (a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax) GROUP BY a.objeto_id"""
)
def touch_degree(spark: SparkSession, d: str) -> DataFrame:
    return topology.touch_degree(X.with_polygons(X.objects(spark, d)))


def valued(spark: SparkSession, d: str) -> DataFrame:
    """(objeto_id, cx, cy, value): centroids and means of b8."""
    means = spatial.zonal_mean(X.pixels(spark, d), X.objects(spark, d), "b8")
    return X.objects(spark, d).select("objeto_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy")).join(means, "objeto_id")


DIST = "sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2))"


@query(X.WITH_CENTROIDS + f", d AS (SELECT a.objeto_id, {DIST} AS d, row_number() OVER (PARTITION BY a.objeto_id ORDER BY {DIST}) AS k FROM centroids a JOIN centroids b ON a.objeto_id <> b.objeto_id) SELECT objeto_id, {r('avg(d)', 'proximity')} FROM d WHERE k <= 3 GROUP BY objeto_id")
def centroid_proximity3(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(valued(spark, d))


@query(
    X.WITH_CENTROIDS + f""", z AS (SELECT objeto_id, cx, cy, value - (SELECT avg(value) FROM centroids) AS z FROM centroids),
    l AS (SELECT a.objeto_id, max(a.z) AS z, sum(b.z / {DIST}) / sum(1 / {DIST}) AS lag FROM z a JOIN z b ON a.objeto_id <> b.objeto_id GROUP BY a.objeto_id)
    SELECT {r('(SELECT sum(z * lag) FROM l) / (SELECT sum(z * z) FROM z)', 'moran_i', 6)}, {r('-1.0e0 / ((SELECT count(*) FROM z) - 1)', 'expected', 6)}""", 6,
)
def morans_i(spark: SparkSession, d: str) -> DataFrame:
    return spatial.morans_i(valued(spark, d))


@query(
    X.WITH_CENTROIDS + f""", p AS (SELECT {DIST} AS d, power(a.value - b.value, 2) / 2 AS g FROM centroids a JOIN centroids b ON a.objeto_id < b.objeto_id), c AS (SELECT max(d) / 2 AS cutoff FROM p),
    m AS (SELECT least(CAST(floor(d / (cutoff / 15)) AS INT), 14) AS lag, avg(g) AS gamma, count(*) AS pairs FROM p, c WHERE d < cutoff GROUP BY 1)
    SELECT CAST(k AS INT) AS lag, {r('(k + 0.5e0) * cutoff / 15', 'h')}, {r('coalesce(gamma, 0)', 'gamma')}, coalesce(pairs, 0) AS pairs FROM range(15) t(k), c LEFT JOIN m ON m.lag = t.k"""
)
def semivariogram_lags(spark: SparkSession, d: str) -> DataFrame:
    return spatial.semivariogram(valued(spark, d))


@query()
def semivariogram_fit(spark: SparkSession, d: str) -> DataFrame:
    points = valued(spark, d)
    return variogram.semivariogram_fit(spatial.semivariogram(points), points)


CELLS = X.WITH + """, lvl AS (SELECT objeto_id, r - min(r) OVER w AS r, c - min(c) OVER w AS c, b5 AS v, count(*) OVER w AS n,
  CAST(trunc(CASE WHEN max(b5) OVER w > min(b5) OVER w THEN (b5 - min(b5) OVER w) / (max(b5) OVER w - min(b5) OVER w) * 7.999e0 ELSE 0 END) AS INT) AS q FROM pixels WINDOW w AS (PARTITION BY objeto_id)),
  nb AS (SELECT a.objeto_id, a.q AS i, b.q AS j FROM lvl a JOIN lvl b ON a.objeto_id = b.objeto_id AND ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)) WHERE a.n >= 4),
  cm AS (SELECT objeto_id, i, j, count(*) AS n FROM (SELECT objeto_id, i, j FROM nb UNION ALL SELECT objeto_id, j, i FROM nb) u GROUP BY objeto_id, i, j)"""


def cell_grid(spark: SparkSession, d: str) -> DataFrame:
    return texture.cells(X.pixels(spark, d).withColumnsRenamed({"r": "row", "c": "col"}), "b5")


@query(CELLS + " SELECT objeto_id, i, j, n FROM cm")
def glcm_counts(spark: SparkSession, d: str) -> DataFrame:
    return texture.cooccurrence(texture.quantized(cell_grid(spark, d)))


@query(
    CELLS + """, p AS (SELECT *, n / sum(n) OVER (PARTITION BY objeto_id) AS p FROM cm),
    s AS (SELECT objeto_id, sum((i - j) * (i - j) * p) AS contrast, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm, sum(-p * log2(p + 1e-10)) AS entropy, sum(i * p) AS mean, sum(i * i * p) AS ii, sum(i * j * p) AS ij FROM p GROUP BY objeto_id)
    SELECT o.objeto_id, """ + ", ".join(r(e, c, 7) for e, c in (
        ("coalesce(contrast, 0)", "contrast"), ("coalesce(homogeneity, 1)", "homogeneity"), ("coalesce(asm, 1)", "asm"), ("coalesce(entropy, 0)", "entropy"), ("coalesce(mean, 0)", "mean"),
        ("coalesce(greatest(ii - mean * mean, 0), 0)", "variance"), ("coalesce(CASE WHEN sqrt(greatest(ii - mean * mean, 0)) > 1e-10 THEN (ij - mean * mean) / (ii - mean * mean) ELSE 0 END, 0)", "correlation")))
    + " FROM (SELECT DISTINCT objeto_id FROM pixels) o LEFT JOIN s ON o.objeto_id = s.objeto_id", 7,
)
def glcm_features(spark: SparkSession, d: str) -> DataFrame:
    cells = cell_grid(spark, d)
    return texture.texture(texture.cooccurrence(texture.quantized(cells)), cells)


@query(
    CELLS + """, g AS (SELECT a.objeto_id, x.v - a.v AS gx, y.v - a.v AS gy FROM lvl a LEFT JOIN lvl x ON a.objeto_id = x.objeto_id AND a.r = x.r AND x.c = a.c + 1
      LEFT JOIN lvl y ON a.objeto_id = y.objeto_id AND a.c = y.c AND y.r = a.r + 1 WHERE a.n >= 4 AND (x.v IS NOT NULL OR y.v IS NOT NULL)),
    m AS (SELECT objeto_id, sqrt(coalesce(gx, 0) * coalesce(gx, 0) + coalesce(gy, 0) * coalesce(gy, 0)) AS m FROM g)
    SELECT objeto_id, """ + r("avg(m)", "edge_mean") + ", " + r("stddev_pop(m)", "edge_std") + " FROM m GROUP BY objeto_id"
)
def edge_features(spark: SparkSession, d: str) -> DataFrame:
    return texture.edge_strength(cell_grid(spark, d))


def eigen_sql(matrices: str, p: int, first: int) -> str:
    """CTEs (of a WITH RECURSIVE) that end in eigen(key, k, value, vector): the ``first`` greatest eigenvalues of the matrices
    (key, m) of p x p numbers in one list.

    A matrix squared 24 times is, but for its trace, the projector on its leading vector; what that explains is then taken off.
    """
    cells, steps = f"range(0, {p * p})", f"range(0, {p})"
    trace = lambda m: "(" + " + ".join(f"{m}[{i * p + i + 1}]" for i in range(p)) + ")"
    product = lambda a, b: f"[list_sum([{a}[(ij // {p}) * {p} + k_ + 1] * {b}[k_ * {p} + ij % {p} + 1] for k_ in {steps}]) for ij in {cells}]"
    unit = lambda m: f"[x / greatest(list_max([abs(y) for y in {m}]), 1e-300) for x in {m}]"
    rest = f"[c[ij + 1] - {trace('cm')} / greatest(power({trace('m')}, 2), 1e-300) * m[ij + 1] for ij in {cells}]"
    return f"""squares(key, k, it, c, m) AS (
      SELECT key, 1, 0, m, {unit('m')} FROM ({matrices}) start
      UNION ALL SELECT key, k, it, c, {unit('m')} FROM (
        SELECT key, CASE WHEN it < 24 THEN k ELSE k + 1 END AS k, CASE WHEN it < 24 THEN it + 1 ELSE 0 END AS it,
          CASE WHEN it < 24 THEN c ELSE {rest} END AS c,
          CASE WHEN it < 24 THEN {product('m', 'm')} ELSE {rest} END AS m
        FROM (SELECT *, {product('c', 'm')} AS cm FROM squares) x WHERE it < 24 OR k < {first}) y),
    found AS (SELECT key, k, m, {trace(product('c', 'm'))} / greatest({trace('m')}, 1e-300) AS value, [m[i * {p} + i + 1] for i in {steps}] AS diagonal FROM squares WHERE it = 24),
    top AS (SELECT *, list_position(diagonal, list_max(diagonal)) - 1 AS j FROM found),
    eigen AS (SELECT key, k, greatest(value, 0) AS value, [m[i * {p} + j + 1] / sqrt(m[j * {p} + j + 1] * greatest({trace('m')}, 1e-300)) for i in {steps}] AS vector FROM top)"""


def matrix_sql(f: str, columns: list[str]) -> str:
    return "[" + ", ".join(f"{f}({a}, {b})" for a in columns for b in columns) + "]"


LOCAL = ["b1", "b2", "b3", "b4"]
LOCAL_PC1 = (
    X.WITH.replace("WITH", "WITH RECURSIVE", 1)
    + f", {eigen_sql(f'SELECT objeto_id AS key, {matrix_sql("covar_samp", LOCAL)} AS m FROM pixels GROUP BY objeto_id HAVING count(*) > 1', 4, 1)}"
    + ", means AS (SELECT objeto_id, " + ", ".join(f"avg({b}) AS m{b}" for b in LOCAL) + """ FROM pixels GROUP BY objeto_id),
    scored AS (SELECT p.*, CASE WHEN e.key IS NULL THEN p.b1 ELSE """ + " + ".join(f"(p.{b} - m.m{b}) * e.vector[{i}]" for i, b in enumerate(LOCAL, 1))
    + " END AS pc1 FROM pixels p JOIN means m ON p.objeto_id = m.objeto_id LEFT JOIN eigen e ON p.objeto_id = e.key)"
)


@query(LOCAL_PC1 + f" SELECT objeto_id, r, c, {r('pc1', 'pc1', 4)} FROM scored", 4)
def local_component_scores(spark: SparkSession, d: str) -> DataFrame:
    return texture.local_component(X.pixels(spark, d), LOCAL).select("objeto_id", "r", "c", "pc1")


@query()
def pc1_texture(spark: SparkSession, d: str) -> DataFrame:
    pixels = texture.local_component(X.pixels(spark, d), ["b1", "b2", "b3", "b4"]).withColumnsRenamed({"r": "row", "c": "col"})
    return texture.texture_features(texture.cells(pixels, "pc1"))


def lags_sql(summed: bool = True) -> str:
    pairs = (
        X.WITH + f""", s AS (SELECT * FROM pixels), pr AS (SELECT a.objeto_id, sqrt(power(a.pixel_x - b.pixel_x, 2) + power(a.pixel_y - b.pixel_y, 2)) AS d, power(a.b5 - b.b5, 2) / 2 AS g
  FROM s a JOIN s b ON a.objeto_id = b.objeto_id AND (a.pixel_x < b.pixel_x OR (a.pixel_x = b.pixel_x AND a.pixel_y < b.pixel_y))),
  w AS (SELECT objeto_id, max(d) / 5 AS width FROM pr GROUP BY objeto_id),
  lg AS (SELECT pr.objeto_id, CAST(floor(d / width) AS INT) AS lag, (floor(d / width) + 0.5e0) * width AS h, g FROM pr JOIN w ON pr.objeto_id = w.objeto_id WHERE floor(d / width) < 5)"""
    )
    return pairs + f" SELECT objeto_id, lag, {r('min(h)', 'h', 4)}, {r('avg(g)', 'gamma', 4)}, count(*) AS pairs FROM lg GROUP BY objeto_id, lag" if summed else pairs


@query(lags_sql(), 4)
def local_variogram_lags(spark: SparkSession, d: str) -> DataFrame:
    return variogram.local_lags(X.pixels(spark, d), "b5")


SHAPE = {
    "RMF": "CASE WHEN g[1] > 0 THEN list_max(g) / g[1] ELSE 0 END",
    "RSF": "CASE WHEN g[1] > 0 THEN g[2] / g[1] ELSE 1 END",
    "FDO": "(g[2] - g[1]) / (h[2] - h[1])",
    "SDT": "CASE WHEN n >= 4 THEN (g[4] - 2 * g[3] + g[2]) / power(h[2] - h[1], 2) ELSE 0 END",
    "FML": "h[m1]",
    "MFM": "list_avg(g[1:m1])",
    "VFM": "list_var_pop(g[1:m1])",
    "AFM": "(h[2] - h[1]) / 2 * (g[1] + 2 * coalesce(list_sum(g[2:m1 - 1]), 0) + g[m1]) - g[1] * (h[m1] - h[1])",
    "DMS": "h[m2] - h[m1]",
    "HA": "CASE WHEN m2 > m1 AND g[m1] + g[m2] <> 0 THEN (h[2] - h[1]) / 2 * (g[m1] + 2 * coalesce(list_sum(g[m1 + 1:m2 - 1]), 0) + g[m2]) / ((h[m2] - h[m1]) * (g[m2] + g[m1]) / 2) ELSE 0 END",
}


@query(
    lags_sql(False) + f""", gl AS (SELECT objeto_id, lag, min(h) AS h, avg(g) AS g FROM lg GROUP BY objeto_id, lag),
    a AS (SELECT objeto_id, list(h ORDER BY lag) AS h, list(g ORDER BY lag) AS g, count(*) AS n FROM gl GROUP BY objeto_id),
    pk AS (SELECT *, [i for i in range(2, n + 1) if g[i] >= g[i - 1] AND (i = n OR g[i] >= g[i + 1])] AS peaks FROM a WHERE n >= 3),
    m AS (SELECT *, coalesce(peaks[1], list_position(g, list_max(g))) AS m1 FROM pk), mm AS (SELECT *, CASE WHEN peaks[2] > m1 THEN peaks[2] ELSE n END AS m2 FROM m)
    SELECT objeto_id, """ + ", ".join(r(e, f"var_{c}", 4) for c, e in SHAPE.items()) + " FROM mm", 4,
)
def local_variogram_shape(spark: SparkSession, d: str) -> DataFrame:
    shapes = variogram.local_variograms(X.pixels(spark, d), "b5")
    return shapes.select("objeto_id", *(f"var_{c}" for c in SHAPE))


@query()
def local_variogram_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return variogram.local_variograms(X.pixels(spark, d), "b5")


@query(
    X.WITH.replace("WITH", "WITH RECURSIVE", 1)
    + f""", {eigen_sql(f"SELECT 0 AS key, {matrix_sql('corr', CORR)} AS m FROM pixels", len(CORR), len(CORR))},
    shares AS (SELECT k AS component, value / sum(value) OVER () AS ratio FROM eigen), run AS (SELECT *, sum(ratio) OVER (ORDER BY component) AS cumulative FROM shares)
    SELECT component, {r('ratio', 'ratio')}, {r('cumulative', 'cumulative')}, CAST(min(CASE WHEN cumulative >= 0.95e0 - 1e-12 THEN component END) OVER () AS INT) AS effective_dim FROM run"""
)
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    return stats.pca(X.pixels(spark, d), CORR)


LOADED = ["f_sig", "f_col", "f1", "f3"]


@query(
    X.WITH_FEATURES.replace("WITH", "WITH RECURSIVE", 1)
    + f", {eigen_sql(f'SELECT 0 AS key, {matrix_sql("corr", LOADED)} AS m FROM features', len(LOADED), 3)}"
    + " UNION ALL ".join(f" SELECT k AS component, '{c}' AS variable, {r(f'vector[{i}]', 'loading')} FROM eigen" for i, c in enumerate(LOADED, 1))
)
def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    return stats.loadings(X.features(spark, d), LOADED)


@query(
    X.WITH_FEATURES.replace("WITH", "WITH RECURSIVE", 1)
    + f""", {eigen_sql(f"SELECT 0 AS key, {matrix_sql('corr', NUMERIC)} AS m FROM features", len(NUMERIC), len(NUMERIC))},
    shares AS (SELECT k AS component, value / sum(value) OVER () AS ratio FROM eigen), run AS (SELECT *, sum(ratio) OVER (ORDER BY component) AS cumulative FROM shares)
    SELECT component, {r('ratio', 'ratio')}, {r('cumulative', 'cumulative')}, CAST(min(CASE WHEN cumulative >= 0.95e0 - 1e-12 THEN component END) OVER () AS INT) AS effective_dim FROM run"""
)
def feature_pca(spark: SparkSession, d: str) -> DataFrame:
    return stats.pca(X.features(spark, d), NUMERIC)


FPAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


@query(X.WITH_FEATURES + ", c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM features" for a, b in FPAIRS) + f") SELECT a, b, {r('r', 'r')} FROM c WHERE abs(r) > 0.85")
def collinear_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = X.features(spark, d)
    keep = [c for c in separability.feature_columns(rows) if c in [*NUMERIC, "f_const"]]  # f_const is constant and goes
    return separability.collinear_pairs(rows, keep)


MI_COLUMNS = ["f1", "f2", "f_sig"]


def mi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS variable, greatest(0, psi_n + avg(pk - pn - pm)) AS mi FROM (
      SELECT (SELECT count(*) FROM features) AS total, (SELECT p FROM psi WHERE n = (SELECT count(*) FROM features)) AS psi_n, a.p AS pk, b.p AS pn, e.p AS pm
      FROM (SELECT x.objeto_id, x.nc, least(3, x.nc - 1) AS k, (SELECT count(*) FROM features q WHERE CASE WHEN q.{c} < x.v THEN x.v - q.{c} ELSE q.{c} - x.v END < x.kd) AS m
        FROM (SELECT objeto_id, clase, v, nc, list_sort(list_filter([abs(v - l1), abs(v - l2), abs(v - l3), abs(r1 - v), abs(r2 - v), abs(r3 - v)], lambda z: z IS NOT NULL))[least(3, nc - 1)] AS kd
          FROM (SELECT objeto_id, clase, {c} AS v, count(*) OVER (PARTITION BY clase) AS nc, lag({c}, 1) OVER o AS l1, lag({c}, 2) OVER o AS l2, lag({c}, 3) OVER o AS l3, lead({c}, 1) OVER o AS r1, lead({c}, 2) OVER o AS r2, lead({c}, 3) OVER o AS r3
            FROM features WINDOW o AS (PARTITION BY clase ORDER BY {c})) y) x WHERE x.nc > 1) t
      JOIN psi a ON a.n = t.k JOIN psi b ON b.n = t.nc JOIN psi e ON e.n = greatest(1, t.m)) u GROUP BY psi_n"""


@query(
    X.WITH_FEATURES + ", psi AS (SELECT n, -0.5772156649015329e0 + coalesce(sum(1.0e0 / (n - 1)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p FROM (SELECT n FROM range(2, 60000) t(n)) z UNION ALL SELECT 1, -0.5772156649015329e0) "
    + f"SELECT variable, {r('mi', 'mi', 4)} FROM (" + " UNION ALL ".join(mi_sql(c) for c in MI_COLUMNS) + ") g", 4,
)
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return separability.mutual_information(X.features(spark, d), MI_COLUMNS)


#: All columns in long form (o: row, i: place of the column, v: its name, y: class), and their information in ``mi``.
LONG_MI = f"""long AS (SELECT vec_id AS o, i, 'f' || i AS v, CAST(label AS STRING) AS y, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range({X.EVERY}) t(i)
      UNION ALL SELECT vec_id, {X.EVERY}, 'f_sig', CAST(label AS STRING), CAST(embedding[2] AS DOUBLE) + 0.1e0 * label FROM embeddings
      UNION ALL SELECT vec_id, {X.EVERY + 1}, 'f_col', CAST(label AS STRING), 0.95e0 * CAST(embedding[2] AS DOUBLE) + 0.05e0 * CAST(embedding[3] AS DOUBLE) FROM embeddings),
    psi AS (SELECT n, -0.5772156649015329e0 + coalesce(sum(1.0e0 / (n - 1)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p FROM (SELECT n FROM range(2, 60000) t(n)) z UNION ALL SELECT 1, -0.5772156649015329e0),
    near AS (SELECT o, v, x, nc, least(3, nc - 1) AS k, list_sort(list_filter([x - l1, x - l2, x - l3, r1 - x, r2 - x, r3 - x], lambda z: z IS NOT NULL))[least(3, nc - 1)] AS kd
      FROM (SELECT *, count(*) OVER (PARTITION BY v, y) AS nc, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3, lead(x, 1) OVER w AS r1, lead(x, 2) OVER w AS r2, lead(x, 3) OVER w AS r3
        FROM long WINDOW w AS (PARTITION BY v, y ORDER BY x)) q WHERE nc > 1),
    around AS (SELECT n.o, n.v, n.nc, n.k, greatest(1, count(*) FILTER (WHERE abs(q.x - n.x) < n.kd)) AS m FROM near n JOIN long q ON n.v = q.v GROUP BY n.o, n.v, n.nc, n.k),
    sizes AS (SELECT v, count(*) AS total FROM near GROUP BY v),
    mi AS (SELECT a.v, greatest(0, max(t.p) + avg(pk.p - pn.p - pm.p)) AS mi
      FROM around a JOIN sizes s ON a.v = s.v JOIN psi t ON t.n = s.total JOIN psi pk ON pk.n = a.k JOIN psi pn ON pn.n = a.nc JOIN psi pm ON pm.n = a.m GROUP BY a.v)"""


# mutual_information takes three columns, as its SQL does; mutual_information_whole takes all.
@query(f"WITH {LONG_MI} SELECT v AS variable, {r('mi', 'mi', 4)} FROM mi", 4)
def mutual_information_whole(spark: SparkSession, d: str) -> DataFrame:
    return separability.mutual_information(X.all_features(spark, d), EVERY)


@query(f"WITH {LONG_MI}, o AS (SELECT DISTINCT i, v FROM long) SELECT mi.v AS variable, {r('mi', 'mi', 4)}, CAST(row_number() OVER (ORDER BY mi DESC, o.i) AS INT) AS rank FROM mi JOIN o ON o.v = mi.v", 4)
def information_ranking(spark: SparkSession, d: str) -> DataFrame:
    return separability.ranked(separability.mutual_information(X.all_features(spark, d), EVERY), EVERY)


@query(
    f"""WITH RECURSIVE {LONG_MI},
    c AS (SELECT a.i, b.i AS j, a.v AS a, b.v AS b, corr(a.x, b.x) AS r FROM long a JOIN long b ON a.o = b.o AND a.i < b.i GROUP BY ALL),
    pairs AS (SELECT row_number() OVER (ORDER BY c.i, c.j) AS p, c.a, c.b, CASE WHEN x.mi >= y.mi THEN c.b ELSE c.a END AS loser FROM c JOIN mi x ON x.v = c.a JOIN mi y ON y.v = c.b WHERE abs(c.r) > 0.85),
    steps(p, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[])
      UNION ALL SELECT s.p + 1, CASE WHEN list_contains(s.gone, q.a) OR list_contains(s.gone, q.b) THEN s.gone ELSE list_append(s.gone, q.loser) END FROM steps s JOIN pairs q ON q.p = s.p + 1)
    SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS position, v AS variable
    FROM (SELECT DISTINCT i, v FROM long) z WHERE NOT list_contains((SELECT arg_max(gone, p) FROM steps), v)"""
)
def collinearity_prune(spark: SparkSession, d: str) -> DataFrame:
    """The columns, of all, that stay.  The result is over columns; pairs and information come from two jobs over all rows."""
    kept = separability.prune_collinear(X.all_features(spark, d), EVERY)
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "position int, variable string")


@query()
def kmeans_elbow(spark: SparkSession, d: str) -> DataFrame:
    return separability.kmeans(X.all_features(spark, d), EVERY)[0]


INERTIA = [(2, 900.0), (3, 500.0), (4, 300.0), (5, 260.0), (6, 235.0), (7, 220.0), (8, 210.0)]


@query(
    "WITH i(k, inertia) AS (VALUES " + ", ".join(f"({k}, {v}e0)" for k, v in INERTIA) + "), e AS (SELECT min(k) AS k0, max(k) AS k1, arg_min(inertia, k) AS i0, arg_max(inertia, k) AS i1 FROM i), "
    f"g AS (SELECT CAST(k AS INT) AS k, inertia, abs((i1 - i0) * k + (k0 - k1) * inertia + k1 * i0 - k0 * i1) / sqrt(power(i1 - i0, 2) + power(k0 - k1, 2)) AS gap FROM i, e) SELECT k, {r('inertia', 'inertia')}, {r('gap', 'gap')}, k = (SELECT arg_max(k, gap) FROM g) AS selected FROM g"
)
def elbow_select(spark: SparkSession, d: str) -> DataFrame:
    return separability.elbow(spark.createDataFrame(INERTIA, "k int, inertia double"))


@query(
    X.WITH_FEATURES + f""", p AS (SELECT a.objeto_id, a.label AS la, b.label AS lb, sqrt(power(a.f_sig - b.f_sig, 2) + power(a.f2 - b.f2, 2)) AS d FROM features a JOIN features b ON a.objeto_id <> b.objeto_id),
    m AS (SELECT objeto_id, la, lb, avg(d) AS d FROM p GROUP BY objeto_id, la, lb), s AS (SELECT objeto_id, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM m GROUP BY objeto_id)
    SELECT {r('avg(coalesce((b - a) / greatest(a, b), 0))', 'silhouette')} FROM s"""
)
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return separability.silhouette(X.features(spark, d), ["f_sig", "f2"], "label")


@query(
    X.WITH_FEATURES + f""", c AS (SELECT label, avg(f_sig) AS x, avg(f2) AS y FROM features GROUP BY label), s AS (SELECT f.label, max(c.x) AS x, max(c.y) AS y, avg(sqrt(power(f_sig - c.x, 2) + power(f2 - c.y, 2))) AS s FROM features f JOIN c ON f.label = c.label GROUP BY f.label),
    w AS (SELECT a.label, max((a.s + b.s) / sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT {r('avg(r)', 'davies_bouldin')} FROM w"""
)
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return separability.davies_bouldin(X.features(spark, d), ["f_sig", "f2"], "label")


@query(X.WITH_FEATURES + " SELECT c.clase, k.cluster, count(f.objeto_id) AS n FROM (SELECT DISTINCT clase FROM features) c CROSS JOIN (SELECT DISTINCT cluster FROM features) k LEFT JOIN features f ON f.clase = c.clase AND f.cluster = k.cluster GROUP BY c.clase, k.cluster")
def class_cluster_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return separability.crosstab(X.features(spark, d))


@query(X.WITH_FEATURES + f", k AS (SELECT clase, cluster, count(*) AS k FROM features GROUP BY clase, cluster), p AS (SELECT *, k / sum(k) OVER (PARTITION BY clase) AS p FROM k) SELECT clase, CAST(sum(k) AS BIGINT) AS n, {r('abs(sum(-p * ln(p)))', 'entropy')}, {r('max(p)', 'purity')} FROM p GROUP BY clase")
def purity_entropy(spark: SparkSession, d: str) -> DataFrame:
    return separability.purity(X.features(spark, d))


@query(X.WITH_FEATURES + f", k AS (SELECT clase, cluster, count(*) AS k FROM features GROUP BY clase, cluster), b AS (SELECT cluster, max(k) AS b, sum(k) AS n FROM k GROUP BY cluster) SELECT {r('sum(b) / sum(n)', 'global_purity')} FROM b")
def global_purity(spark: SparkSession, d: str) -> DataFrame:
    return separability.global_purity(X.features(spark, d))


CLASSES = X.WITH_FEATURES + """, k AS (SELECT clase AS k, count(*) AS n, avg(f_sig) AS x, avg(f2) AS y, covar_samp(f_sig, f_sig) + 1e-4 AS xx, covar_samp(f_sig, f2) AS xy, covar_samp(f2, f2) + 1e-4 AS yy FROM features GROUP BY clase),
  p AS (SELECT a.k AS a, b.k AS b, a.x - b.x AS dx, a.y - b.y AS dy, (a.n * a.xx + b.n * b.xx) / (a.n + b.n) AS pxx, (a.n * a.xy + b.n * b.xy) / (a.n + b.n) AS pxy, (a.n * a.yy + b.n * b.yy) / (a.n + b.n) AS pyy,
    (a.xx + b.xx) / 2 AS mxx, (a.xy + b.xy) / 2 AS mxy, (a.yy + b.yy) / 2 AS myy, a.xx * a.yy - a.xy * a.xy AS d1, b.xx * b.yy - b.xy * b.xy AS d2 FROM k a JOIN k b ON a.k < b.k),
  m AS (SELECT a, b, sqrt((pyy * dx * dx - 2 * pxy * dx * dy + pxx * dy * dy) / (pxx * pyy - pxy * pxy)) AS mahalanobis,
    greatest(0, (myy * dx * dx - 2 * mxy * dx * dy + mxx * dy * dy) / (mxx * myy - mxy * mxy) / 8 + 0.5e0 * (ln(mxx * myy - mxy * mxy) - 0.5e0 * (ln(d1) + ln(d2)))) AS bhattacharyya FROM p)"""


@query(CLASSES + f" SELECT a, b, {r('mahalanobis', 'mahalanobis')}, {r('bhattacharyya', 'bhattacharyya')} FROM m")
def class_distances(spark: SparkSession, d: str) -> DataFrame:
    return separability.class_distances(X.features(spark, d), ["f_sig", "f2"])


@query(CLASSES + f" SELECT {r('avg(mahalanobis)', 'mean_mahalanobis')} FROM m")
def mean_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    return separability.mean_mahalanobis(separability.class_distances(X.features(spark, d), ["f_sig", "f2"]))


def score_sql(parts: list[tuple[str, str]], score: str, name: str, labels: tuple[str, ...]) -> str:
    return (
        f"WITH v AS (SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber AS line, l_partkey AS part, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem), "
        f"p AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in parts)} FROM v), s AS (SELECT *, {score} AS score FROM p) "
        f"SELECT k, line, part, {r('q', 'q')}, {r('score', name)}, CASE WHEN score >= 80 THEN '{labels[0]}' WHEN score >= 60 THEN '{labels[1]}' WHEN score >= 40 THEN '{labels[2]}' ELSE '{labels[3]}' END AS categoria, "
        + ", ".join(r(n, n) for n, _ in parts) + " FROM s"
    )


def scored(spark: SparkSession, d: str, columns: dict) -> DataFrame:
    v = spark.sql("SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber AS line, l_partkey AS part, l_quantity AS q, l_discount AS d, l_tax AS t FROM {lineitem}", **X.tables(spark, d, "lineitem"))
    return v.withColumns(columns).drop("d", "t")


CLIP = "least(greatest({}, 0), 100)"


TOI_SQL = ([("cobertura", CLIP.format("q * 2.5e0")), ("resolucion", CLIP.format("(1 - d) * 100")), ("informacion", CLIP.format("t * 100 / 8 * 100")), ("redundancia", CLIP.format("(1 - t) * 100")), ("estructura", CLIP.format("greatest(d * 10 - 0.3e0, 0) * 100"))], "0.2e0 * cobertura + 0.25e0 * resolucion + 0.25e0 * informacion + 0.15e0 * redundancia + 0.15e0 * estructura", "toi", indexes.TOI_LABELS)
TLI_SQL = ([("distancia", "100 * (1 - exp(-q / 4))"), ("pureza", "100 * t * 10"), ("agrupamiento", "100 * greatest(d * 8 - 0.2e0, 0)"), ("penalizacion", "greatest((q / 25 - 0.3e0) * 20, 0)")], CLIP.format("0.4e0 * distancia + 0.35e0 * pureza + 0.25e0 * agrupamiento - penalizacion"), "tli", indexes.TLI_LABELS)


def toi_columns() -> dict:
    q, disc, tax = F.col("q"), F.col("d"), F.col("t")
    return indexes.toi(q * 2.5, disc, tax * 100, tax, disc * 10 - 0.3)


def tli_columns() -> dict:
    q, disc, tax = F.col("q"), F.col("d"), F.col("t")
    return indexes.tli(q, tax * 10, disc * 8 - 0.2, q / 25)


@query(score_sql(*TOI_SQL), 5)
def toi(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, toi_columns())


@query(score_sql(*TLI_SQL), 5)
def tli(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, tli_columns())


@query(X.WITH + f", e AS (SELECT objeto_id, xmin AS x, ymin AS y FROM objects) SELECT objeto_id, {r('xmin', 'x0')}, {r('ymin', 'y0')}, {r('xmax', 'x1')}, {r('ymax', 'y1')} FROM objects")
def geometry_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = G.bounds(F.col("polygons"))
    return X.with_polygons(X.objects(spark, d)).select("objeto_id", *(b[c].alias(c) for c in ("x0", "y0", "x1", "y1")))


@query()
def tsne_2d(spark: SparkSession, d: str) -> DataFrame:
    return tsne.tsne(X.features(spark, d), NUMERIC)


@query(digits=4)
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pixels(spark, d).withColumnsRenamed({"r": "row", "c": "col"})
    return features.extract_features(rows, X.with_polygons(X.objects(spark, d)), BANDS[:4], (2, 3, 1))


# Names that these queries had while others of the plain name took a part of the rows.
for _plain in ("toi", "tli", "zonal_mean", "local_variogram_lags", "pixel_extraction"):
    _name = {"pixel_extraction": "pixel_extraction_pip"}.get(_plain, _plain)
    QUERIES[f"{_plain}_whole"], ORACLES[f"{_plain}_whole"] = QUERIES[_name], ORACLES[_name]
