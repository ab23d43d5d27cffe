"""Objects, pixels and features laid over the driver's tables, as DataFrames and as the same CTEs for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS_SQL = """
  SELECT CAST(s.s_suppkey AS BIGINT) AS objeto_id, r.r_name AS clase,
         (s.s_suppkey % 40) * 1000.0e0 - 7.0e0 AS xmin, floor(s.s_suppkey / 40) * 1000.0e0 AS ymin,
         (s.s_suppkey % 40) * 1000.0e0 - 7.0e0 + CASE WHEN s.s_suppkey % 3 = 0 THEN 1000.0e0 ELSE 900.0e0 END AS xmax,
         floor(s.s_suppkey / 40) * 1000.0e0 + CASE WHEN s.s_suppkey % 5 = 0 THEN 1000.0e0 ELSE 920.0e0 END AS ymax
  FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey"""

PIXELS_SQL = """
  SELECT o.objeto_id, o.clase, p.r, p.c,
         o.xmin + 7.0e0 + (p.c + 0.5e0) * 30.0e0 AS pixel_x, o.ymin + 900.0e0 - (p.r + 0.5e0) * 30.0e0 AS pixel_y,
         p.b1, p.b2, p.b3, p.b4, p.c + 2 * p.r + p.b1 / 50.0e0 AS b5, 3.0e0 * (p.c + 2 * p.r + p.b1 / 50.0e0) + p.b3 / 100.0e0 AS b6, 1.0e0 AS b7,
         (o.xmin + 7.0e0 + (p.c + 0.5e0) * 30.0e0) / 1000.0e0 + p.b1 / 50.0e0 AS b8
  FROM (SELECT l_suppkey, CAST(floor(k / 25) AS INT) AS r, CAST(k % 25 AS INT) AS c, b1, b2, b3, b4
        FROM (SELECT l_suppkey, l_quantity AS b1, l_extendedprice / 1000.0e0 AS b2, l_discount * 100.0e0 AS b3, l_tax * 100.0e0 AS b4,
                     row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS k
              FROM {lineitem}) q) p
  JOIN {objects} o ON o.objeto_id = p.l_suppkey"""

WITH = "WITH objects AS (" + OBJECTS_SQL.format(supplier="supplier", nation="nation", region="region") + "), pixels AS (" + PIXELS_SQL.format(lineitem="lineitem", objects="objects") + ")"
#: The same with the centroids of the rectangles and, by object, the mean of b8.
WITH_CENTROIDS = WITH + """, centroids AS (SELECT o.objeto_id, o.clase, (o.xmin + o.xmax) / 2 AS cx, (o.ymin + o.ymax) / 2 AS cy, v.value
  FROM objects o JOIN (SELECT objeto_id, avg(b8) AS value FROM pixels GROUP BY objeto_id) v ON o.objeto_id = v.objeto_id)"""

DIMS = 6


def features_sql(base: int, table: str = "{embeddings}", count: int = DIMS) -> str:
    """The feature table with ``count`` dimensions; ``base`` is the index of an array's first element."""
    dims = ", ".join(f"CAST(embedding[{i + base}] AS DOUBLE) AS f{i}" for i in range(count))
    names = ", ".join(f"f{i}" for i in range(count))
    return (
        f"SELECT objeto_id, clase, label, {names}, f1 + 0.1e0 * label AS f_sig, 0.95e0 * f1 + 0.05e0 * f2 AS f_col, 1.0e0 AS f_const, (label + objeto_id % 3) % 4 AS cluster "
        f"FROM (SELECT vec_id AS objeto_id, CAST(label AS STRING) AS clase, label, {dims} FROM {table}) e"
    )


#: All dimensions of an embedding, for queries whose SQL does not name the features above.
EVERY = 64

WITH_FEATURES = "WITH features AS (" + features_sql(1, "embeddings") + ")"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objeto_id, clase, the rectangle, and its ring as ``polygons``."""
    return spark.sql(OBJECTS_SQL, **tables(spark, sf_dir, "supplier", "nation", "region"))


def with_polygons(rectangles: DataFrame) -> DataFrame:
    """Adds ``polygons`` (polygons of rings of points) made of the rectangle."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"), point("xmin", "ymin"))
    return rectangles.withColumn("polygons", F.array(F.array(ring)))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PIXELS_SQL, objects=objects(spark, sf_dir), **tables(spark, sf_dir, "lineitem"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(features_sql(0), **tables(spark, sf_dir, "embeddings"))


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with every dimension of the embedding: f0 to f63, f_sig, f_col."""
    return spark.sql(features_sql(0, count=EVERY), **tables(spark, sf_dir, "embeddings"))
