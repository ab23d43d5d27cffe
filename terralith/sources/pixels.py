"""Tables of extracted pixels: CSV as an earlier extraction wrote it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of an exported pixel table, before the bands b1, b2 ...
KEYS = {"objeto_id": "bigint", "clase": "string", "pixel_x": "double", "pixel_y": "double"}


def _wanted(spark: SparkSession, path: str, bands: list[str]) -> tuple[DataFrame, dict[str, str]]:
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    wanted = KEYS | {b: "double" for b in bands}
    if missing := [c for c in wanted if c not in raw.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw, wanted


def read_pixels(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    """(objeto_id, clase, pixel_x, pixel_y, bands) from CSV with a header; more columns are left out.

    A missing column raises ValueError; a row whose object, place or band is no number is an error when the table is read.
    """
    raw, wanted = _wanted(spark, path, bands)
    return raw.select(*(F.col(c).cast(t).alias(c) for c, t in wanted.items()))


def faulty(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    """The rows, as text, that lack an object or a place, or have a value that is no number in any of the columns."""
    raw, wanted = _wanted(spark, path, bands)
    number = {c: F.col(c).try_cast(t) for c, t in wanted.items() if t != "string"}
    bad = [n.isNull() if c in KEYS else F.col(c).isNotNull() & n.isNull() for c, n in number.items()]
    return raw.where(F.array_contains(F.array(*bad), True))


def pixels_or(spark: SparkSession, path: str | None, bands: list[str], extract: Callable[[], DataFrame]) -> DataFrame:
    """The pixels of a CSV table, or those of ``extract`` where no path is given, nothing can be read, or a value is no number.

    The check reads the table once, all its rows and columns.
    """
    if path:
        try:
            rows = read_pixels(spark, path, bands)
            if faulty(spark, path, bands).isEmpty() and not rows.isEmpty():
                return rows
        except Exception as e:  # noqa: BLE001  Spark's and Hadoop's read errors share no class
            spark.sparkContext._jvm.org.apache.log4j.LogManager.getLogger("terralith").warn(f"pixel table {path} not used: {e}")
    return extract()
