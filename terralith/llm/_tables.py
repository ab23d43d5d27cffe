"""Reading inputs and cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local temporary one only in a session that runs in a single process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="terralith-")
        spark.conf.set("spark.checkpoint.dir", f"file://{path}")
        path = f"file://{path}"
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no more than a reread.

    The shuffle files behind the table are dropped once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terralith/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        ours = shared_dir(spark).split(":")[-1].strip("/") + "/terralith/"
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if ours in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
