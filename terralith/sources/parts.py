"""Layers and grids that are folders of part files: how parts are found, and written all or not at all.

The formats here are read by seeking in files, so their paths must be mounted where the driver and all tasks see them.
"""

from __future__ import annotations

import glob
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from terralith.functions.crs import GEOMETRY


def local(path: str) -> str:
    return path.removeprefix("file://")


def polygon_columns(schema: StructType) -> list[str]:
    """The columns of polygons, whatever may be null in them."""
    return [f.name for f in schema if f.dataType.simpleString() == GEOMETRY.simpleString()]


def part_files(path: str, ending: str) -> list[str]:
    """The file at ``path``, or the files with that ending in the folder ``path``, in the order of their names."""
    path = local(path)
    if os.path.isdir(path):
        return sorted(glob.glob(f"{glob.escape(path)}/*{ending}"))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share.

    Where that is unset, a temporary folder takes its place in a session that runs in a single process, and in no other.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='terralith-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/terralith/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: rounds read the one before, and a lost executor costs no more than a reread."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: the name of its files without their endings, none if it had no rows; its place among the tasks."""

    stem: str | None
    place: int


class PartsWriter(DataSourceWriter):
    """One set of files for each task.  They are written in a folder aside and moved when all tasks have ended well.

    A task that fails or runs twice leaves nothing: what no commit names goes with the folder.  A table without rows gives one
    file without features, so that its columns are kept.
    """

    endings: tuple[str, ...] = ()

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = local(path), schema, overwrite
        self.aside = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write_file(self, stem: str, rows: Iterator[Row]) -> int:
        """Writes the rows to files beginning with ``stem`` and returns their number."""
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Part:
        os.makedirs(self.aside, exist_ok=True)
        stem = f"{self.aside}/{uuid.uuid4().hex}"
        n = self.write_file(stem, iterator)
        return Part(stem if n else None, TaskContext.get().partitionId())

    def commit(self, messages: list[Part | None]) -> None:
        stems = [m.stem for m in sorted((m for m in messages if m), key=lambda m: m.place) if m.stem]
        os.makedirs(self.aside, exist_ok=True)
        if not stems:
            stems = [f"{self.aside}/{uuid.uuid4().hex}"]
            self.write_file(stems[0], iter([]))
        old = [f for e in self.endings for f in part_files(self.path, e)]
        first = 0 if self.overwrite else sum(f.endswith(self.endings[0]) for f in old)
        if self.overwrite:
            for f in old:
                os.remove(f)
        for k, stem in enumerate(stems, first):
            for e in self.endings:
                os.replace(stem + e, f"{self.path}/part-{k:05d}{e}")
        shutil.rmtree(self.aside)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)
        if os.path.isdir(self.path) and not os.listdir(self.path):
            os.rmdir(self.path)
