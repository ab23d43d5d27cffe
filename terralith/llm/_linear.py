"""Sparse rows as (column indices, values, row offsets), bounded labelled samples, and fits in one task over such a sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "doc_id long, grade int, cols binary, vals binary"


def dot(w: np.ndarray, cols: np.ndarray, vals: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of w[cols] * vals by row."""
    total = np.zeros(len(cols) + 1)
    np.cumsum(w[cols] * vals, out=total[1:], dtype=np.float64)
    return total[offs[1:]] - total[offs[:-1]]


def push(g: np.ndarray, cols: np.ndarray, vals: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows' g over the columns: the transpose of ``dot``."""
    return np.bincount(cols, weights=np.repeat(g, np.diff(offs)) * vals, minlength=size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def share_of(most: int, n: int, *key: str | Column) -> Column:
    """Whether a row is among about ``most`` of ``n`` rows, by the 64-bit hash of its key; every row where ``n`` is no more than that.

    The bound is a whole number of 64 bits, so that no share becomes 0 by rounding, however many rows there are.
    """
    if n <= most:
        return F.lit(True)
    return F.xxhash64(*key) < F.lit((most << 64) // n - (1 << 63))


def labelled(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with a grade, about ``most`` of them at the most, chosen by a hash of their id.

    ``labels`` holds (doc_id, grade).  Rows without id or grade are left out; of several grades of a document the least counts.
    The ids that are broadcast are bounded by ``most``.
    """
    known = labels.where("doc_id IS NOT NULL AND grade IS NOT NULL")
    n = known.count()
    chosen = known.where(share_of(most, n, "doc_id", F.lit("sample")))
    ids = chosen.groupBy(F.col("doc_id").alias("__id")).agg(F.min("grade").cast("int").alias("grade"))
    return docs.join(F.broadcast(ids), docs[id_col] == ids["__id"]).drop("__id")


def fitted(rows: DataFrame, fit: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bytes]) -> bytes:
    """``fit(grades, cols, vals, offs)`` in one task over a bounded sample of ROWS, ordered by id; returns its model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, g, c, v) for b in batches for d, g, c, v in zip(*(b.column(k).to_pylist() for k in ("doc_id", "grade", "cols", "vals")), strict=True)]
        got.sort(key=lambda r: (r[0], r[2]))
        cols = np.frombuffer(b"".join(r[2] for r in got), np.int32)
        vals = np.frombuffer(b"".join(r[3] for r in got), np.float32)
        offs = np.concatenate([[0], np.cumsum([len(r[2]) // 4 for r in got])]).astype(np.int64)
        grades = np.array([r[1] for r in got], np.int64)
        got.clear()
        yield pa.RecordBatch.from_arrays([pa.array([fit(grades, cols, vals, offs)], pa.binary())], names=["model"])

    # a shuffle, so that what makes the rows is not drawn into the one task
    return bytes(rows.repartition(1).mapInArrow(run, "model binary").head()["model"])


def packed(ids: pa.Array, grades: pa.Array, cols: np.ndarray, vals: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    c, v = cols.astype(np.int32).tobytes(), vals.astype(np.float32).tobytes()
    cut = [(4 * a, 4 * b) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([ids, grades, pa.array([c[a:b] for a, b in cut], pa.binary()), pa.array([v[a:b] for a, b in cut], pa.binary())], names=["doc_id", "grade", "cols", "vals"])
