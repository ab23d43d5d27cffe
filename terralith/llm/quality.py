"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w x).  The weights w are shared by all grades and live in one hashed space of text
features; the thresholds are ordered by construction (each is the one before plus an exponential).  The model is fitted on a
bounded sample of labelled documents (parameter ``most``); every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._linear import ROWS, dot, fitted, labelled, packed, push, sigmoid
from ._text import LOWER, U64, chunks, mix, owners, span_hash, words

BITS = 16
MASK = U64((1 << BITS) - 1)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER | np.isin(np.arange(256), np.r_[97:123, 128:256])
_DIGIT = np.isin(np.arange(256), np.r_[48:58])


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, values, row offsets): hashed words and word shapes by share, and hashed bins of whole-text measures."""
    starts, ends, first = words(buf, offs)
    n_docs, n = len(offs) - 1, np.diff(first)
    row = owners(first)
    h = span_hash(LOWER[buf], starts, ends)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[buf])])
        return total[ends] - total[starts]

    length, upper, letters, digits = ends - starts, count(_UPPER), count(_LETTER), count(_DIGIT)
    odd = length - letters - digits
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    shape = np.minimum(3, odd) + 4 * np.minimum(2, upper) + 12 * (upper * 2 > length) + 24 * (digits > 0) + 48 * np.minimum(5, np.frexp(length)[1]) + 288 * (letters == 0) + 576 * np.isin(last, [37, 36, 35, 38, 42, 124, 33])
    shape_col = mix(shape.astype(U64) + U64(1 << 32)) & MASK
    share = 1 / np.maximum(1, n)
    # distinct words and repeats of the word before, by document
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=n_docs) * share
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    junk = np.bincount(row, weights=(odd * 2 > length) | (odd >= 3) | (upper * 2 > length), minlength=n_docs) * share
    repeat = np.bincount(row, weights=same, minlength=n_docs) * share
    bins = [np.minimum(9, (distinct * 10).astype(np.int64)), np.minimum(9, np.sqrt(repeat * 100).astype(np.int64)), np.minimum(9, np.sqrt(junk * 100).astype(np.int64)), np.frexp(n)[1]]
    whole = np.stack([mix(((k + 2) << 33) + b.astype(U64)) & MASK for k, b in enumerate(bins)], 1) if n_docs else np.zeros((0, 4), U64)
    cols = np.concatenate([h & MASK, shape_col, whole.ravel()]).astype(np.int64)
    vals = np.concatenate([share[row], 4 * share[row], np.ones(4 * n_docs)])
    rows = np.concatenate([row, row, np.repeat(np.arange(n_docs), 4)])
    key = rows << BITS | cols
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    vals = np.add.reduceat(vals[order], head) if len(head) else vals
    return key[head] & int(MASK), vals, np.searchsorted(key[head] >> BITS, np.arange(n_docs + 1))


def fit_ordinal(grades: np.ndarray, cols: np.ndarray, vals: np.ndarray, offs: np.ndarray, n_grades: int, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> bytes:
    """Weights and thresholds by AdaGrad on the mean log-likelihood; grades are weighed as if equally frequent up to a factor of 4."""
    size, n = 1 << BITS, len(grades)
    w, theta = np.zeros(size), np.zeros(n_grades - 1)
    if n:
        count = np.bincount(grades, minlength=n_grades)
        at_most = np.clip(np.cumsum(count)[:-1] / n, 0.01, 0.99)
        first = np.log(at_most / (1 - at_most))
        theta = np.concatenate([first[:1], np.log(np.maximum(0.1, np.diff(first)))])
        weight = np.minimum(4, n / np.maximum(1, n_grades * count))[grades]
        weight /= weight.sum()
        sw, st = np.full(size, 1e-8), np.full(n_grades - 1, 1e-8)
        for _ in range(rounds):
            cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
            cdf = np.concatenate([np.zeros((n, 1)), sigmoid(cuts - dot(w, cols, vals, offs)[:, None]), np.ones((n, 1))], 1)
            high, low = cdf[np.arange(n), grades + 1], cdf[np.arange(n), grades]
            p = np.maximum(1e-12, high - low)
            d_high, d_low = high * (1 - high) / p * weight, low * (1 - low) / p * weight
            g = push(d_low - d_high, cols, vals, offs, size) - ridge * w
            g_cut = np.bincount(grades, weights=d_high, minlength=n_grades)[: n_grades - 1] - np.bincount(grades, weights=d_low, minlength=n_grades)[1:]
            tail = np.cumsum(g_cut[::-1])[::-1]
            g_theta = np.concatenate([tail[:1], tail[1:] * np.exp(theta[1:])])
            sw += g * g
            st += g_theta * g_theta
            w += rate * g / np.sqrt(sw)
            theta += rate * 0.2 * g_theta / np.sqrt(st)
    cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
    return np.concatenate([cuts, w]).astype(np.float32).tobytes()


def train_quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, most: int = 12_000, text: str = "text") -> bytes:
    """A model from ``ratings`` (doc_id, grade from 0), fitted on about ``most`` of the rated documents.

    Without any rated document all weights are 0 and the grades are equally likely.
    """
    rated = labelled(docs.select("doc_id", F.col(text).alias("text")), ratings, most).where(F.col("grade").between(0, n_grades - 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in chunks(batch.column("text")):
                yield packed(batch.column("doc_id")[i:j], batch.column("grade")[i:j], *features(buf, offs))

    return fitted(rated.mapInArrow(rows, ROWS), lambda *x: fit_ordinal(*x, n_grades=n_grades))


def score_quality(docs: DataFrame, model: bytes, n_grades: int = 3, level: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade and tail_probability (of a grade of ``level`` or more); columns of these names are replaced.

    Null and empty texts are scored as a text without words.  ``model`` (256 KB) goes along with the task.
    """
    docs = docs.drop("expected_grade", "tail_probability")
    schema = StructType([*docs.schema, StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType())])
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.frombuffer(bound.value, np.float32).astype(np.float64)
        cuts, w = got[: n_grades - 1], got[n_grades - 1 :]
        for batch in batches:
            x = [dot(w, *features(buf, offs)) for _, _, buf, offs in chunks(batch.column(text))]
            above = 1 - sigmoid(cuts - (np.concatenate(x) if x else np.zeros(0))[:, None])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(1)), pa.array(above[:, level - 1])], names=schema.names)

    return docs.mapInArrow(score, schema)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades 0 to 2 of the table ``labels``: 0 for bad quality, 1 for good quality but toxic, 2 for good and clean."""
    good: Column = F.col("quality").cast("int")
    return labels.select("doc_id", (good * (2 - F.coalesce(F.col("toxic").cast("int"), F.lit(0)))).alias("grade"))
