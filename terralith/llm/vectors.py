"""Compression of vectors into codes: a codebook for each of PARTS parts of a vector, its entries trained on all rows.

Components are whole numbers, floor(SCALE * x), so all results are exact and the same in every run.  Training takes one pass a
round: tasks add up the parts by nearest entry, and what they send is a row for each part, entry and task.

The nearest entry is found by annular pruning.  Entries are sorted by norm.  By the triangle inequality an entry that is nearer
to x than the best one so far, at distance r, has a norm between |x| - r and |x| + r: the interval is found by binary search,
its ends are counted in, and the entries inside it are evaluated exactly.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._joins import attach
from ._tables import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components beyond this many units stand at it.
FARTHEST = 1 << 40
_BLOCK = 16  # entries that are evaluated together
_MOST = (1 << 63) - 1

Codebooks = list[list[list[int]]]  # part, entry, position


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(vec_id, label, v): whole components of the rows whose vector is neither null nor holds a null, NaN or infinite one."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    unit = lambda x: F.floor(F.least(F.greatest(F.lit(SCALE) * x.cast("double"), F.lit(-float(FARTHEST))), F.lit(float(FARTHEST))))
    kept = vectors.where(F.col(vector).isNotNull()).where(real)
    return kept.select(F.col(id_col).alias("vec_id"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), F.transform(vector, unit).alias("v"))


class Annuli:
    """The entries of one part in the order of their norms."""

    def __init__(self, entries: list[list[int]]):
        self.exact = entries
        self.squares = [sum(c * c for c in e) for e in entries]
        self.order = sorted(range(len(entries)), key=lambda i: (self.squares[i], i))
        self.roots = [math.isqrt(self.squares[i]) for i in self.order]
        self.farthest = max(abs(c) for e in entries for c in e) if entries[0] else 0
        at = np.array(self.order)
        if self.exact_in_doubles(0):
            self.table = np.array(entries, np.float64).reshape(len(entries), -1)[at]
            self.square = (self.table * self.table).sum(1)
            self.norm = np.sqrt(self.square)
        self.number = at

    def exact_in_doubles(self, farthest: int) -> bool:
        """Whether all squared distances to components up to ``farthest`` are exact in doubles."""
        return 4 * max(1, len(self.exact[0])) * max(self.farthest, farthest) ** 2 < 1 << 53

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, ties to the lower one; squared distance, no more than 2^63 - 1) of the rows of ``x``."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.exact_in_doubles(int(np.abs(x).max(initial=0))):
            found = [self._nearest_of(row) for row in x.tolist()]
            return np.array([i for i, _ in found], np.int64), np.array([min(d, _MOST) for _, d in found], np.int64)
        x = x.astype(np.float64)
        square = (x * x).sum(1)
        norm = np.sqrt(square)
        best, index = np.full(len(x), np.inf), np.full(len(x), len(self.number))

        def evaluate(rows: np.ndarray, block: int) -> None:
            span = slice(block * _BLOCK, (block + 1) * _BLOCK)
            d = square[rows, None] + self.square[span] - 2 * (x[rows] @ self.table[span].T)
            least = d.min(1)
            i = np.where(d == least[:, None], self.number[span], len(self.number)).min(1)
            better = (least < best[rows]) | ((least == best[rows]) & (i < index[rows]))
            best[rows[better]], index[rows[better]] = least[better], i[better]

        # a first best distance from the entries whose norms are about the row's
        start = np.minimum(np.searchsorted(self.norm, norm), len(self.norm) - 1) // _BLOCK
        for block in np.unique(start):
            evaluate(np.flatnonzero(start == block), block)
        r = np.sqrt(best)
        spare = 1e-9 * (1 + norm + r)  # more than roots can be off; entries at the very border count
        low = np.searchsorted(self.norm, norm - r - spare, "left")
        high = np.searchsorted(self.norm, norm + r + spare, "right")
        for block in range(-(-len(self.norm) // _BLOCK)):
            rows = np.flatnonzero((low < (block + 1) * _BLOCK) & (high > block * _BLOCK) & (start != block))
            if len(rows):
                evaluate(rows, block)
        return index, best.astype(np.int64)

    def _nearest_of(self, x: list[int]) -> tuple[int, int]:
        """The same for one row of any size, in whole numbers."""
        norm = math.isqrt(sum(c * c for c in x))
        far = lambda i: (sum((a - b) ** 2 for a, b in zip(x, self.exact[i], strict=True)), i)
        best = far(self.order[min(bisect.bisect_left(self.roots, norm), len(self.roots) - 1)])
        r = math.isqrt(best[0])
        inside = self.order[bisect.bisect_left(self.roots, norm - r - 2) : bisect.bisect_right(self.roots, norm + r + 2)]
        d, i = min([best, *map(far, inside)])
        return i, d


def _parts_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """The parts of all vectors of a column, with zeros behind the last component where parts need them."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    v = np.pad(v, ((0, 0), (0, PARTS * width - v.shape[1])))
    return [v[:, k * width : (k + 1) * width] for k in range(PARTS)]


def _round(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the means, rounded down, of the parts that are nearest to them; unused ones stay."""
    width = len(books[0][0])
    bound = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in bound.value]
        total = np.zeros((PARTS, ENTRIES, width), object)
        count = np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            for k, x in enumerate(_parts_of(batch.column("v"), width)):
                near, _ = annuli[k].nearest(x)
                count[k] += np.bincount(near, minlength=ENTRIES)
                exact = annuli[k].exact_in_doubles(int(np.abs(x).max(initial=0)))
                if exact and len(x) < 1 << 20:
                    for j in range(width):
                        total[k, :, j] += np.bincount(near, weights=x[:, j], minlength=ENTRIES).astype(np.int64)
                else:
                    np.add.at(total[k], near, x.astype(object))
        part, entry = np.nonzero(count)
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.decimal128(38, 0))) if width else pa.array([[]] * len(part), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "s"])

    tasks = rows.select("v").mapInArrow(add, "part int, entry int, n long, s array<decimal(38,0)>")
    sums = [F.sum(F.col("s")[j]).cast("decimal(38,0)").alias(f"s{j}") for j in range(width)]
    found = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # PARTS * ENTRIES rows at most
    new = [[list(e) for e in book] for book in books]
    for r in found:
        new[r["part"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    bound.unpersist()
    return new


def train_codebooks(rows: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for ``quantised`` rows of one length, a written table.

    They start as the parts of the ENTRIES rows with the smallest vec_id (nulls last, equal ids by their components); of fewer
    rows there are fewer entries.  No rows give no entries.
    """
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()]
    if not first:
        return [[] for _ in range(PARTS)]
    width = -(-len(first[0]) // PARTS)
    padded = [v + [0] * (PARTS * width - len(v)) for v in first]
    books = [[v[k * width : (k + 1) * width] for v in padded] for k in range(PARTS)]
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part's nearest entry, and the sum of the squared distances."""
    if not books[0]:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
    width = len(books[0][0])
    bound = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in bound.value]
        for batch in batches:
            found = [annuli[k].nearest(x) for k, x in enumerate(_parts_of(batch.column("v"), width))]
            code = [bytes(i).hex() for i in np.stack([i for i, _ in found], 1).astype(np.uint8).tolist()]
            error = [min(_MOST, sum(d)) for d in zip(*(d.tolist() for _, d in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label string, code string, error long")


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of ``vectors`` with a whole vector.

    Rows whose vector is null, empty or holds a null, NaN or infinite component are left out, and so are those of another length
    than most rows have (of several such lengths the greatest).  Repeated rows and rows without an id are rows like others; null
    labels are one label.
    Components of 2^30 and more stand at 2^30; an error beyond 2^63 - 1 stands there.  A length that PARTS doesn't divide
    is filled up with zeros.  Columns other than the three are not looked at.  An empty table gives no rows.
    """
    all_rows = written(quantised(vectors, id_col, vector, label), "quantised")
    lengths = all_rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    rows = all_rows.where(F.size("v") == (lengths["d"] if lengths else -1))
    books = train_codebooks(rows)
    codes = written(encode(rows, books), "codes")
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    found = attach(codes, written(sums, "label-errors"), "label")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = ["""v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, vec_id, label, v FROM v),
p AS MATERIALIZED (SELECT r, k AS part, v[16 * k + 1 : 16 * k + 16] AS v FROM x, range(4) t(k)),
b0 AS MATERIALIZED (SELECT part, r AS entry, v AS e FROM p WHERE r < 256)"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, min(d * 256 + entry) AS best FROM (
    SELECT p.r, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.v, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN b{k} b ON p.part = b.part) GROUP BY r, part)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS MATERIALIZED (
  SELECT part, entry, list(CAST(s - ((s % n) + n) % n AS BIGINT) // n ORDER BY i) AS e FROM (
    SELECT a.part, a.best % 256 AS entry, i, CAST(sum(p.v[i]) AS BIGINT) AS s, count(*) AS n
    FROM a{k} a JOIN p ON a.r = p.r AND a.part = p.part, range(1, 17) u(i) GROUP BY ALL) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.e, b.e) AS e FROM b{k} b LEFT JOIN s{k} s ON b.part = s.part AND b.entry = s.entry)""")
    return "WITH " + ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (
  SELECT r, string_agg(format('{{:02x}}', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY r)
SELECT x.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY x.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM c JOIN x ON c.r = x.r, h"""


ORACLE_SQL = _oracle()
