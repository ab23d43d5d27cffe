"""Toxicity by weak supervision.

Many voters vote toxic, clean or abstain on every document:
* lexicons of plain insults, given as fixed lists;
* lexicons of words, and of word beginnings of 4, 5 and 6 bytes, that stand out in documents labelled toxic.  Labels are used
  for this alone: they say which words to list, and neither the label model nor the classifier sees one;
* patterns: shouting, exclamations, symbols, repeated words.

A generative model of the votes of all documents, most of them without a label, estimates by expectation maximisation the share
of toxic documents, how each voter votes under either label, and how far voters repeat each other beyond the label; correlated
voters count less.  It gives each document a posterior label.  A linear classifier over hashed words and word beginnings is
trained on the posterior labels; it scores every document, over its whole text.

Votes are counted over all documents as one table of vote patterns, which has 3 ** LEXICONS * 2 ** PATTERNS rows at the most.
Lexicons are found in a bounded sample of labelled documents (parameter ``most``), and the classifier is fitted on a bounded
sample of documents with posterior labels (parameter ``learn``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ._linear import ROWS, dot, fitted, labelled, packed, push, share_of, sigmoid
from ._text import LOWER, NO_LETTER, U64, chunks, owners, span_hash, words

BITS = 20
SIZE = 1 << BITS
KINDS = (0, 6, 5, 4)  # whole words, and beginnings of so many bytes of longer words

# Plain English insults by what they are about.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile fool fools foolish dimwit halfwit brainless clueless braindead".split(),
    "trash garbage scum scumbag worthless useless loser losers filth filthy vermin lowlife parasite failure nobody waste".split(),
    "pathetic disgusting disgust clown clowns ugly gross revolting repulsive despicable hideous creep creepy freak freaks shameful".split(),
)
LEXICONS = len(INSULTS) + len(KINDS)
PATTERNS = 4
LEAST_HITS, LEAST_SHARE = 2, 0.005  # of a document's words, for the vote of a lexicon that was found


def hashes(listed: list[str]) -> np.ndarray:
    """The words' hashes, as ``tokens`` gives them."""
    raw = np.frombuffer("".join(listed).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in listed])
    return span_hash(raw, np.concatenate([[0], ends[:-1]]), ends)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of the words and beginnings by kind, the words' hashes, the rows' numbers of words, and (rows, PATTERNS) marks
    of patterns.

    The two highest bits of a column are its kind, so that kinds don't share columns.
    """
    low = LOWER[buf]
    starts, ends, first = words(low, offs, NO_LETTER)
    row = owners(first)
    n_docs, n = len(offs) - 1, np.diff(first)
    out, whole = [], span_hash(low, starts, ends)
    for kind, length in enumerate(KINDS):
        long = ends - starts > length if length else np.ones(len(starts), bool)
        h = span_hash(low, starts[long], starts[long] + length) if length else whole
        out.append((row[long], (kind << BITS - 2) | (h & U64((SIZE >> 2) - 1)).astype(np.int64)))
    total = [np.concatenate([[0], np.cumsum(m)])[offs] for m in ((buf >= 65) & (buf <= 90), buf == 33, np.isin(buf, [35, 36, 37, 38, 42, 124]))]
    size = np.maximum(1, np.diff(offs))
    same = np.zeros(len(whole), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (row[1:] == row[:-1])
    marks = [np.diff(t) / size > 0.05 for t in total] + [np.bincount(row, weights=same, minlength=n_docs) > 0.05 * np.maximum(1, n)]
    return out, whole, n, np.stack(marks, 1)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, values, row offsets): the share of each word and beginning in a row's words, 2 % and more counting as 1."""
    kinds, _, n, _ = tokens(buf, offs)
    key, count = np.unique(np.concatenate([row << BITS | col for row, col in kinds]), return_counts=True)
    share = count / np.maximum(1, n)[key >> BITS]
    return key & SIZE - 1, np.minimum(1, 50 * share).astype(np.float32), np.searchsorted(key >> BITS, np.arange(len(n) + 1))


def mined(grades: np.ndarray, cols: np.ndarray, vals: np.ndarray, offs: np.ndarray, odds: float = 2.5, least: int = 5) -> bytes:
    """Columns for the lexicons, a byte each: 1 where LEAST_SHARE of the words or more is that much likelier in documents labelled toxic."""
    toxic = (grades == 1).astype(float)
    often = (vals >= 50 * LEAST_SHARE / LEAST_HITS).astype(np.float32)
    n1, n0 = toxic.sum(), len(grades) - toxic.sum()
    c1 = push(toxic, cols, often, offs, SIZE)
    c0 = push(1 - toxic, cols, often, offs, SIZE)
    found = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)) > odds
    return (found & (c1 >= least)).astype(np.uint8).tobytes()


def votes(buf: np.ndarray, offs: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """(rows, LEXICONS + PATTERNS) of -1, 0, 1.

    A fixed lexicon votes 1 if any word is listed, one that was found if LEAST_HITS words or more, and LEAST_SHARE of all, are;
    -1 if none is.  A pattern votes 1 or -1.
    """
    kinds, whole, n, marks = tokens(buf, offs)
    hits = [np.bincount(kinds[0][0], weights=np.isin(whole, hashes(listed)), minlength=len(n)) for listed in INSULTS]
    hits += [np.bincount(row, weights=lexicon[col], minlength=len(n)) for row, col in kinds]
    h = np.stack(hits, 1)
    fixed = np.arange(LEXICONS) < len(INSULTS)
    said = np.where(h == 0, -1, np.where(fixed | ((h >= LEAST_HITS) & (h >= LEAST_SHARE * np.maximum(1, n)[:, None])), 1, 0))
    return np.concatenate([said, np.where(marks, 1, -1)], 1).astype(np.int8)


def code_of(v: np.ndarray) -> np.ndarray:
    """Vote patterns as numbers."""
    return (v.astype(np.int64) + 1) @ 3 ** np.arange(v.shape[1])


def votes_of(code: np.ndarray, m: int = LEXICONS + PATTERNS) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(m) % 3 - 1).astype(np.int8)


def vote_patterns(docs: DataFrame, lexicon: np.ndarray, text: str = "text") -> DataFrame:
    """(code, n): how many documents have each pattern of votes."""
    bound = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [code_of(votes(buf, offs, bound.value)) for _, _, buf, offs in chunks(batch.column(0))]
            code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def label_model(v: np.ndarray, n: np.ndarray, rounds: int = 60, start: float = 0.1) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(posterior of label 1 by pattern, share of label 1, P(vote is 1 | label, no abstention) as (voters, 2), voters' weights).

    ``v`` holds distinct vote patterns and ``n`` how often each occurs.  An abstention says nothing of the label.  Starts as if
    each rare vote of a lexicon told the truth.  A voter's weight is 1 over 1 plus its correlations above 0.1 with other voters
    that remain once the label is known, and voters that are almost one (a raw correlation above 0.8) share one vote.
    """
    m = v.shape[1]
    yes, no = (v == 1).astype(float), (v == -1).astype(float)
    share, n = start, n.astype(float)
    total = max(1.0, n.sum())
    # voters that vote 1 on less than half of what they judge are trusted at the start; no label enters
    rare = (n @ yes) < 0.5 * np.maximum(1e-9, n @ (yes + no))
    lexical = np.arange(m) < m - PATTERNS
    q = np.where((yes * (rare & lexical)).sum(1) > 0, 0.9, start / 10)
    # voters that are almost one share a vote from the start
    mean = n @ v / total
    c = (v - mean).T @ ((v - mean) * n[:, None] / total)
    d = np.sqrt(np.maximum(1e-9, np.diag(c)))
    alike = 1 / np.maximum(1, (c / np.outer(d, d) > 0.8).sum(1))
    weight = alike
    for step in range(rounds):
        table = np.stack([((w := n * p) @ yes + 0.5 * a) / (w @ (yes + no) + 1) for p, a in ((1 - q, 0.2), (q, 1.0))], 1)
        share = float(np.clip(n @ q / total, 1e-4, 0.5))
        if step % 10 == 5:
            extra = np.zeros((m, m))
            for p in (q, 1 - q):
                w = n * p / max(1e-9, n @ p)
                c = v - w @ v
                c = c.T @ (c * w[:, None])
                d = np.sqrt(np.maximum(1e-9, np.diag(c)))
                extra = np.maximum(extra, c / np.outer(d, d) * ((d > 1e-2)[:, None] & (d > 1e-2)[None]))
            np.fill_diagonal(extra, 0)
            weight = np.minimum(alike, 1 / (1 + np.where(extra > 0.1, extra, 0).sum(1)))
        up, down = np.log(table[:, 1] / table[:, 0]), np.log((1 - table[:, 1]) / (1 - table[:, 0]))
        q = sigmoid(np.log(share / (1 - share)) + yes @ (weight * up) + no @ (weight * down))
    return q, share, table, weight


def scaled(x: np.ndarray, q: np.ndarray, bias: float, rounds: int = 25) -> tuple[float, float]:
    """(slope, bias) by which scores x, with ``bias`` in them, become the log odds of the posterior labels q: Platt scaling, by
    Newton steps with a small ridge.  The penalty and the even weight of both labels leave x too flat and off."""
    a, b = 1.0, 0.0
    z = np.stack([x, np.ones(len(x))], 1)
    for _ in range(rounds):
        p = sigmoid(a * x + b)
        g = z.T @ (p - q) + np.array([1e-3 * (a - 1), 1e-3 * b])
        h = z.T @ (z * np.maximum(1e-6, p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = float(np.clip(a - np.clip(step[0], -1, 1), 0.1, 10)), b - float(np.clip(step[1], -3, 3))
    return a, a * bias + b


def fit_classifier(code: np.ndarray, cols: np.ndarray, vals: np.ndarray, offs: np.ndarray, known: np.ndarray, posterior: np.ndarray, rounds: int = 100, sparsity: float = 1e-4) -> bytes:
    """Bias and weights of a logistic model of the posterior labels, by accelerated proximal gradient with an L1 penalty.

    ``code`` holds the rows' vote patterns, ``known`` all patterns in order with their ``posterior``.
    """
    w, bias = np.zeros(SIZE), 0.0
    n = len(code)
    q = posterior[np.searchsorted(known, code)] if n else np.zeros(0)
    if n and 0 < (q > 0.5).sum() < n:
        share = np.where(q > 0.5, 0.5 / max(1, (q > 0.5).sum()), 0.5 / max(1, (q <= 0.5).sum()))
        seen = np.bincount(cols, minlength=SIZE)
        scale = np.where(seen >= 4, 1.0, 0.0)
        # one step size by column: curvature is at most a quarter of the column's weight times the rows' sums
        length = dot(np.ones(SIZE), cols, vals, offs)
        curve = 0.25 * push(share * (1 + length), cols, vals, offs, SIZE) + 1e-6
        past, y, t, y_bias, past_bias = w, w, 1.0, 0.0, 0.0
        for _ in range(rounds):
            g = share * (sigmoid(dot(y, cols, vals, offs) + y_bias) - q)
            step = y - scale * push(g, cols, vals, offs, SIZE) / curve
            w = np.sign(step) * np.maximum(0, np.abs(step) - sparsity / curve)
            bias = y_bias - g.sum() / (0.25 * (1 + float(share @ length)))
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, y_bias = w + (t - 1) / t_next * (w - past), bias + (t - 1) / t_next * (bias - past_bias)
            past, past_bias, t = w, bias, t_next
        slope, bias = scaled(dot(w, cols, vals, offs) + bias, q, bias)
        w = slope * w
    elif n:
        bias = float(np.clip(np.log((q.mean() + 1e-4) / (1 - q.mean() + 1e-4)), -8, 8))
    return np.concatenate([[bias], w]).astype(np.float32).tobytes()


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = 12_000, learn: int = 16_000, text: str = "text", id_col: str = "doc_id") -> bytes:
    """A model from ``docs``, all of which vote, and ``labels`` (doc_id, grade 0 or 1), which say where to look for lexicons.

    About ``most`` labelled documents are looked at, and the classifier is fitted on about ``learn`` documents, chosen by a hash
    of their id.  Null and empty texts have no words and vote clean; repeated rows count each; rows without an id vote, but
    aren't chosen; a text of any length is one row.  Without labels of both kinds the fixed lexicons are left; without any
    document every score is 0.5.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rated = labelled(source, labels, most).where("grade IN (0, 1)")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in chunks(batch.column("text")):
                yield packed(batch.column("doc_id")[i:j], batch.column("grade")[i:j], *features(buf, offs))

    lexicon = np.frombuffer(fitted(rated.mapInArrow(rows, ROWS), mined), np.uint8).astype(float)
    patterns = sorted((r["code"], r["n"]) for r in vote_patterns(source, lexicon).collect())  # a bounded table, see above
    known, n = (np.array([p[k] for p in patterns], np.int64) for k in range(2))
    posterior, _, _, _ = label_model(votes_of(known), n) if len(known) else (np.zeros(0), 0.0, None, None)
    chosen = source.where("doc_id IS NOT NULL").where(share_of(learn, int(n.sum()), "doc_id", F.lit("learn")))
    bound = docs.sparkSession.sparkContext.broadcast(lexicon)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in chunks(batch.column("text")):
                yield packed(batch.column("doc_id")[i:j], pa.array(code_of(votes(buf, offs, bound.value)).astype(np.int32)), *features(buf, offs))

    return fitted(chosen.mapInArrow(coded, ROWS), lambda *x: fit_classifier(*x, known=known, posterior=posterior))


def score_toxicity(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5); columns of these names are replaced.

    Null and empty texts get the score of a text without words; equal texts get equal scores, so repeated rows do; an empty
    table gives no rows.  ``model`` (1 MB) goes along with the task.
    """
    docs = docs.drop("score", "predicted")
    schema = StructType([*docs.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.frombuffer(bound.value, np.float32).astype(np.float64)
        for batch in batches:
            x = [dot(got[1:], *features(buf, offs)) for _, _, buf, offs in chunks(batch.column(text))]
            score = sigmoid(got[0] + (np.concatenate(x) if x else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)
