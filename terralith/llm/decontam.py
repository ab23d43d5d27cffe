"""Benchmark decontamination by latent semantic retrieval.

1. Passage frequencies and counts of hashed words over the whole corpus give TF-IDF weights.
2. A randomised eigendecomposition of A'A, A the TF-IDF matrix of passages, gives the latent space: tasks sum A'(A omega) for
   their passages, once more with an orthonormal basis of that sum in omega's place (a power iteration), and the Nystrom formula
   turns the sum into singular vectors.  Directions below the numerical rank are cut, so that a corpus of a few passages gives a
   small space and no noise.  The vectors are fitted on all passages of the corpus and all benchmark items.
3. Every window of every document is projected, about the mean of the corpus, and compared by cosine with the benchmark
   passages of its length.  Windows start every 8 words and have 16, 32, 48 or 64 words.
4. Candidates are checked: first by how many of the passage's words are missing around the window (as sets of bits, so that
   words are never missed that are there), then the longest common subsequence of words must cover ``verbatim`` of the passage, or ``paraphrase`` of
   it if the answer's words stand there too.  The answer is a column of the benchmark, or else the passage's last four words.

Items of fewer than 5 words have no passage to compare: they are searched word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import deleted, written
from ._text import LOWER, NO_LETTER, U64, chunks, owners, rolled, span_hash, words

BITS = 14
SIZE = 1 << BITS
RANK, EXTRA = 128, 16
STRIDE = 8
SCALES = (2, 4, 6, 8)  # window lengths in strides
PASSAGE = STRIDE * SCALES[-1]
LEAST_WORDS = 5
LIMIT = 1 << 20
GROUP = 2048  # groups of words whose vectors are summed at once
AT_ONCE = 1 << 19  # words of which a sketch is made at once
MARKS = 512  # bits of a set of words
BLOCKS = 16
PIECES = 128  # parts in which sketches are added up, so that one task's holds little of each
POWER = 1  # power iterations
SETTLED = 200  # passages that count against the corpus mean


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter runs in lower case, and the rows' first ones."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, NO_LETTER)
    return span_hash(low, starts, ends), first


def pieces(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces of ``length`` words within rows, and the rows' first pieces."""
    n = -(-np.diff(first) // length)
    at = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(first[:-1], n) + length * (np.arange(at[-1]) - np.repeat(at[:-1], n)), at


def coded(texts: DataFrame) -> DataFrame:
    """(cols, sizes): the columns of the words of some texts (two bytes each), and the numbers of words of their passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column("text"), LIMIT):
                h, first = tokens(buf, offs)
                if len(h):
                    starts, _ = pieces(first, PASSAGE)
                    sizes = np.diff(np.append(starts, len(h))).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in ((h & U64(SIZE - 1)).astype(np.uint16), sizes)], names=["cols", "sizes"])

    return texts.select("text").mapInArrow(run, "cols binary, sizes binary")


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns of the words, numbers of words of the passages) of ``coded`` rows, about AT_ONCE words at a time."""
    cols, sizes = [], []
    for batch in batches:
        for c, s in zip(batch.column("cols"), batch.column("sizes"), strict=True):
            cols.append(np.frombuffer(c.as_buffer(), np.uint16))
            sizes.append(np.frombuffer(s.as_buffer(), np.uint8))
            if sum(map(len, cols)) >= AT_ONCE:
                yield np.concatenate(cols).astype(np.int64), np.concatenate(sizes).astype(np.int64)
                cols, sizes = [], []
    if cols:
        yield np.concatenate(cols).astype(np.int64), np.concatenate(sizes).astype(np.int64)


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(passages that hold a column, occurrences of a column, passages), over all ``coded`` texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, total = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64), 0
        for col, sizes in decoded(batches):
            key = np.sort((np.repeat(np.arange(len(sizes)), sizes) << BITS | col).astype(np.int32 if len(sizes) < 1 << 30 - BITS else np.int64))
            held += np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] & (SIZE - 1), minlength=SIZE)
            seen += np.bincount(col, minlength=SIZE)
            total += len(sizes)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], total)), pa.array(np.append(seen[some], 0))], names=["col", "held", "seen"])

    rows = docs.mapInArrow(count, "col long, held long, seen long").groupBy("col").agg(F.sum("held").alias("held"), F.sum("seen").alias("seen")).toArrow()
    col, h, s = (rows.column(k).to_numpy() for k in ("col", "held", "seen"))
    held, seen, real = np.zeros(SIZE), np.zeros(SIZE), col >= 0
    held[col[real]], seen[col[real]] = h[real], s[real]
    return held, seen, int(h[~real].sum())


def group_sums(table: np.ndarray, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at[start : start + size]`` of ``table``, by group; no group is empty.

    Groups of about one size are summed place by place, so that what is made of them stays in the cache.
    """
    out = np.empty((len(starts), table.shape[1]), table.dtype)
    one = np.empty((GROUP, table.shape[1]), table.dtype)
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(order), GROUP):
        some = order[a : a + GROUP]
        start, size = starts[some], sizes[some]
        total = np.take(table, at[start], axis=0)
        for k in range(1, int(size[0])):
            m = int(np.searchsorted(-size, -k))
            np.take(table, at[start[:m] + k], axis=0, out=one[:m], mode="clip")
            total[:m] += one[:m]
        out[some] = total
    return out


def omega(block: int) -> np.ndarray:
    """The random test matrix, by block of rows."""
    return np.random.default_rng([5, block]).standard_normal((SIZE // BLOCKS, RANK + EXTRA), np.float32)


def sketch(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) for the passages of ``texts`` (text, or what ``coded`` makes of it), A their rows of TF-IDF weights.

    A few MB of fixed size, whatever the texts; tasks add up their passages, and blocks of rows are added up by one task each.
    """
    width, step = basis.shape[1], SIZE // PIECES
    bound = texts.sparkSession.sparkContext.broadcast(basis)
    texts = texts if "cols" in texts.columns else coded(texts)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SIZE, width))
        weighed = bound.value * idf[:, None]
        for col, sizes in decoded(batches):
            starts = np.cumsum(sizes) - sizes
            y = group_sums(weighed, col, starts, sizes)
            y /= np.maximum(1e-6, np.sqrt(np.add.reduceat(idf[col] ** 2, starts)))[:, None] ** 2  # rows of about unit length, on both sides
            # back to the columns, the passages of one in groups of PASSAGE at most
            order = np.argsort(col.astype(np.uint16), kind="stable")
            sorted_ = col[order]
            head = np.flatnonzero(np.diff(sorted_, prepend=-1))
            cut, at = pieces(np.append(head, len(col)), PASSAGE)
            sums = group_sums(y, np.repeat(np.arange(len(starts)), sizes)[order], cut, np.diff(np.append(cut, len(col))))
            total[sorted_[head]] += np.add.reduceat(sums, at[:-1], axis=0)
        total *= idf[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([total[k * step : (k + 1) * step].astype(np.float32).tobytes() for k in range(PIECES)], pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step * width)
        for x in table.column("part").to_pylist():
            total += np.frombuffer(x, np.float32)
        return pa.table({"block": table.column("block")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    got = texts.mapInArrow(part, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").toArrow()
    y = np.zeros((SIZE, width), np.float32)
    for k, piece in zip(got.column("block").to_pylist(), got.column("part"), strict=True):
        y[k * step : (k + 1) * step] = np.frombuffer(piece.as_buffer(), np.float32).reshape(step, width)
    bound.unpersist()
    return y


def latent_space(texts: DataFrame, held: np.ndarray, passages: int) -> np.ndarray:
    """(SIZE, RANK): IDF-weighted right singular vectors of all passages of ``coded`` texts, each over its singular value.

    Without that, the few strong directions (of a language, say) would make all passages of a kind alike.
    """
    idf = np.log((2 + passages) / (1 + held)).astype(np.float32)
    basis = np.concatenate([omega(k) for k in range(BLOCKS)])
    for _ in range(POWER):
        basis = np.linalg.qr(sketch(texts, idf, basis) + np.float32(1e-6) * basis)[0].astype(np.float32)
    y = sketch(texts, idf, basis)
    shift = np.float32(1e-6 * max(1e-12, float(np.linalg.norm(y))))
    y += shift * basis
    core = (basis.T @ y).astype(float)
    low = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * max(1e-12, np.trace(core)) / len(core) * np.eye(len(core)))
    turn = np.linalg.inv(low).T
    m = y @ turn.astype(np.float32)
    values, vectors = np.linalg.eigh((m.T @ m).astype(float))
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    real = values > 1e-4 * max(1e-30, values[0])  # beyond the numerical rank there is only noise
    # singular vectors are y turn vectors / root; each is then divided by its singular value, the root
    final = np.where(real, turn @ vectors * (np.sqrt(max(1e-30, values[0])) / np.where(real, values, 1)), 0)
    return (y @ final.astype(np.float32) * idf[:, None]).astype(np.float32)


@dataclass
class Passages:
    """Benchmark passages of one block of items."""

    items: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    marks: np.ndarray  # (passages, MARKS / 64) sets of words as bits
    units: dict[int, tuple[np.ndarray, np.ndarray]]  # scale: (passage numbers, latent unit vectors)
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # number of words: (sorted hashes of the words in a row, items)


def benchmark_passages(rows: list[tuple], space: np.ndarray) -> Passages:
    """From (item_id, text, answer or None).  Items without a word are left out."""
    items, held, answers, short = [], [], [], {}
    for item, text, answer in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h, _ = tokens(raw, np.array([0, len(raw)]))
        told = None
        if answer:
            raw = np.frombuffer(answer.encode(), np.uint8)
            told, _ = tokens(raw, np.array([0, len(raw)]))
        if 0 < len(h) < LEAST_WORDS:
            short.setdefault(len(h), []).append((int(rolled(h, len(h))[0]), item))
        n = max(1, -(-len(h) // PASSAGE))
        for part in np.array_split(h, n):
            if len(part) >= LEAST_WORDS:
                items.append(item)
                held.append(part)
                answers.append(part[-4:] if told is None or not len(told) else told)
    scale = np.array([min(SCALES, key=lambda s, n=len(w): abs(s * STRIDE - n)) for w in held], np.int64)
    unit = np.array([space[(w & U64(SIZE - 1)).astype(np.int64)].sum(0) for w in held], np.float32).reshape(-1, RANK)
    unit /= np.maximum(1e-9, np.linalg.norm(unit, axis=1))[:, None]
    marks = np.concatenate([word_marks(w, np.zeros(1, np.int64)) for w in held]) if held else np.zeros((0, MARKS // 64), np.uint64)
    units = {s: (np.flatnonzero(scale == s), unit[scale == s]) for s in SCALES if (scale == s).any()}
    return Passages(items, held, answers, marks, units, {n: (np.array([h for h, _ in sorted(x)], U64), np.array([i for _, i in sorted(x)], np.int64)) for n, x in short.items()})


def word_for_word(h: np.ndarray, first: np.ndarray, short: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
    """(row, word, item): where the words of short items stand in a row one after the other."""
    for n, (known, items) in short.items():
        said = rolled(h, n)
        row = np.searchsorted(first, np.arange(len(said)), "right") - 1
        at = np.searchsorted(known, said)
        for k in np.flatnonzero((known[np.minimum(at, len(known) - 1)] == said) & (np.arange(len(said)) + n <= first[row + 1])).tolist():
            for j in range(at[k], int(np.searchsorted(known, said[k], "right"))):
                yield int(row[k]), k - int(first[row[k]]), int(items[j])


def word_marks(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The words of each piece, from its start to the next one, as a set of bits."""
    bit = h >> U64(20)
    word, value = (bit >> U64(6)) % U64(MARKS // 64), U64(1) << (bit & U64(63))
    return np.stack([np.bitwise_or.reduceat(np.where(word == k, value, U64(0)), starts) for k in range(MARKS // 64)], 1)


def block_sums(h: np.ndarray, first: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the blocks of STRIDE words, the rows' first blocks, latent vectors of the blocks).

    ``space`` ends with a row of zeros.
    """
    starts, at = pieces(first, STRIDE)
    place = starts[:, None] + np.arange(STRIDE)
    col = (h & U64(SIZE - 1)).astype(np.int64)
    col = np.where(place < first[1:][owners(at)][:, None], col[np.minimum(place, len(h) - 1)], SIZE)
    total = np.empty((len(starts), space.shape[1]), np.float32)
    one = np.empty((2048, space.shape[1]), np.float32)
    for a in range(0, len(starts), len(one)):
        part = total[a : a + len(one)]
        np.take(space, col[a : a + len(one), 0], axis=0, out=part, mode="clip")
        for k in range(1, STRIDE):
            np.take(space, col[a : a + len(one), k], axis=0, out=one[: len(part)], mode="clip")
            part += one[: len(part)]
    return starts, at, total


def windows(at: np.ndarray, total: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of SCALES: (scale, first blocks, end blocks, latent vectors) of all windows of so many blocks.

    A row shorter than that is one window.  Windows that reach into the next row have first and end -1.
    """
    n = len(total)
    end = at[1:][owners(at)]
    head = at[:-1][np.diff(at) > 0]
    longer = {1: total}
    for scale in SCALES:
        half = max(k for k in longer if scale - k in longer)
        m = max(0, n - scale + 1)
        first = np.arange(m)
        first[first + scale > end[:m]] = -1
        short = head[head + scale > end[head]]
        v = np.empty((m + len(short), total.shape[1]), np.float32)
        longer[scale] = np.add(longer[half][:m], longer[scale - half][half : half + m], out=v[:m])
        for k, (b, e) in enumerate(zip(short.tolist(), end[short].tolist(), strict=True), m):
            total[b:e].sum(0, out=v[k])
        yield scale, np.concatenate([first, short]), np.concatenate([np.where(first < 0, -1, first + scale), end[short]]), v


def common_words(masks: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence, the passage's n words given as bit masks by word."""
    full = (1 << n) - 1
    v = full
    for t in text:
        m = masks.get(t)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def holds(text: np.ndarray, answer: np.ndarray) -> bool:
    """Whether the answer's words stand in the text one after the other."""
    n = len(answer)
    return any((text[k : k + n] == answer).all() for k in np.flatnonzero(text[: max(0, len(text) - n + 1)] == answer[0]))


MATCHES = "doc_id long, text_md5 string, item_ids array<long>, n_items long, first_word long, cosine double, common_share double, answer_found boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, verbatim: float = 0.75, paraphrase: float = 0.6, items_at_once: int = 5_000, bytes_at_once: int = 1 << 24, id_col: str = "doc_id", text: str = "text", answer: str | None = None) -> DataFrame:
    """MATCHES: one row for each row of ``docs`` that holds a benchmark passage: the items, and the best match's place and figures.

    Nulls and empty texts match nothing.  Items of fewer than 5 words match word for word (cosine is then null); ones without
    words match nothing.  Of several best matches the one with the greater cosine, then the later place, is shown.  Repeated rows
    give repeated results, rows without an id too; ``text_md5`` tells texts of one id apart.  An empty benchmark or corpus gives
    no rows.  The benchmark goes to the tasks in blocks of about ``items_at_once`` items or ``bytes_at_once`` bytes, each block in
    a pass over the documents, so its size is no bound; results don't depend on the blocks.
    """
    raw = F.col(text).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(raw).alias("text_md5"), F.lower(raw).alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"), (F.lower(F.col(answer).cast("string")) if answer else F.lit(None).cast("string")).alias("answer")).where("text IS NOT NULL")
    size = bench.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).head()
    # the fit goes over all texts three times: once they are coded, a task reads as many as a file split holds
    corpus = written(coded(docs), "passages")
    held, seen, passages = corpus_counts(corpus)
    asked = written(coded(bench), "items")
    space = latent_space(corpus.unionByName(asked), held, passages)
    deleted(corpus, asked)
    # about the mean of the corpus, as far as there are passages enough to tell it
    space -= (seen @ space / max(1, seen.sum()) * (passages / (passages + SETTLED))).astype(np.float32)
    blocks = max(1, -(-size["items"] // items_at_once), -(-size["bytes"] // bytes_at_once))
    found = None
    for k in range(blocks):
        rows = [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        one = search(docs, benchmark_passages(sorted(rows, key=str), space), space, cosine, verbatim, paraphrase).withColumn("block", F.lit(k))
        found = one if found is None else found.unionByName(one)
    # equal rows have equal results, one in each block that they match: as many rows go back as there are in a block
    best = F.struct("common_share", "cosine", "first_word", "answer_found")
    by_block = found.groupBy("doc_id", "text_md5", "block").agg(F.count("*").alias("copies"), F.first("item_ids").alias("item_ids"), F.max(best).alias("best"))
    whole = by_block.groupBy("doc_id", "text_md5").agg(F.max("copies").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("best").alias("b"))
    rows = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", "text_md5", "item_ids", F.size("item_ids").cast("long").alias("n_items"), "b.first_word", "b.cosine", "b.common_share", "b.answer_found")


def search(docs: DataFrame, passages: Passages, space: np.ndarray, cosine: float, verbatim: float, paraphrase: float) -> DataFrame:
    """MATCHES rows of the documents against one block of the benchmark."""
    bound = docs.sparkSession.sparkContext.broadcast((passages, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, space = bound.value
        masks: list[dict[int, int]] = []
        for w in asked.words:
            m: dict[int, int] = {}
            for k, t in enumerate(w.tolist()):
                m[t] = m.get(t, 0) | 1 << k
            masks.append(m)
        wide = np.concatenate([space, np.zeros((1, space.shape[1]), np.float32)])  # a row of zeros for the end of a text
        size = np.array([len(w) for w in asked.words])
        for batch in batches:
            out = []
            ids, sums = batch.column("doc_id").to_pylist(), batch.column("text_md5").to_pylist()
            for base, _, buf, offs in chunks(batch.column("text"), LIMIT // 4):
                h, first = tokens(buf, offs)
                best: dict[int, dict[int, tuple]] = {}
                if not len(h):
                    continue
                exact: dict[int, dict[int, int]] = {}
                for r, place, item in word_for_word(h, first, asked.short):
                    exact.setdefault(r, {}).setdefault(item, place)
                starts, at, total = block_sums(h, first, wide)
                marks, row = word_marks(h, starts), owners(at)
                for scale, begin, end, v in windows(at, total):
                    if scale not in asked.units:
                        continue
                    number, unit = asked.units[scale]
                    low, high = np.maximum(begin - 1, at[:-1][row[begin]]), np.minimum(end + 1, at[1:][row[begin]])
                    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                    for a in range(0, len(v), 2048):
                        like = v[a : a + 2048] @ unit.T
                        x, y = np.divmod(np.flatnonzero(like >= np.maximum(1e-9, cosine * norm[a : a + 2048, None])), len(unit))
                        inside = begin[x + a] >= 0
                        x, y = x[inside], y[inside]
                        p, x_ = number[y], x + a
                        near, of = np.unique(x_, return_inverse=True)
                        seen = np.zeros((len(near), MARKS // 64), U64)
                        for k in range(scale + 2):
                            seen |= marks[np.minimum(low[near] + k, high[near] - 1)]
                        missing = np.bitwise_count(asked.marks[p] & ~seen[of]).sum(1)
                        some = np.flatnonzero(missing <= (1 - paraphrase) * size[p])  # no longer common subsequence is possible elsewhere
                        share_of = np.round(like[x[some], y[some]] / norm[x_[some]], 4).astype(float)  # sums differ in the last digits by block
                        for k, q, c in zip(x_[some].tolist(), p[some].tolist(), share_of.tolist(), strict=True):
                            r = int(row[begin[k]])
                            known = best.setdefault(r, {})
                            if q in known and known[q][0] > 0.99:
                                continue
                            s, n = int(starts[low[k]]), len(asked.words[q])
                            e = int(starts[high[k]]) if high[k] < at[r + 1] else int(first[r + 1])
                            text = h[s:e]
                            share = common_words(masks[q], n, text.tolist()) / n
                            if share < paraphrase:
                                continue
                            told = holds(text, asked.answers[q])
                            if share >= verbatim or told:
                                known[q] = max(known.get(q, (0.0,)), (share, c, s - int(first[r]), told))
                for r in sorted({*exact, *(r for r, known in best.items() if known)}):
                    known, told = best.get(r, {}), exact.get(r, {})
                    items = sorted({*(asked.items[p] for p in known), *told})
                    top = max([*((share, c, s, found) for share, c, s, found in known.values()), *((1.0, -1.0, s, True) for s in told.values())])
                    out.append((ids[base + r], sums[base + r], items, len(items), top[2], top[1] if top[1] >= 0 else None, top[0], top[3]))
            fields = zip(*out, strict=True) if out else [[] for _ in range(8)]
            types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(f), t) for f, t in zip(fields, types, strict=True)], names=["doc_id", "text_md5", "item_ids", "n_items", "first_word", "cosine", "common_share", "answer_found"])

    return docs.mapInArrow(run, MATCHES)
