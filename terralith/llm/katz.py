"""Katz backoff language model of order 3 with Good-Turing discounts and exactly normalised backoff weights.

With c the training counts, N all training tokens and c* the discounted counts (Good-Turing for counts of 1 to 5; greater ones
lose ABOVE of a count, so that every context leaves some probability to backoff),
    P(w)     = c1*(w) / (N + 1),  and what is left is the probability of the one unknown token,
    P(w|v)   = c2*(vw) / c(v)     if c(vw) > 0,   else  a(v) P(w),
    P(w|uv)  = c3*(uvw) / c(uv)   if c(uvw) > 0,  else  a(uv) P(w|v),
    a(h)     = (1 - sum of P(w|h) over the w seen after h) / (1 - sum of their P(w|h less its first token));  1 if h was never seen.
So the probabilities of all known tokens and the unknown one sum to 1 after every history.

Tokens are words with A-Z in lower case, then one end for each document; a start stands before its first token, whose history is
the start alone.  N-grams are known by 56-bit hashes.  Documents lie in packs; the tables of counts are dealt by hash:
1. Each pack sends its distinct tokens and pairs with training counts; each task sums its part, keeps count of counts, and
   answers each pack with the totals, and for each training pair names one pack that accounts for it.
2. The same for triples, but only for those whose first two tokens other packs have trained on too or held-out documents hold:
   the counts of the rest are known in the pack.
3. Packs evaluate their tokens.  For n-grams that they account for they send sums by history, for tokens that back off after a
   known history they send history and document.  Histories of no held-out document need no sum.
4. Tasks by history compute a(h) and answer each pack with sums of log a(h) by document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packs import BUNDLE, FAN, LAST, ROW, by_pack, exchange, expand, opened, outgoing, packs, received, rows_of, squeeze
from ._tables import deleted, written
from ._text import LOWER, U64, crc_mod, mix, owners, parts, span_hash, words

TOP = 5  # greatest count with a Good-Turing discount
ABOVE = 0.05  # of a count, taken off each greater one
FOLDS, HELD_OUT = 7, 2
END, START = 0x00D15EA5ED00D1, 0x00BE61000BE610
TOKENS, PAIRS, TRIPLES = 1, 2, 3
COUNTS = 3  # added to a kind of n-grams: the kind of the answers
STATS, SUMS, ASKED, SCORES, BACKOFF = range(7, 12)
ROUNDS = 4  # packs are evaluated a part at a time, so that not all of them lie in a shuffle at once
LONGER = U64(1 << 60)  # marks histories of two tokens


def seven(h: np.ndarray) -> bytes:
    """56-bit numbers in seven bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unseven(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8, 7 * n).reshape(-1, 7)
    return out.view("<u8").ravel()


def narrow(counts: np.ndarray, bits: np.ndarray) -> bytes:
    """Counts of up to 64 bits, in as few bytes as the greatest needs, and a byte of bits each."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(counts) or int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + squeeze(counts.astype(f"<u{width}").tobytes() + bits.astype(np.uint8).tobytes())


def widened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, raw = data[0], expand(data[1:])
    n = len(raw) // (width + 1)
    return np.frombuffer(raw, f"<u{width}", n).astype(np.int64), np.frombuffer(raw, np.uint8, n, width * n)


class Stream:
    """Tokens of a pack: distinct n-grams, in the order in which they are sent, and each token's place in them."""

    def __init__(self, ids: np.ndarray, buf: np.ndarray, offs: np.ndarray, buckets: int):
        hashes, counts = [], []
        for _, _, part, at in parts(buf, offs, 1 << 20):
            low = LOWER[part]
            starts, ends, first = words(low, at)
            hashes.append(span_hash(low, starts, ends) >> U64(8))
            counts.append(np.diff(first))
        n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.buckets = buckets
        self.first = np.concatenate([[0], np.cumsum(n_words + 1)])
        self.doc = owners(self.first)
        n = int(self.first[-1])
        token = np.full(n, END, U64)
        last = self.first[1:] - 1
        word = np.ones(n, bool)
        word[last] = False
        if hashes:
            token[word] = np.concatenate(hashes)
        context = np.empty(n, U64)
        context[1:] = token[:-1]
        context[self.first[:-1]] = START
        held = crc_mod(ids, FOLDS) == HELD_OUT
        held[ids == LAST] = False
        self.held = held
        self.train = ~held[self.doc]
        self.tokens, self.token = np.unique(np.append(token, U64(START)), return_inverse=True)
        self.context = np.append(self.token[-1], self.token[:-2])
        self.context[self.first[:-1]] = self.token[-1]
        self.token = self.token[:-1]
        pair = mix(context * U64(0x9E3779B97F4A7C15) + token) >> U64(8)
        self.pairs, at, self.pair = np.unique(pair, return_index=True, return_inverse=True)
        self.pair_context, self.pair_token = self.context[at], self.token[at]
        m = len(self.tokens)
        self.token_train = np.bincount(self.token[self.train], minlength=m)
        self.pair_train = np.bincount(self.pair[self.train], minlength=len(self.pairs))
        self.inner = np.ones(n, bool)  # tokens with two before them, the start counted
        self.inner[self.first[:-1]] = False
        self.inner = np.flatnonzero(self.inner)
        self.token_asked = np.bincount(self.context[~self.train], minlength=m) > 0
        self.pair_asked = np.bincount(self.pair[self.inner - 1][~self.train[self.inner]], minlength=len(self.pairs)) > 0
        self.dealt = {TOKENS: self.deal(self.tokens), PAIRS: self.deal(self.pairs)}

    def with_triples(self) -> Stream:
        history, tail = self.pair[self.inner - 1], self.pair[self.inner]
        triple = mix(self.pairs[history] * U64(0x9E3779B97F4A7C15) + self.tokens[self.token[self.inner]] + U64(3)) >> U64(8)
        self.triples, at, self.triple = np.unique(triple, return_index=True, return_inverse=True)
        self.triple_history, self.triple_tail = history[at], tail[at]
        self.triple_train = np.bincount(self.triple[self.train[self.inner]], minlength=len(self.triples))
        return self

    def shared(self, pair_counts: np.ndarray, pair_bits: np.ndarray) -> np.ndarray:
        """The triples whose history other packs have trained on, or some pack asks for."""
        return np.flatnonzero(((pair_counts > self.pair_train) | (pair_bits & 2 > 0) & (pair_counts > 0))[self.triple_history])

    def deal(self, h: np.ndarray) -> list[np.ndarray]:
        """Indices by bucket, in order of the hashes."""
        part = (h % U64(self.buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return np.split(order, np.searchsorted(part[order], np.arange(1, self.buckets)))

    def answers(self, rows: dict[tuple[int, int], bytes], kind: int, dealt: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, bits) from answers of a kind, in the n-grams' order."""
        c, bits = np.zeros(n, np.int64), np.zeros(n, np.uint8)
        for k, use in enumerate(dealt):
            if len(use):
                c[use], bits[use] = widened(rows[kind + COUNTS, k])
        return c, bits


def question(name: str, kind: int, part: int, h: np.ndarray, train: np.ndarray, flag: np.ndarray) -> tuple:
    return name, kind, part, len(h).to_bytes(4, "little") + seven(h) + narrow(train, flag)


def stats_of(kind: int, known: np.ndarray) -> np.ndarray:
    """(kind, sum, types, types with counts 1 to TOP + 1) of counts above 0."""
    return np.array([kind, int(known.sum()), len(known), *np.bincount(np.minimum(known, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist()], np.int64)


def meet(got: pa.Table) -> pa.Table:
    """ROWs of one kind and part from all packs: answers to each, and counts of counts.

    Bits of an answer: 1, for tokens that some pack asks for as a history, for others that this pack is to account for the
    n-gram; 2, for pairs that some pack asks for as a history.
    """
    kind, part = got.column("kind")[0].as_py(), got.column("part")[0].as_py()
    names, blobs = got.column("pack").to_pylist(), got.column("blob").to_pylist()
    if kind == STATS:
        rows = np.stack([np.frombuffer(b, np.int64) for b in blobs])
        total = rows.sum(0)
        total[0] = rows[0, 0]
        return pa.Table.from_batches([rows_of([("", STATS, part, total.tobytes())])])
    hashes, train, flags, sizes = [], [], [], []
    for b in blobs:
        n = int.from_bytes(b[:4], "little")
        hashes.append(unseven(b[4:], n))
        c, f = widened(b[4 + 7 * n :])
        train.append(c)
        flags.append(f)
        sizes.append(n)
    every, mine, flag = np.concatenate(hashes), np.concatenate(train), np.concatenate(flags)
    order = np.argsort(every, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    of = np.empty(len(every), np.int64)
    of[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(every))))
    total = np.add.reduceat(mine[order], heads)
    asked = np.maximum.reduceat(flag[order], heads)[of] > 0
    if kind == TOKENS:
        bits = asked.astype(np.uint8)
    else:  # the first pack that has trained on the n-gram accounts for it
        place = np.where(mine > 0, np.arange(len(mine)), len(mine))
        bits = (np.minimum.reduceat(place[order], heads)[of] == np.arange(len(mine))).astype(np.uint8) + 2 * asked
    # the start is no token: it has no count of its own and isn't among the types
    answers, cuts = total[of], np.cumsum([0, *sizes]).tolist()
    out = [(n, kind + COUNTS, part, narrow(answers[a:b], bits[a:b])) for n, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)]
    return pa.Table.from_batches([rows_of([*out, ("", STATS, part, stats_of(kind, total[total > 0]).tobytes())])])


def short_counts(table: DataFrame, buckets: int, fan: int = FAN, scratch: list[DataFrame] | None = None) -> DataFrame:
    """ROW: totals of tokens and pairs for each pack, and counts of counts of each bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in by_pack(batches):
            s = Stream(*opened(rows), buckets)
            out = []
            for kind, h, train, flag in ((TOKENS, s.tokens, s.token_train, s.token_asked), (PAIRS, s.pairs, s.pair_train, s.pair_asked)):
                out += [question(name, kind, k, h[use], train[use], flag[use]) for k, use in enumerate(s.dealt[kind]) if len(use)]
            yield outgoing(name, out, buckets, fan)

    return exchange(table.mapInArrow(send, ROW), meet, ["kind", "part"], buckets, fan, scratch)


def triple_counts(together: DataFrame, buckets: int, fan: int = FAN, scratch: list[DataFrame] | None = None) -> DataFrame:
    """ROW: the same for triples, from packs and their pairs' totals."""

    def send(got: pa.Table) -> pa.Table:
        name, rows = received(got)
        s = Stream(*opened(rows), buckets).with_triples()
        use = s.shared(*s.answers(rows, PAIRS, s.dealt[PAIRS], len(s.pairs)))
        alone = np.ones(len(s.triples), bool)
        alone[use] = False
        known = s.triple_train[alone & (s.triple_train > 0)]
        none = np.zeros(len(use), np.uint8)
        out = [question(name, TRIPLES, k, s.triples[use][x], s.triple_train[use][x], none[x]) for k, x in enumerate(s.deal(s.triples[use])) if len(x)]
        out.append(("", STATS, int(s.pairs[0] % U64(buckets)) if len(s.pairs) else 0, stats_of(TRIPLES, known).tobytes()))
        return pa.Table.from_batches([outgoing(name, out, buckets, fan)])

    return exchange(together.groupBy("pack").applyInArrow(send, ROW), meet, ["kind", "part"], buckets, fan, scratch)


def summed(stats: DataFrame) -> np.ndarray:
    """Rows of STATS, added up by kind in the tasks that hold them, then in a few tasks: at most some dozens come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                row = np.frombuffer(blob, np.int64)
                total[int(row[0])] = total.get(int(row[0]), 0) + row
        for kind, row in total.items():
            row[0] = kind
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes()], pa.binary())], names=["blob"])

    rows = stats.select("blob").mapInArrow(add, "blob binary").repartition(8).mapInArrow(add, "blob binary").collect()
    return np.array([np.frombuffer(bytes(r["blob"]), np.int64) for r in rows])


def discounts(n: np.ndarray) -> np.ndarray:
    """By count from 0 to TOP: Katz's discounts from the numbers n of types with counts 1 to TOP + 1.

    Where Good-Turing gives no ratio between 0 and 1 (too little data), half a count is taken off each instead.
    """
    d = np.ones(TOP + 1)
    r = np.arange(1, TOP + 1)
    d[1:] = (r - 0.5) / r
    if (n > 0).all():
        common = (TOP + 1) * n[TOP] / n[0]
        good = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common) if common != 1 else np.zeros(TOP)
        if ((good > 0) & (good < 1)).all():
            d[1:] = good
    return d


class Model:
    """The numbers that hold for the whole model."""

    def __init__(self, stats: np.ndarray):
        """stats: rows of STATS."""
        by = {k: stats[stats[:, 0] == k].sum(0) if len(stats) else np.zeros(TOP + 4, np.int64) for k in (TOKENS, PAIRS, TRIPLES)}
        self.n, self.types = int(by[TOKENS][1]), int(by[TOKENS][2])
        self.d = {k: discounts(by[k][3:]) for k in by}
        low = by[TOKENS][3 : TOP + 3] * np.arange(1, TOP + 1)
        above = self.types - int(by[TOKENS][3 : TOP + 3].sum())
        discounted = (low * self.d[TOKENS][1:]).sum() + self.n - low.sum() - ABOVE * above
        self.unknown = 1 - discounted / (self.n + 1)

    def mass(self, kind: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(c <= TOP, self.d[kind][np.minimum(c, TOP)] * c, c - ABOVE)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.mass(TOKENS, c) / (self.n + 1), self.unknown)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int | None = None, fan: int = FAN) -> DataFrame:
    """RESULT: log10 probabilities of every whole text.  Documents with crc32(id) mod 7 of 2 are held out of the training.

    Null and empty texts hold the end token only; rows without an id belong to the training; repeated rows count each; an
    empty table gives no rows.  Without any training token all scores are 0.  ``buckets``: hash parts of the count tables (where
    it isn't given: one for each four packs of 4 MB, and two for each shuffle partition at least, so that parts don't grow).
    ``fan``: the most rows that a pack sends at once; beyond that many buckets they are reached in two steps.
    """
    spark = docs.sparkSession
    table = written(packs(docs, id_col, text), "packs")
    buckets = buckets or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), table.where("kind = 0 AND part = 1").count() // 4)
    between: list[DataFrame] = []
    counts = written(short_counts(table, buckets, fan, between), "counts")
    numbers = F.col("kind") == STATS
    together = table.unionByName(counts.where(~numbers))
    triples = written(triple_counts(together, buckets, fan, between), "triples")
    deleted(*between)
    model = Model(summed(counts.where(numbers).unionByName(triples.where(numbers))))

    def evaluate(got: pa.Table) -> pa.Table:
        name, rows = received(got)
        ids, buf, offs = opened(rows)
        s = Stream(ids, buf, offs, buckets).with_triples()
        c1, asked1 = s.answers(rows, TOKENS, s.dealt[TOKENS], len(s.tokens))
        c2, bits = s.answers(rows, PAIRS, s.dealt[PAIRS], len(s.pairs))
        own2, asked2 = bits & 1 > 0, bits & 2 > 0
        c3, own3 = s.triple_train.astype(np.int64), s.triple_train > 0
        use = s.shared(c2, bits)
        c3[use], bits = s.answers(rows, TRIPLES, s.deal(s.triples[use]), len(use))
        own3[use] = bits & 1 > 0
        seen = c1.copy()  # as a history
        seen[s.tokens == START] = c1[s.tokens == END].sum()
        p1 = model.unigram(c1)
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(c2 > 0, model.mass(PAIRS, c2) / seen[s.pair_context], 0)
            p3 = np.where(c3 > 0, model.mass(TRIPLES, c3) / c2[s.triple_history], 0)
        out = []
        # sums over the n-grams that this pack accounts for, by history
        for own, history, hashes, count, mass, lower in (
            (own2 & (asked1[s.pair_context] > 0), s.pair_context, s.tokens, seen, p2, p1[s.pair_token]),
            (own3 & asked2[s.triple_history], s.triple_history, s.pairs | LONGER, c2, p3, p2[s.triple_tail]),
        ):
            mine = np.flatnonzero(own)
            h, at = np.unique(history[mine], return_inverse=True)
            a, b = (np.bincount(at, weights=x[mine], minlength=len(h)) for x in (mass, lower))
            out += [(name, SUMS, k, squeeze(hashes[h[x]].tobytes() + a[x].tobytes() + b[x].tobytes())) for k, x in enumerate(s.deal(hashes[h])) if len(x)]
        # tokens by document: a seen triple decides; otherwise the pair after a(uv), and if that is unseen the token after a(v)
        log = np.log10(np.where(c2 > 0, p2, p1[s.pair_token]))[s.pair]
        log[s.inner] = np.where(c3[s.triple] > 0, np.log10(np.where(c3 > 0, p3, 1))[s.triple], log[s.inner])
        lost2 = np.flatnonzero(((c2 == 0) & (seen[s.pair_context] > 0))[s.pair])
        lost3 = np.flatnonzero(((c3 == 0) & (c2[s.triple_history] > 0))[s.triple])
        key = np.concatenate([s.tokens[s.context[lost2]], s.pairs[s.triple_history[s.triple[lost3]]] | LONGER])
        doc = np.concatenate([s.doc[lost2], s.doc[s.inner[lost3]]])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        times, key, doc = np.diff(np.append(heads, len(key))), key[heads], doc[heads]
        out += [(name, ASKED, k, squeeze(key[x].tobytes() + doc[x].astype(np.int32).tobytes() + times[x].astype(np.int32).tobytes())) for k, x in enumerate(s.deal(key)) if len(x)]
        n = len(ids)
        base = np.log10((c1 + 1) / (model.n + model.types + 1))
        by_doc = [ids.tobytes(), s.held.astype(np.int64).tobytes(), np.diff(s.first).astype(np.int64).tobytes(), np.bincount(s.doc, weights=c1[s.token] > 0, minlength=n).astype(np.int64).tobytes()]
        by_doc += [np.bincount(s.doc, weights=x, minlength=n).tobytes() for x in (base[s.token], log)]
        return pa.Table.from_batches([outgoing(name, out, buckets, fan), rows_of([(name, SCORES, 0, squeeze(b"".join(by_doc)))])])

    everything, round_of = together.unionByName(triples.where(~numbers)), F.pmod(F.xxhash64("pack"), F.lit(ROUNDS))
    some = [written(everything.where(round_of == k).groupBy("pack").applyInArrow(evaluate, ROW), "evaluated") for k in range(ROUNDS)]
    first = functools.reduce(DataFrame.unionByName, some)
    deleted(table, counts, triples)  # what follows reads the evaluated packs alone

    def weigh(got: pa.Table) -> pa.Table:
        sums, asked = [], []
        for name, kind, blob in zip(*(got.column(c).to_pylist() for c in ("pack", "kind", "blob")), strict=True):
            data = expand(blob)
            if kind == SUMS:
                n = len(data) // 24
                sums.append((np.frombuffer(data, U64, n), np.frombuffer(data, np.float64, n, 8 * n), np.frombuffer(data, np.float64, n, 16 * n)))
            else:
                n = len(data) // 16
                asked.append((name, np.frombuffer(data, U64, n), np.frombuffer(data, np.int32, n, 8 * n), np.frombuffer(data, np.int32, n, 12 * n)))
        out = []
        if asked:
            h, mass, lower = (np.concatenate(x) for x in zip(*sums, strict=True))
            history, at = np.unique(h, return_inverse=True)
            log = np.log10((1 - np.bincount(at, weights=mass)) / (1 - np.bincount(at, weights=lower)))
            for name, h, doc, times in asked:
                docs_, where = np.unique(doc, return_inverse=True)
                total = np.bincount(where, weights=log[np.searchsorted(history, h)] * times)
                out.append((name, BACKOFF, got.column("part")[0].as_py(), squeeze(docs_.astype(np.int64).tobytes() + total.tobytes())))
        return pa.Table.from_batches([rows_of(out)])

    backoff = exchange(first.where(F.col("kind").isin(SUMS, ASKED, BUNDLE)), weigh, ["part"], buckets, fan)
    train_tokens = model.n

    def finish(got: pa.Table) -> pa.Table:
        _, rows = received(got)
        data = expand(rows[SCORES, 0])
        n = len(data) // 48
        ids, held, size, known = (np.frombuffer(data, np.int64, n, 8 * n * k) for k in range(4))
        base, score = np.frombuffer(data, np.float64, n, 32 * n), np.frombuffer(data, np.float64, n, 40 * n).copy()
        for key in sorted(k for k in rows if k[0] == BACKOFF):
            data = expand(rows[key])
            m = len(data) // 16
            score[np.frombuffer(data, np.int64, m)] += np.frombuffer(data, np.float64, m, 8 * m)
        doc = pa.array([None if i == LAST else i for i in ids.tolist()], pa.int64())
        return pa.table({"doc_id": doc, "held_out": pa.array(held > 0), "n_tokens": pa.array(size), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, train_tokens)), "base_score": pa.array(base), "score": pa.array(score)})

    return first.where(F.col("kind") == SCORES).unionByName(backoff).groupBy("pack").applyInArrow(finish, RESULT)
