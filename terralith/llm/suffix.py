"""Removal of repeated passages by a distributed suffix sort.

A passage is a string of LENGTH bytes; a document loses the bytes of each passage that also starts in a document with a
smaller id.  Only suffixes that start at anchors are sorted: the anchor of a passage is the place of its least hashed
GRAM-byte string, so equal passages have it at the same offset, and a passage is known by its anchor, what stands to the right
of it and what stands to the left.

1. Documents are put into packs of a few MB, a table of compressed rows.
2. Each pack sends the hashes of its anchors to hash buckets (one row for a pack and bucket, each hash once) and gets back
   those that also stand in another document.  What repeats inside the pack is known there.
3. The suffixes at repeated anchors, one for equal surroundings in a pack with the least document id, are sorted by pack and
   exchanged as front-coded runs, dealt by ranges of their first GRAM bytes, so that the merged parts stand in order.  A task merges its
   runs with a loser tree that keeps each head's common prefix with the last output: unequal prefix lengths decide without a look at the bytes, equal ones compare
   only what lies beyond.  The merge gives the sorted suffixes with their common prefixes, and from them, for each offset of
   the anchor in the passage, classes of equal passages with their least document id.
4. Each pack gets a bit by suffix and offset, and removes bytes.

A hot passage costs one suffix a pack and surroundings, not one a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packs import FAN, LAST, ROW, by_pack, exchange, expand, opened, outgoing, packs, received, rows_of, squeeze
from ._tables import deleted, written
from ._text import U64, mix, powers

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # offsets of an anchor in a passage
SEGMENT = 1 << 20

def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, least offset, greatest offset, 48-bit hash) of the anchors of all passages inside documents.

    Passages with offsets in that range, and no others, have this anchor.  An anchor may appear twice with other offsets.
    """
    out = []
    power, inverse = powers(SEGMENT + LENGTH + 1)
    first, last = offs[:-1], offs[1:] - LENGTH
    real = np.flatnonzero(last >= first)
    for a in range(0, len(buf) - LENGTH + 1, SEGMENT):
        part = buf[a : a + SEGMENT + LENGTH - 1]
        n = len(part)
        if n < LENGTH:
            break
        total = np.zeros(n + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * power[:n], out=total[1:])
        h = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
        at = np.arange(len(h), dtype=U64)
        m = (h & U64(0xFFFFFFFFFF000000)) | at
        for width in (1, 2, 4, 8):
            m = np.minimum(m[:-width], m[width:])
        m = np.minimum(m[: 16 - SPAN], m[SPAN - 16 :])  # over SPAN places
        lo, hi = np.maximum(first[real] - a, 0), np.minimum(last[real] - a, len(m) - 1)
        good = np.zeros(len(m) + 1, np.int32)
        some = lo <= hi
        np.add.at(good, lo[some], 1)
        np.add.at(good, hi[some] + 1, -1)
        p = np.flatnonzero(np.cumsum(good[:-1]) > 0)
        if not len(p):
            continue
        pos = (m[p] & U64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(pos)) + 1
        head, tail = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
        where = pos[head]
        out.append((where + a, where - p[tail], where - p[head], (h[where] >> U64(16)).astype(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    pos, low, high, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.searchsorted(offs, pos, "right") - 1, pos, low, high, h


def six(h: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def repeated_hashes(table: DataFrame, buckets: int, fan: int = FAN, scratch: list[DataFrame] | None = None) -> DataFrame:
    """ROW of kind 1: for a pack, sorted hashes of anchors that stand in more than one document (of any pack)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, parts in by_pack(batches):
            _, buf, offs = opened(parts)
            doc, _, _, _, h = anchors(buf, offs)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            head = np.flatnonzero(np.diff(h, prepend=-1))
            tail = np.append(head[1:], len(h)) - 1 if len(h) else head
            many = doc[head] != doc[tail]  # in several documents of the pack
            h = h[head]
            part = h % buckets
            order = np.argsort(part, kind="stable")
            h, many, part = h[order], many[order], part[order]
            cuts = np.searchsorted(part, np.arange(buckets + 1))
            filled = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            out = [(name, 1, k, (b - a).item().to_bytes(4, "little") + np.packbits(many[a:b]).tobytes() + six(h[a:b])) for k, a, b in filled]
            yield outgoing(name, out, buckets, fan)

    def meet(got: pa.Table) -> pa.Table:
        names, blobs = got.column("pack").to_pylist(), got.column("blob").to_pylist()
        part = got.column("part")[0].as_py()
        hashes, flags = [], []
        for b in blobs:
            n = int.from_bytes(b[:4], "little")
            bits = -(-n // 8)
            flags.append(np.unpackbits(np.frombuffer(b[4 : 4 + bits], np.uint8), count=n).astype(bool))
            hashes.append(unsix(b[4 + bits :]))
        every, many = np.concatenate(hashes), np.concatenate(flags)
        values, where, count = np.unique(every, return_inverse=True, return_counts=True)
        often = count > 1
        often |= np.bincount(where, weights=many, minlength=len(values)) > 0
        keep = often[where]
        cuts = np.cumsum([0, *map(len, hashes)])
        return pa.Table.from_batches([rows_of([(name, 1, part, six(every[a:b][keep[a:b]])) for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)])])

    return exchange(table.mapInArrow(send, ROW), meet, ["part"], buckets, fan, scratch)


def first_bytes(key: np.ndarray) -> np.ndarray:
    """The anchor's own GRAM bytes: passages that are compared agree in them, so a cut between them parts no equal passages."""
    return np.ascontiguousarray(key[:, :GRAM]).view(f"S{GRAM}").ravel()


def range_cuts(table: DataFrame, parts: int, packs_read: int = 256, of_each: int = 2048) -> np.ndarray:
    """Sorted GRAM-byte strings that cut the suffixes at anchors into ``parts`` ranges, from a sample; they only balance the parts.

    ``packs_read`` packs give ``of_each`` anchors each, the ones with the least hashes, so what comes to the driver is bounded.
    """
    n = max(1, table.where("part = 1").count())
    some = table.where(F.xxhash64("pack") <= F.lit((1 << 64) * min(n, packs_read) // n - (1 << 63) - 1))  # a bound of 64 bits: never 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_pack(batches):
            _, buf, offs = opened(rows)
            _, pos, _, _, h = anchors(buf, offs)
            pos = pos[np.argsort(h, kind="stable")[:of_each]]
            padded = np.concatenate([buf, np.zeros(LENGTH, np.uint8)])
            head = first_bytes(padded[pos[:, None] + np.arange(GRAM)]) if len(pos) else np.zeros(0, f"S{GRAM}")
            yield pa.RecordBatch.from_arrays([pa.array([head.tobytes()], pa.binary())], names=["head"])

    found = some.mapInArrow(run, "head binary").collect()
    heads = np.sort(np.frombuffer(b"".join(r["head"] for r in found), f"S{GRAM}"))
    return np.unique(heads[len(heads) * np.arange(1, parts) // parts]) if len(heads) else heads


class Suffixes:
    """The suffixes of a pack at its repeated anchors: members, and distinct entries in the order in which they are sent."""

    def __init__(self, ids: np.ndarray, buf: np.ndarray, offs: np.ndarray, repeated: np.ndarray, cuts: np.ndarray):
        doc, pos, low, high, h = anchors(buf, offs)
        at = np.minimum(np.searchsorted(repeated, h), max(0, len(repeated) - 1))
        use = np.flatnonzero(repeated[at] == h) if len(repeated) else np.zeros(0, np.int64)
        self.doc, self.pos, self.low, self.high = doc[use], pos[use], low[use], high[use]
        padded = np.concatenate([np.zeros(SPAN, np.uint8), buf, np.zeros(LENGTH, np.uint8)])
        n = len(use)
        key = np.empty((n, LENGTH + SPAN - 1 + 2), np.uint8)
        for k in range(LENGTH):
            key[:, k] = padded[self.pos + SPAN + k]
        for k in range(1, SPAN):
            key[:, LENGTH + k - 1] = padded[self.pos + SPAN - k]
        key[:, -2], key[:, -1] = self.low, self.high
        flat = np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel()
        order = np.argsort(flat, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = flat[order][1:] != flat[order][:-1]
        entry = np.empty(n, np.int64)
        entry[order] = np.cumsum(fresh) - 1
        heads = np.flatnonzero(fresh)
        least = np.minimum.reduceat(ids[self.doc][order], heads) if n else np.zeros(0, np.int64)
        self.entry = entry  # of each member
        self.key, self.least = key[order[heads]], least
        part = np.searchsorted(cuts, first_bytes(self.key), "right")  # in order, as the entries are
        self.cuts = np.searchsorted(part, np.arange(len(cuts) + 2))


def front_coded(key: np.ndarray, least: np.ndarray) -> bytes:
    """A sorted run: common prefixes with the suffix before, then only the bytes beyond them."""
    right = key[:, :LENGTH]
    prefix = np.zeros(len(key), np.uint8)
    differ = right[1:] != right[:-1]
    prefix[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    beyond = right[np.arange(LENGTH) >= prefix[:, None]]
    return squeeze(len(key).to_bytes(8, "little") + least.astype(np.int64).tobytes() + prefix.tobytes() + key[:, LENGTH:].tobytes() + beyond.tobytes())


def decoded(blob: bytes) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """(suffixes, common prefixes with the one before, what else the key holds, least ids) of a run."""
    data = expand(blob)
    n, rest = int.from_bytes(data[:8], "little"), SPAN - 1 + 2
    least = np.frombuffer(data, np.int64, n, 8)
    prefix = list(data[8 + 8 * n : 8 + 9 * n])
    other = np.frombuffer(data, np.uint8, n * rest, 8 + 9 * n).reshape(n, rest)
    at, suffixes, before = 8 + 9 * n + n * rest, [], b""
    for p in prefix:
        if p < LENGTH:
            end = at + LENGTH - p
            before = before[:p] + data[at:end]
            at = end
        suffixes.append(before)
    return suffixes, prefix, other, least


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """(run, index in it, common prefix with the suffix before) of all suffixes in order, by a loser tree.

    Each head keeps its common prefix with the last output.  Of two heads the one with the longer prefix is the lesser; with
    equal ones the bytes beyond decide, and the loser's prefix becomes the one with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    size = [len(r[0]) for r in runs] + [0] * (k - len(runs))
    head = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (k - len(runs))
    shared = [0 if s else -1 for s in size]  # -1: ended
    from_bytes = int.from_bytes

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser."""
        a, b = shared[x], shared[y]
        if a != b:
            return (x, y) if a > b else (y, x)
        if a < 0 or a == LENGTH:
            return (x, y) if x < y else (y, x)
        p, q = head[x][a:], head[y][a:]
        if p == q:
            x, y = (x, y) if x < y else (y, x)
            shared[y] = LENGTH
            return x, y
        if p > q:
            x, y = y, x
        shared[y] = LENGTH - ((from_bytes(p, "big") ^ from_bytes(q, "big")).bit_length() + 7) // 8
        return x, y

    loser = [0] * k
    round_ = list(range(k))
    base = k
    while len(round_) > 1:
        base //= 2
        following = []
        for i in range(0, len(round_), 2):
            w, lo = play(round_[i], round_[i + 1])
            loser[base + i // 2] = lo
            following.append(w)
        round_ = following
    winner = round_[0]
    out_run, out_at, out_shared = [], [], []
    total = sum(size)
    while len(out_run) < total:
        suffixes, prefixes = runs[winner]
        i, n = at[winner], size[winner]
        out_run.append(winner)
        out_at.append(i)
        out_shared.append(shared[winner])
        i += 1
        while i < n and prefixes[i] == LENGTH:  # equal to the last output
            out_run.append(winner)
            out_at.append(i)
            out_shared.append(LENGTH)
            i += 1
        at[winner] = i
        if i < n:
            head[winner], shared[winner] = suffixes[i], prefixes[i]
        else:
            shared[winner] = -1
        node = (winner + k) >> 1
        x = winner
        while node:
            y = loser[node]
            a, b = shared[x], shared[y]
            if a > b:
                pass
            elif a < b:
                loser[node], x = x, y
            else:
                w, lo = play(x, y)
                loser[node], x = lo, w
            node >>= 1
        winner = x
    return out_run, out_at, out_shared


def earlier_bits(shared: np.ndarray, other: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For sorted suffixes, bits by offset: the passage with the anchor at that offset stands in a document before ``least``."""
    n = len(least)
    bits = np.zeros(n, np.uint32)
    low, high = other[:, -2], other[:, -1]
    left = np.zeros(n, U64)
    for o in range(SPAN):
        if o:
            left = mix(left + other[:, o - 1].astype(U64) + U64(o))
        use = np.flatnonzero((low <= o) & (o <= high))
        if not len(use):
            continue
        right = np.cumsum(shared < LENGTH - o).astype(U64)
        key = mix(left[use] + mix(right[use] + U64(1 << 40)))
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        first = np.minimum.reduceat(least[use][order], heads)
        known = np.repeat(first, np.diff(np.append(heads, len(use))))
        hit = use[order][known < least[use][order]]
        bits[hit] |= np.uint32(1 << o)
    return bits


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, text_md5 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int | None = None, fan: int = FAN) -> DataFrame:
    """RESULT: the removed byte spans (start, end, start, end ...) and the kept bytes of each document.

    Null texts count as empty; documents shorter than a passage lose nothing; rows without an id count as coming after all
    others; rows with equal ids don't take from each other.  An empty table gives no rows.  ``parts`` is the number of hash
    buckets and of merges (where it isn't given: one for each four packs of 4 MB, and four for each shuffle partition at least,
    so that parts don't grow).  ``fan``: the most rows that a pack sends at once; beyond that many parts they are reached in two steps.
    """
    table = written(packs(docs, id_col, text), "packs")
    parts = parts or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.where("part = 1").count() // 4)
    ranges = range_cuts(table, parts)
    between: list[DataFrame] = []
    repeated = written(repeated_hashes(table, parts, fan, between), "repeated")

    def gathered(got: pa.Table) -> tuple[str, dict, np.ndarray]:
        name, rows = received(got)
        found = [unsix(b) for (k, _), b in rows.items() if k == 1]
        return name, rows, np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def send(got: pa.Table) -> pa.Table:
        name, rows, hashes = gathered(got)
        s = Suffixes(*opened(rows), hashes, ranges)
        out = [(name, 2, k, front_coded(s.key[a:b], s.least[a:b])) for k, (a, b) in enumerate(zip(s.cuts[:-1], s.cuts[1:], strict=True)) if b > a]
        return pa.Table.from_batches([outgoing(name, out, parts, fan)])

    def merge(got: pa.Table) -> pa.Table:
        names, part = got.column("pack").to_pylist(), got.column("part")[0].as_py()
        runs = [decoded(b) for b in got.column("blob").to_pylist()]
        run, at, shared = merged([r[:2] for r in runs])
        base = np.cumsum([0, *(len(r[0]) for r in runs)])
        order = base[np.array(run, np.int64)] + np.array(at, np.int64)
        other, least = np.concatenate([r[2] for r in runs]), np.concatenate([r[3] for r in runs])
        bits = np.zeros(len(order), np.uint32)
        bits[order] = earlier_bits(np.array(shared), other[order], least[order])
        return pa.Table.from_batches([rows_of([(n, 3, part, squeeze(bits[a:b].tobytes())) for n, a, b in zip(names, base[:-1], base[1:], strict=True)])])

    together = table.unionByName(repeated)
    bits = written(exchange(together.groupBy("pack").applyInArrow(send, ROW), merge, ["part"], parts, fan, between), "bits")
    deleted(*between)

    def cut(got: pa.Table) -> pa.Table:
        _, rows, hashes = gathered(got)
        ids, buf, offs = opened(rows)
        s = Suffixes(ids, buf, offs, hashes, ranges)
        bits = np.zeros(len(s.least), np.uint32)
        for k, (a, b) in enumerate(zip(s.cuts[:-1], s.cuts[1:], strict=True)):
            if b > a:
                bits[a:b] = np.frombuffer(expand(rows[3, k]), np.uint32)
        o = np.arange(SPAN)
        change = np.zeros(len(buf) + 1, np.int64)
        for a in range(0, len(s.doc), 1 << 18):
            m = slice(a, a + (1 << 18))
            hit = (bits[s.entry[m], None] >> o.astype(np.uint32) & 1).astype(bool) | (ids[s.doc[m]] > s.least[s.entry[m]])[:, None]
            x, y = np.nonzero(hit & (o >= s.low[m, None]) & (o <= s.high[m, None]))
            start = s.pos[m][x] - y
            change += np.bincount(start, minlength=len(change)) - np.bincount(start + LENGTH, minlength=len(change))
        gone = np.cumsum(change[:-1]) > 0
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        before[offs[:-1][offs[:-1] < len(buf)]] = False
        after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
        after[(offs[1:] - 1)[offs[1:] > 0]] = False
        starts, ends = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        first = np.searchsorted(starts, offs)
        lost = np.concatenate([[0], np.cumsum(gone)])[offs]
        kept, kept_at = buf[~gone].tobytes(), offs - lost
        raw = buf.tobytes()
        spans = [np.stack([starts[a:b], ends[a:b]], 1).ravel() - x for a, b, x in zip(first[:-1], first[1:], offs[:-1], strict=True)]
        return pa.table(
            {
                "doc_id": pa.array([None if i == LAST else i for i in ids.tolist()], pa.int64()),
                "n_bytes": pa.array(np.diff(offs)),
                "n_removed": pa.array(np.diff(lost)),
                "n_spans": pa.array(np.diff(first)),
                "spans": pa.array(spans, pa.list_(pa.int64())),
                "kept": pa.array([kept[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)], pa.binary()),
                "text_md5": pa.array([hashlib.md5(raw[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]),
            }
        )

    return together.unionByName(bits).groupBy("pack").applyInArrow(cut, RESULT)
