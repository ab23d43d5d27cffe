"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed word five-grams.  Documents with equal sets form one node with a count of copies.  Nodes that
agree in a band of MinHash values are candidates.  Their MinHash values are compared 16 at a time; with a uniform prior, the
posterior probability of reaching the threshold after m of n matches is P(Bin(n + 1, t) <= m), and a pair is dropped once
that falls below ``tolerance``.  What is left is verified on the exact sets.

No pair is ever written.  Buckets and groups above BLOCK nodes are cut into blocks whose combinations are separate tasks; a
task returns a spanning forest of what it links, and for each node the number of documents it is linked to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._tables import written
from ._text import U64, chunks, mix, owners, rolled, span_hash, words

BANDS, ROWS = 21, 3
HASHES = 64
STEP = 16
BLOCK = 512
_MUL = mix(np.arange(1, HASHES + 1).astype(U64)) | U64(1)
_ADD = mix(np.arange(1001, 1001 + HASHES).astype(U64))


def shingles(buf: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each row, and row offsets.  A row of fewer than n words is one shingle of them all."""
    starts, ends, first = words(buf, offs)
    h = span_hash(buf, starts, ends)
    row = owners(first)
    count = np.diff(first)
    n_rows = len(offs) - 1
    rolling = rolled(h, n)
    inside = row[: len(rolling)] == row[n - 1 :] if len(rolling) else np.zeros(0, bool)
    key, at = [rolling[inside]], [row[: len(rolling)][inside]]
    for r in np.flatnonzero((count > 0) & (count < n)):
        key.append(rolled(h[first[r] : first[r + 1]], int(count[r])))
        at.append(np.array([r]))
    key, at = np.concatenate(key), np.concatenate(at)
    order = np.lexsort((key, at))
    key, at = key[order], at[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    return key[fresh], np.searchsorted(at[fresh], np.arange(n_rows + 1))


def set_keys(key: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each row's set, and whether the row has any."""
    total = np.zeros(len(key) + 1, U64)
    np.cumsum(mix(key ^ U64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    size = np.diff(offs)
    return mix(total[offs[1:]] - total[offs[:-1]] + size.astype(U64)).view(np.int64), size


def minhashes(key: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, HASHES) of 32-bit MinHash values; all ones for empty rows."""
    out = np.full((len(offs) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        heads = offs[full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(((key * _MUL[k] + _ADD[k]) >> U64(32)).astype(np.uint32), heads)
    return out


SIGNED = "doc_id long, text_md5 string, node long, n_shingles long, sig binary"


def signed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """SIGNED rows of the documents that have an id."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text).cast("string")).alias("text_md5"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in chunks(batch.column("text")):
                key, at = shingles(buf, offs)
                node, size = set_keys(key, at)
                sig = minhashes(key, at).tobytes()
                w = 4 * HASHES
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("text_md5")[i:j], pa.array(node), pa.array(size), pa.array([sig[k * w : k * w + w] for k in range(j - i)], pa.binary())], names=["doc_id", "text_md5", "node", "n_shingles", "sig"])

    return source.mapInArrow(run, SIGNED)


def banded(nodes: DataFrame) -> DataFrame:
    """(band, node): a row for each band of each node with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U64)
                key = np.broadcast_to(np.arange(BANDS).astype(U64), sig.shape[:2])
                for r in range(ROWS):
                    key = mix(key * U64(0x100000001B3) + sig[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], names=["band", "node"])

    return nodes.where("n_shingles > 0").select("node", "sig").mapInArrow(run, "band long, node long")


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step, the fewest matches with a posterior above ``tolerance``."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray | None, least: list[int], rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a, and of b, or i < j within a if b is None) that are still likely after all steps, in pieces."""
    other = a if b is None else b
    for at in range(0, len(a), rows):
        i, j = np.divmod(np.arange(min(rows, len(a) - at) * len(other)), len(other))
        i += at
        if b is None:
            i, j = i[i < j], j[i < j]
        matches = np.zeros(len(i), np.int64)
        for k, m in enumerate(least):
            part = slice(k * STEP, (k + 1) * STEP)
            matches += (a[i, part] == other[j, part]).sum(1)
            keep = matches >= m
            if not keep.all():
                i, j, matches = i[keep], j[keep], matches[keep]
        if len(i):
            yield i, j


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join the same of n items as ``pairs`` do."""
    root = np.arange(n)
    out = []
    for i, j in pairs:
        while True:
            for _ in range(64):
                up = root[root]
                if (up == root).all():
                    break
                root = up
            apart = np.flatnonzero(root[i] != root[j])
            if not len(apart):
                break
            _, one = np.unique(np.maximum(root[i[apart]], root[j[apart]]), return_index=True)
            for k in apart[one].tolist():
                x, y = int(root[i[k]]), int(root[j[k]])
                root[max(x, y)] = min(x, y)
                out.append((int(i[k]), int(j[k])))
    return out


def dealt(members: DataFrame, group: str, size: Column, weight: Column | None = None) -> DataFrame:
    """``members`` with the task's name (u1, u2, u3) and the row's block: small groups go together, about 4000 rows or 64 MB by
    ``weight``, large ones as pairs of blocks, so a node of a group of g nodes is sent g / BLOCK times."""
    blocks = F.ceil(size / BLOCK).cast("int")
    row = members.agg(F.count("*").alias("n"), (F.lit(0) if weight is None else F.coalesce(F.sum(weight), F.lit(0))).alias("bytes")).head()
    total = max(1, row["n"] // 4000, row["bytes"] >> 26)
    own = F.when(blocks <= 1, 0).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), blocks)).cast("int")
    other = F.explode(F.when(blocks <= 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    rows = members.withColumn("block", own).withColumn("other", other)
    small = F.col("other") < 0
    return rows.withColumns({"u1": F.when(small, F.pmod(F.xxhash64(group), F.lit(total))).otherwise(F.col(group)), "u2": F.when(small, -1).otherwise(F.least("block", "other")), "u3": F.when(small, -1).otherwise(F.greatest("block", "other"))}).drop("other")


def groups(table: pa.Table, group: str) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows of each group of a task: (rows, None) for pairs within them, or (rows of one block, rows of the other)."""
    cross = len(table) and table.column("u2")[0].as_py() != table.column("u3")[0].as_py()
    if cross:
        block = table.column("block").to_numpy()
        low = block == table.column("u2")[0].as_py()
        yield np.flatnonzero(low), np.flatnonzero(~low)
        return
    key = table.column(group).to_numpy()
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows) > 1:
            yield rows, None


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of at least the threshold."""
    size = np.array([len(s) for s in sets])
    if len(i) < 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        every, where = np.unique(np.concatenate(sets), return_inverse=True)
        of = np.repeat(np.arange(len(sets)), size)
        shared = np.bincount(where) > 1
        keep = shared[where]
        col, of = (np.cumsum(shared) - 1)[where[keep]], of[keep]
        common_all = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(shared.sum()), 8192):
            part = (col >= at) & (col < at + 8192)
            hit = np.zeros((len(sets), 8192), np.float32)
            hit[of[part], col[part] - at] = 1
            common_all += hit @ hit.T
        common = common_all[i, j].astype(np.int64)
    return common >= threshold * (size[i] + size[j] - common) - 1e-9


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, text_md5, class_key): one row a document.  ``text_md5`` tells texts of one id apart, and
    ``class_key`` classes of one least id.

    Documents are linked if the Jaccard similarity of their shingle sets reaches the threshold; classes are what links
    connect, named by their least id; n_links counts the other documents a document is linked to.  Null, empty and blank texts
    have equal (empty) sets and so form one class.  Rows without an id are returned with null class and 0 links.  Repeated rows
    count as documents.  An empty table gives no rows.
    """
    least = least_matches(threshold, tolerance)
    rows = written(signed(docs, id_col, text), "signed")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "nodes")

    bands = written(banded(nodes), "bands")
    buckets = bands.groupBy("band").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("name")).where("size > 1")
    buckets = buckets.groupBy("name", "size").agg(F.min("band").alias("band")).drop("name")  # a bucket that repeats in other bands is looked at once
    members = written(bands.join(buckets, "band").join(nodes.select("node", "sig"), "node"), "candidates")

    def prune(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        node = table.column("node").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        for x, y in groups(table, "band"):
            at = x if y is None else np.concatenate([x, y])
            found = surviving(sig[x], None if y is None else sig[y], least)
            out += [(int(node[at[p]]), int(node[at[q]])) for p, q in forest(len(at), ((i, j if y is None else j + len(x)) for i, j in found))]
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    likely = dealt(members, "band", F.col("size")).groupBy("u1", "u2", "u3").applyInArrow(prune, "a long, b long")
    placed = components(likely)
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    placed = placed.join(sizes, "component").join(nodes.select("node", "doc_id", "copies"), "node")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    both = placed.join(texts, "doc_id").select("node", "component", "size", "copies", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in chunks(batch.column("text")):
                key, at = shingles(buf, offs)
                node, _ = set_keys(key, at)
                sig, raw, w = minhashes(key, at).tobytes(), key.tobytes(), 4 * HASHES
                same = pa.array(node == batch.column("node")[i:j].to_numpy())  # a repeated id may have another text
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[i:j] for k in ("node", "component", "size", "copies")), pa.array([sig[k * w : k * w + w] for k in range(j - i)], pa.binary()), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["node", "component", "size", "copies", "sig", "shingles"]).filter(same)

    with_sets = written(both.mapInArrow(sets, "node long, component long, size long, copies long, sig binary, shingles binary").dropDuplicates(["node"]), "sets")

    def verify(table: pa.Table) -> pa.Table:
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        links = np.zeros(len(table), np.int64)
        out: list[tuple[int, int]] = []
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        full = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        for x, y in groups(table, "component"):
            at = x if y is None else np.concatenate([x, y])
            mine = [full[k] for k in at]

            def good(x: np.ndarray = x, y: np.ndarray | None = y, at: np.ndarray = at, mine: list = mine) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j in surviving(sig[x], None if y is None else sig[y], least):
                    j = j if y is None else j + len(x)
                    ok = verified(mine, i, j, threshold)
                    i, j = i[ok], j[ok]
                    np.add.at(links, at[i], copies[at[j]])
                    np.add.at(links, at[j], copies[at[i]])
                    yield i, j

            out += [(int(node[at[p]]), int(node[at[q]])) for p, q in forest(len(at), good())]
        some = np.flatnonzero(links)
        a = np.concatenate([node[some], np.array([p for p, _ in out], np.int64)])
        b = pa.array([None] * len(some) + [q for _, q in out], pa.int64())
        return pa.table({"a": pa.array(a), "b": b, "links": pa.array(np.concatenate([links[some], np.zeros(len(out), np.int64)]))})

    found = written(dealt(with_sets, "component", F.col("size"), F.octet_length("shingles")).groupBy("u1", "u2", "u3").applyInArrow(verify, "a long, b long, links long"), "verified")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    final = components(found.where("b IS NOT NULL"))
    named = final.join(nodes.select("node", "doc_id"), "node")
    heads = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    linked = named.select("node", "component").join(heads, "component")
    result = nodes.select("node", "doc_id", "copies").join(linked, "node", "left").join(counts, "node", "left")
    result = result.select("node", F.coalesce("component", "node").alias("class_key"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    answer = rows.select("doc_id", "node", "text_md5").join(result, "node").select("doc_id", "class_id", "n_links", "text_md5", "class_key")
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.md5(F.col(text).cast("string")).alias("text_md5"), F.lit(None).cast("long").alias("class_key"))
    return answer.unionByName(nameless)
