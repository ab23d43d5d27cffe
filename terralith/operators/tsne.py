"""Two-dimensional t-SNE of a feature table."""

from __future__ import annotations

import json
import secrets
import socket
from collections.abc import Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm._tables import written
from terralith.operators.stats import covariance, standardized


def distances(x: np.ndarray, part: slice) -> np.ndarray:
    """Squared distances of the rows of a part to all rows; of a row to itself: infinite."""
    a, lengths = x[part], (x * x).sum(1)
    d = np.maximum(lengths[part][:, None] + lengths - 2 * a @ x.T, 0)
    d[np.arange(len(a)), part.start + np.arange(len(a))] = np.inf
    return d


def bandwidths(x: np.ndarray, part: slice, perplexity: float) -> np.ndarray:
    """Three rows: factor, least distance and sum of weights of each row of a part, by bisection to the wanted perplexity."""
    d = distances(x, part)
    n = len(d)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    least = d.min(1, keepdims=True)
    finite = np.where(np.isfinite(d), d, 0) - least
    for k in range(65):
        p = np.exp(-(d - least) * beta[:, None])
        total = p.sum(1)
        if k == 64:
            break
        wide = np.log(total) + beta * np.where(p > 0, finite * p, 0).sum(1) / total > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return np.stack([beta, least[:, 0], total])


def affinities(x: np.ndarray, part: slice, widths: np.ndarray) -> np.ndarray:
    """Symmetric joint probabilities of the rows of a part with all rows."""
    d = distances(x, part)
    beta, least, total = widths
    ours = np.exp(-(d - least[part][:, None]) * beta[part][:, None]) / total[part][:, None]
    return np.maximum((ours + np.exp(-(d - least) * beta) / total) / (2 * len(x)), 1e-12)


def embed(x: np.ndarray, perplexity: float, iterations: int = 1000, seed: int = 42, step: int = 256) -> tuple[np.ndarray, float]:
    """(places, divergence): starts from the first two components, with early exaggeration and momentum.

    Every step sums the forces of all pairs, ``step`` rows at a time; memory grows with the rows, time with their square.
    """
    n = len(x)
    if n < 3:
        return np.zeros((n, 2)), 0.0
    parts = [slice(k, min(k + step, n)) for k in range(0, n, step)]
    widths = np.concatenate([bandwidths(x, s, perplexity) for s in parts], axis=1)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = np.zeros((n, 2))
    k = min(2, u.shape[1])
    y[:, :k] = u[:, :k] * s[:k]
    y = 1e-4 * y / max(1e-12, y[:, 0].std()) + 1e-6 * np.random.default_rng(seed).standard_normal((n, 2))
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50)
    near = lambda s: 1 / (1 + distances(y, s))
    for i in range(iterations):
        total = sum(near(s).sum() for s in parts)
        grad = np.empty_like(y)
        for s in parts:
            q = near(s)
            w = ((12 if i < 250 else 1) * affinities(x, s, widths) - np.maximum(q / total, 1e-12)) * q
            grad[s] = 4 * (w.sum(1)[:, None] * y[s] - w @ y)
        gain = np.maximum(np.where(np.sign(grad) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if i < 250 else 0.8) * speed - rate * gain * grad
        y = y + speed
    total, lost = sum(near(s).sum() for s in parts), 0.0
    for s in parts:
        p = affinities(x, s, widths)
        lost += float((p * np.log(p / np.maximum(near(s) / total, 1e-12))).sum())
    return y - y.mean(0), lost


NEAR = 3  # neighbours whose affinities count, in perplexities: the Barnes-Hut method's number
NODE = 1 / 3  # greatest distance of grid nodes; the kernel's width is 1
LEAST = 64  # grid nodes across the places, at least
PAIR = 4  # pairs of places that cost what a cell of the grid does
SHARED = 1 << 20  # cells from which on it is quicker for tasks to share a grid than for each to make all of it
BLOCKS, ROWS = 64, 512  # blocks of objects, about, and rows of a block at least
SPLITS = 8  # components by which objects are put in order


def z_order(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, step: float) -> np.ndarray:
    """Numbers under which rows that lie close together have close values: bits of their first components in turn."""
    level = np.clip(np.nan_to_num((x - mean) @ axes / step) + 32, 0, 63).astype(np.int64)
    d = level.shape[1]
    return sum(((level[:, c] >> bit) & 1) << (bit * d + d - 1 - c) for bit in range(6) for c in range(d))


def nearest(x: np.ndarray, others: list[tuple[int, np.ndarray]], start: int, k: int, step: int = 256, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and numbers of the k nearest others of each row; ``x`` stands at ``start``, each of ``others`` at its number.

    Exact: the nearest tiles tell how far the others may be at most; of all other tiles whose box is not farther, single precision
    and a margin for its error tell which rows to look at.  Rows that lie close together should stand together.
    """
    tiles = [(at + t, z[t : t + tile]) for at, z in others for t in range(0, len(z), tile)]
    z, number = np.concatenate([t for _, t in tiles]), np.concatenate([at + np.arange(len(t)) for at, t in tiles])
    edge = np.cumsum([0, *(len(t) for _, t in tiles)])
    low, high, middle = (np.array([f(t) for _, t in tiles]) for f in (lambda t: t.min(0), lambda t: t.max(0), lambda t: t.mean(0)))
    centre = z.mean(0)
    c = z - centre
    length = (c * c).sum(1)
    most = np.maximum.reduceat(length, edge[:-1])
    flat = np.concatenate([-2 * c, length[:, None], np.ones((len(z), 1))], 1).astype(np.float32)
    far, who = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
    for a in range(0, len(x), step):
        mine = x[a : a + step]
        rows, q = np.arange(len(mine)), mine - centre
        size = (q * q).sum(1)
        asked = np.concatenate([q, np.ones((len(q), 1)), size[:, None]], 1).astype(np.float32)
        gap = (np.maximum(0, np.maximum(low - mine.max(0), mine.min(0) - high)) ** 2).sum(1)
        order = np.argsort(((middle - mine.mean(0)) ** 2).sum(1), kind="stable")
        n = 1 + int(np.searchsorted(np.cumsum(np.diff(edge)[order]), k + 1))
        at = np.concatenate([np.arange(edge[t], edge[t + 1]) for t in order[:n]])
        d = np.nan_to_num(size[:, None] + length[at] - 2 * q @ c[at].T, nan=np.inf)
        d[number[at] == (start + a + rows)[:, None]] = np.inf
        pick = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        best = np.where(np.isfinite(np.take_along_axis(d, pick, 1)), ((mine[:, None] - z[at[pick]]) ** 2).sum(-1), np.inf)
        found = number[at[pick]]
        if best.shape[1] < k:
            best, found = (np.pad(v, ((0, 0), (0, k - v.shape[1])), constant_values=w) for v, w in ((best, np.inf), (found, -1)))
        for g in range(n, len(order), 16):
            limit = best.max(1)
            some = order[g : g + 16]
            hits = []
            for t in some[gap[some] < limit.max()].tolist():
                margin = 1e-6 * (x.shape[1] + 4) * (most[t] + size.max())
                hit = np.flatnonzero(asked @ flat[edge[t] : edge[t + 1]].T < (limit + margin).astype(np.float32)[:, None])
                r, j = np.divmod(hit, edge[t + 1] - edge[t])
                hits.append((r, j + edge[t]))
            if not hits:
                continue
            r, j = (np.concatenate(v) for v in zip(*hits, strict=True))
            d = ((mine[r] - z[j]) ** 2).sum(1)
            real = (d < limit[r]) & (number[j] != start + a + r)
            r, j, d = r[real], j[real], d[real]
            if not len(r):
                continue
            by = np.argsort(r.astype(np.int16), kind="stable")
            r, j, d = r[by], j[by], d[by]
            count = np.bincount(r, minlength=len(mine))
            place = k + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            all_d, all_j = np.full((len(mine), k + count.max()), np.inf), np.full((len(mine), k + count.max()), -1)
            all_d[:, :k], all_j[:, :k], all_d[r, place], all_j[r, place] = best, found, d, number[j]
            pick = np.argpartition(all_d, k - 1, axis=1)[:, :k]
            best, found = np.take_along_axis(all_d, pick, 1), np.take_along_axis(all_j, pick, 1)
        far[a : a + step], who[a : a + step] = best, found
    return far, who


def conditional(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Probabilities of the neighbours of each row from their squared distances, by bisection to the wanted perplexity."""
    d = d - d.min(1, keepdims=True)
    n = len(d)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(64):
        p = np.exp(-d * beta[:, None])
        total = p.sum(1)
        wide = np.log(total) + beta * (d * p).sum(1) / total > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.exp(-d * beta[:, None])
    return p / p.sum(1, keepdims=True)


def even(n: int) -> int:
    """A length of at least n that is quick to transform."""
    return min(a * 2 ** max(1, (-(-n // a) - 1).bit_length()) for a in (1, 3, 5, 9, 15))


class Repulsion:
    """Sums of 1 / (1 + d^2) over all places, and their slopes, by cubic splines on a grid and one convolution.

    Work and memory grow with the places and the area that they cover; few places far apart are summed pair by pair, so the
    area is bounded by their number.  No place is left out.  With ``peers`` each task puts its own places on the grid and
    transforms its share of the lines and columns, unless the grid is small; only the finished field is in all tasks.
    """

    def __init__(self, peers: Peers | None = None) -> None:
        self.peers = peers
        self.known: tuple = ()
        self.kernel = np.zeros(0)

    def __call__(self, y: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, float]:
        """(sums of q^2 (y_i - y_j) for the rows of ``part``, sum of q over all pairs).  The peers' parts are all places."""
        low, wide = y.min(0), np.maximum(np.ptp(y, axis=0), 1e-12)
        h = min(NODE, float(wide.max()) / LEAST)
        n = (wide / h).astype(int) + 5
        size = even(2 * int(n[0])), even(2 * int(n[1]))
        if len(y) ** 2 <= PAIR * size[0] * size[1]:
            return by_pairs(y, part)
        swap, rank, tasks = lambda parts: parts, 0, 1
        if self.peers and size[0] * size[1] + 2 * len(y) > SHARED:
            swap, rank, tasks = self.peers.swap, self.peers.rank, len(self.peers.peers) + 1
        single = h == NODE  # closer nodes, for places that are nearly one, need all digits
        if self.known != (h, size):
            a, b = (h * np.minimum(np.arange(m), m - np.arange(m)) for m in size)
            sharp = [((2 + np.cos(2 * np.pi * np.arange(m) / m)) / 3) ** 2 for m in size]
            kernel = np.fft.rfft2(1 / (1 + a[:, None] ** 2 + b[None, :] ** 2)) / (sharp[0][:, None] * sharp[1][None, : size[1] // 2 + 1])
            self.kernel = kernel.T.astype(np.complex64 if single else complex)
            self.known = h, size
        real, whole = (np.float32, np.complex64) if single else (float, complex)
        lines, columns = ([m * k // tasks for k in range(tasks + 1)] for m in (int(n[0]), size[1] // 2 + 1))
        pieces = lambda x, ends: [np.ascontiguousarray(x[:, a:b].T).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        first, last = columns[rank], columns[rank + 1]

        def splines(rows: np.ndarray | slice, axis: int, slope: bool) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
            """The first node of each place, weights of its four nodes, and their slopes."""
            u = (y[rows, axis] - low[axis]) / h + 1
            node = np.minimum(u.astype(int), n[axis] - 3)
            t = u - node
            r = 1 - t
            w = [r * r * r / 6, (3 * t - 6) * t * t / 6 + 2 / 3, ((-3 * t + 3) * t + 3) * t / 6 + 1 / 6, t * t * t / 6]
            s = [-r * r / (2 * h), (3 * t - 4) * t / (2 * h), ((-3 * t + 2) * t + 1) / (2 * h), t * t / (2 * h)] if slope else w
            return node - 1, w, s

        mine = part if tasks > 1 else slice(None)
        (i, v, _), (j, w, _) = splines(mine, 0, False), splines(mine, 1, False)
        at, nodes = i * n[1] + j, int(n[0] * n[1])
        mass = np.bincount(np.concatenate([at + (a * n[1] + b) for a in range(4) for b in range(4)]), weights=np.concatenate([v[a] * w[b] for a in range(4) for b in range(4)]), minlength=nodes)
        mass = mass.astype(real).reshape(n)
        parts = swap([mass[a:b].tobytes() for a, b in zip(lines[:-1], lines[1:], strict=True)])
        count = lines[rank + 1] - lines[rank]
        mass = sum(np.frombuffer(x, real).astype(float) for x in parts).reshape(count, n[1]).astype(real)  # all places, own lines
        wave = swap(pieces(np.fft.rfft(mass, size[1], axis=1), columns))
        wave = np.concatenate([np.frombuffer(x, whole).reshape(last - first, m) for x, m in zip(wave, np.diff(lines), strict=True)], 1)  # all lines, own columns
        wave = np.fft.fft(wave, size[0], axis=1) * self.kernel[first:last]
        wave = swap(pieces(np.fft.ifft(wave, axis=1), lines))
        wave = np.concatenate([np.frombuffer(x, whole).reshape(count, m) for x, m in zip(wave, np.diff(columns), strict=True)], 1)
        field = np.ascontiguousarray(np.fft.irfft(wave, size[1], axis=1)[:, : n[1]])
        own = float(np.vdot(mass.astype(float), field.astype(float)))
        parts = swap([np.float64(own).tobytes() + field.tobytes()] * tasks)
        total = sum(float(np.frombuffer(x, float, 1)[0]) for x in parts) - len(y)
        field = np.concatenate([np.frombuffer(x[8:], real) for x in parts])
        (i, v, x), (j, w, z) = splines(part, 0, True), splines(part, 1, True)
        at = i * n[1] + j
        slope = np.zeros((len(at), 2))
        for a in range(4):
            for b in range(4):
                near = field[at + (a * n[1] + b)]
                slope[:, 0] += x[a] * w[b] * near
                slope[:, 1] += v[a] * z[b] * near
        return -slope / 2, total


def by_pairs(y: np.ndarray, part: np.ndarray, step: int = 256) -> tuple[np.ndarray, float]:
    """What ``Repulsion`` gives, from all pairs."""
    sums, total = np.zeros((len(y), 2)), 0.0
    for a in range(0, len(y), step):
        apart = y[a : a + step, None] - y
        q = 1 / (1 + (apart * apart).sum(-1))
        total += float(q.sum())
        sums[a : a + step] = np.einsum("ij,ijc->ic", q * q, apart)
    return sums[part], total - len(y)


class Attraction:
    """Forces of neighbours on a task's objects: ``counts`` of them for each, at numbers ``j`` and of affinity ``p``."""

    def __init__(self, own: np.ndarray, counts: np.ndarray, j: np.ndarray, p: np.ndarray, step: int = 1 << 15) -> None:
        self.own, self.counts, self.j, self.p = own, counts, j, p
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        self.cuts = np.unique(np.append(np.searchsorted(self.ends, np.arange(0, self.ends[-1], step)), len(counts)))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of p q (y_i - y_j) over the neighbours of each object, from all places; some objects at a time."""
        out = np.zeros((len(self.own), 2))
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            first, last = self.ends[a], self.ends[b]
            j, counts, heads = self.j[first:last], self.counts[a:b], self.ends[a:b] - first
            dx = np.repeat(x[self.own[a:b]], counts) - x[j]
            dy = np.repeat(y[self.own[a:b]], counts) - y[j]
            w = self.p[first:last] / (1 + dx * dx + dy * dy)
            out[a:b, 0], out[a:b, 1] = np.add.reduceat(w * dx, heads), np.add.reduceat(w * dy, heads)
        return out


class Peers:
    """Connections between the tasks of a barrier stage; Spark's own ``allGather``, which takes a second a call, gives the addresses."""

    def __init__(self, context: BarrierTaskContext, key: bytes) -> None:
        self.rank, hosts = context.partitionId(), [t.address.rsplit(":", 1)[0] for t in context.getTaskInfos()]
        self.peers: dict[int, Connection] = {}
        with Listener((hosts[self.rank], 0), backlog=len(hosts), authkey=key) as door:
            ports = [int(x) for x in context.allGather(str(door.address[1]))]
            for k in range(self.rank):  # a task waits for lower ones alone, so none waits in a circle
                self.peers[k] = Client((hosts[k], ports[k]), authkey=key)
                self.peers[k].send(self.rank)
            for _ in range(len(hosts) - 1 - self.rank):
                one = door.accept()
                self.peers[one.recv()] = one
        for one in self.peers.values():  # a long message goes out as a head and a body: without this the body waits 40 ms for an answer
            with socket.fromfd(one.fileno(), socket.AF_INET, socket.SOCK_STREAM) as known:
                known.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def gather(self, own: bytes) -> list[bytes]:
        """What each task has given, in their order."""
        return self.swap([own] * (len(self.peers) + 1))

    def swap(self, parts: list[bytes]) -> list[bytes]:
        """What each task has for this one, in their order: tasks meet two by two, and the lower one sends first."""
        n = len(parts)
        out = list(parts)
        for turn in range(n):
            k = (turn - self.rank) % n
            if k > self.rank:
                self.peers[k].send_bytes(parts[k])
                out[k] = self.peers[k].recv_bytes()
            elif k < self.rank:
                out[k] = self.peers[k].recv_bytes()
                self.peers[k].send_bytes(parts[k])
        return out


def slots(spark: SparkSession) -> int:
    """Tasks that run at a time, by the executors that are there."""
    sc = spark.sparkContext
    most = sc.defaultParallelism
    if not sc.master.startswith("local[") and (cores := sc.getConf().get("spark.executor.cores", None)):
        most = min(most, max(1, len(sc._jsc.sc().statusTracker().getExecutorInfos()) - 1) * int(cores))
    return max(1, most)


def tsne(features: DataFrame, columns: list[str], key: str = "objeto_id", iterations: int = 1000, seed: int = 42, tasks: int | None = None) -> DataFrame:
    """(key, x, y) of all objects, by nearest neighbours as in the Barnes-Hut method.

    Objects are put in the order of their first components, so that blocks lie close together.  Affinities are those of each
    object's ``NEAR`` times perplexity nearest others, which blocks find exactly in tasks of their own (``nearest``: the one step
    whose work may grow with the pairs).  ``tasks`` tasks, all the slots of the cluster by default, then move
    their objects together (barrier mode): a step needs the objects' neighbours and ``Repulsion``, so its work grows with the
    objects.  Tasks send each other the places, 8 bytes an object.  ``embed`` is the same with the affinities of all pairs.
    """
    spark = features.sparkSession
    width = len(columns)
    scaled = standardized(features, columns).select(F.col(key).cast("long").alias("key"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    mean, cov, _ = covariance(scaled.select(*(F.get("x", F.lit(c)).alias(f"c{c}") for c in range(width))), [f"c{c}" for c in range(width)])
    mean, (values, axes) = np.asarray(mean, float), np.linalg.eigh(np.nan_to_num(np.asarray(cov, float)))
    axes, step = axes[:, ::-1], max(1e-12, np.sqrt(max(0, values[-1]))) / 8
    split = axes[:, : min(SPLITS, max(1, int((values > 1e-9 * max(1e-300, values[-1])).sum())))]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield batch.append_column("code", pa.array(z_order(x, mean, split, step), pa.int64()))

    coded = scaled.mapInArrow(order, "key long, x array<double>, code long")
    rows = written(coded.orderBy("code", "key", "x").select("key", "x").withColumn("at", F.monotonically_increasing_id()), "objects")
    part = F.shiftright("at", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    n = sum(c for _, c in counts)
    if n < 3:
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    starts = np.zeros(counts[-1][0] + 1, np.int64)
    starts[[p for p, _ in counts]] = np.cumsum([0, *(c for _, c in counts)])[:-1]
    number = F.get(F.lit(starts.tolist()), part) + F.col("at").bitwiseAND((1 << 33) - 1)
    perplexity = min(30.0, max(2.0, n / 3))
    together = tasks or slots(spark)
    k, size = min(n - 1, int(NEAR * perplexity + 1)), max(ROWS, -(-n // (together * -(-BLOCKS // together))))  # as many blocks for each task
    count = -(-n // size)

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("number").to_numpy())
        x = np.array(table.column("x").to_pylist(), float)[order]
        return pa.table({"block": table.column("block")[:1], "keys": pa.array([table.column("key").to_numpy()[order].tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    numbered = rows.withColumn("number", number)
    blocks = written(numbered.withColumn("block", F.floor(F.col("number") / size).cast("int")).select("block", "number", "key", "x").groupBy("block").applyInArrow(pack, "block int, keys binary, x binary"), "blocks")
    matrix = lambda blob: np.frombuffer(blob).reshape(-1, width)
    target = "block int, i binary, j binary, p binary"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = {}, None
        for batch in batches:
            for own, b, blob in zip(*(batch.column(c).to_pylist() for c in ("asked", "block", "x")), strict=True):
                x[b] = matrix(blob)
        if not x:
            return
        d, j = nearest(x[own], [(b * size, x[b]) for b in sorted(x)], own * size, k)
        p = conditional(d, perplexity).ravel().astype(np.float32)
        i, j = np.repeat(own * size + np.arange(len(j)), k).astype(np.int32), j.ravel().astype(np.int32)
        out = [(own, i, j, p)]
        for b in np.unique(j // size).tolist():
            some = j // size == b
            out.append((b, j[some], i[some], p[some]))
        for r in out:
            yield pa.RecordBatch.from_pydict({"block": pa.array([r[0]], pa.int32())} | {c: pa.array([r[at].tobytes()], pa.binary()) for at, c in enumerate("ijp", 1)})

    def merge(table: pa.Table) -> pa.Table:
        i, j, p = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("i", np.int32), ("j", np.int32), ("p", np.float32)))
        pair = i.astype(np.int64) * n + j
        order = np.lexsort((p, pair))  # sums don't depend on the order of arrival
        head = np.flatnonzero(np.diff(pair[order], prepend=-1))
        value = (np.add.reduceat(p[order].astype(float), head) / (2 * n)).astype(np.float32)
        return pa.table({"block": table.column("block")[:1], "i": pa.array([i[order][head].tobytes()], pa.binary()), "j": pa.array([j[order][head].tobytes()], pa.binary()), "p": pa.array([value.tobytes()], pa.binary())})

    asked = blocks.select("block", "x").withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).repartitionById(count, F.col("asked"))
    links = written(asked.mapInArrow(link, target).groupBy("block").applyInArrow(merge, target), "affinities")
    axes = axes[:, :2]
    axes = np.pad(axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1), ((0, 0), (0, 2 - axes.shape[1])))
    spread = 1e-4 / max(1e-12, np.sqrt(max(0, values[-1]) * (n - 1) / n))

    secret = secrets.token_bytes(32)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peers = Peers(BarrierTaskContext.get(), secret)
        mine = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["block"])
        own = np.concatenate([np.zeros(0, np.int64), *(r["block"] * size + np.arange(len(r["keys"]) // 8) for r in mine)])
        owners = [np.array(json.loads(x), np.int64) for x in peers.gather(json.dumps([r["block"] for r in mine]).encode())]
        theirs = [np.concatenate([np.zeros(0, np.int64), *(np.arange(b * size, min(n, b * size + size)) for b in x)]) for x in owners]
        y = np.concatenate([np.zeros((0, 2)), *((matrix(r["x"]) - mean) @ axes * spread + 1e-6 * np.random.default_rng([seed, r["block"]]).standard_normal((len(r["keys"]) // 8, 2)) for r in mine)])
        i, j, p = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in mine)]) for c, kind in (("i", np.int32), ("j", np.int32), ("p", np.float32)))
        pull, repulsion = Attraction(own, np.bincount(np.searchsorted(own, i), minlength=len(own)), j.astype(np.int64), p), Repulsion(peers)
        places = np.zeros((2, n), np.float32)

        def share() -> None:
            for at, x in zip(theirs, peers.gather(y.astype(np.float32).tobytes()), strict=True):
                places[:, at] = np.frombuffer(x, np.float32).reshape(-1, 2).T

        speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50)
        for step in range(iterations):
            share()
            away, total = repulsion(places.T.astype(float, order="F"), own)
            grad = 4 * ((12 if step < 250 else 1) * pull(*places) - away / total)
            gain = np.maximum(np.where(np.sign(grad) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
            speed = (0.5 if step < 250 else 0.8) * speed - rate * gain * grad
            y = y + speed
        share()
        y = y - places.mean(1, dtype=float)
        keys = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["keys"], np.int64) for r in mine)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(y[:, 0]), pa.array(y[:, 1])], names=[key, "x", "y"])

    together = min(together, count)
    spread_out = links.join(blocks, "block").repartitionById(together, F.pmod("block", F.lit(together)).cast("int"))
    return written(spread_out.mapInArrow(move, f"{key} long, x double, y double", barrier=True), "tsne")
