"""Steps whose work must grow no faster than the rows, against plain numpy."""

import queue
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralith.operators import separability, spatial, stats, tsne, variogram
from terralith.sources import raster, sinks
from tests.test_scale import brute_information


def test_many_columns_without_an_aggregate_for_each_pair(spark):
    """Covariances, class distances and silhouettes of 20 columns, copies and an unlabelled row included."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(90, 20)) + 5, np.full((8, 20), 2.5)])
    y = [*("abc"[k % 3] for k in range(90)), *"aaaabbbb"]
    names = [f"c{i}" for i in range(20)]
    rows = spark.createDataFrame([(k, c, *map(float, v)) for k, (c, v) in enumerate(zip(y, x))], "objeto_id long, clase string, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    means, cov, n = stats.wide_covariance(rows, names)
    assert n == 98 and np.allclose(means, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    assert np.allclose(stats.covariance(rows, names)[1], cov)
    got = {r["k"]: r for r in separability.class_moments(rows, names, np.eye(20), "clase").collect()}
    for c in "abc":
        z = x[np.array(y) == c]
        assert got[c]["n"] == len(z) and np.allclose(got[c]["m"], z.mean(0)) and np.allclose(got[c]["c"], np.cov(z.T)[np.triu_indices(20)])
    assert separability.class_distances(rows, names, dimensions=4).count() == 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(98):
        near = {c: d[i][[v == c and j != i for j, v in enumerate(y)]].mean() for c in "abc"}
        a, b = near[y[i]], min(v for c, v in near.items() if c != y[i])
        s.append((b - a) / max(a, b))
    assert separability.silhouette(rows, names, "clase", blocks=3).head()["silhouette"] == pytest.approx(np.mean(s), rel=1e-9)


def test_many_fits_at_once_equal_one_by_one():
    rng = np.random.default_rng(8)
    n = rng.integers(3, 6, 60)
    far = rng.uniform(25, 3000, 60)
    h, g, held = (np.zeros((60, 5)) for _ in range(3))
    for k in range(60):
        h[k, : n[k]], held[k, : n[k]] = (np.arange(n[k]) + 0.5) * far[k] / 5, 1
        g[k, : n[k]] = np.sort(rng.uniform(0, 4, n[k])) if k % 2 else rng.uniform(0, 4, n[k])
    variance = rng.uniform(0.1, 3, 60)
    got = variogram.fit_many(h, g, held, variance, far)
    shape = lambda k, p, q, a: ((g[k, : n[k]] - p - (q - p) * variogram.spherical(h[k, : n[k]], a)) ** 2).sum()
    for k in range(60):
        error, *_ = variogram.fit(h[k, : n[k]], g[k, : n[k]], variogram.spherical, (0.0, 2 * variance[k]), (0.0, 3 * variance[k]), (10.0, 1.5 * far[k]), whole_sill=True)
        assert shape(k, *got[k]) == pytest.approx(error, rel=1e-6, abs=1e-12)


def test_lags_exchange_a_row_for_each_bin(spark):
    """Pairs of an object's pixels are no rows of the plan."""
    rows = spark.range(900).selectExpr("id % 3 AS objeto_id", "CAST(id * id % 97 AS DOUBLE) AS pixel_x", "CAST(id % 101 AS DOUBLE) AS pixel_y", "CAST(id % 7 AS DOUBLE) AS v")
    lags = variogram.local_lags(rows)
    assert lags.count() == 15 and "SortMergeJoin" not in (plan := lags._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroupsInArrow" in plan


def test_ranks_of_repeated_values_and_missing_ones(spark, monkeypatch):
    """Joined by broadcast and by shuffle; ranks are put in order by ranges of values."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, (300, 3)).astype(float)
    x[:, 1] += x[:, 0]
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(1.0, None, 2.0)], "a double, b double, c double").repartition(3)
    rank = np.stack([[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in x.T])
    want = np.corrcoef(rank)
    for most in (200_000, 10):
        monkeypatch.setattr(stats, "BROADCAST", most)
        got = {(r["a"], r["b"]): r["r"] for r in stats.spearman(rows, ["a", "b", "c"]).collect()}
        assert got == {("a", "b"): pytest.approx(want[0, 1]), ("a", "c"): pytest.approx(want[0, 2]), ("b", "c"): pytest.approx(want[1, 2])}
    assert {(r["column"], r["x"]): r["rank"] for r in stats.average_ranks(rows.dropna(), ["a", "b"]).collect()} == {(n, v): k for n, c, rk in zip("ab", x.T, rank) for v, k in zip(c, rk)}


def test_tasks_of_object_statistics_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(stats, "PER_TASK", 100)
    rows = spark.range(2000).selectExpr("id % 40 AS objeto_id", "CAST(id % 7 AS DOUBLE) AS b1", "CAST(id AS DOUBLE) AS b2")
    got = stats.object_band_statistics(rows, ["b1", "b2"])
    assert "RepartitionByExpression [objeto_id#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and ", 40" in plan
    assert got.count() == 80


def test_wide_rows_of_a_grid_take_as_many_steps_as_values(spark, tmp_path):
    """A line of 60,000 cells with 30,000 values, and empty ends; looked up in a map, it took 60,000 times 30,000 steps."""
    meta = {"x0": 0.0, "dx": 1.0, "y0": 3.0, "dy": -1.0, "width": 60_000, "height": 3}
    cells = spark.range(30_000).selectExpr("CAST(1 AS INT) AS row", "CAST(2 * id + 1 AS INT) AS col", "CAST(id AS DOUBLE) AS b1").unionAll(spark.sql("SELECT 2, 5, CAST(NULL AS DOUBLE)"))
    start = time.time()
    sinks.write_ascii_grid(cells, meta, f"file://{tmp_path}/g")
    took = time.time() - start
    grid, _ = raster.read_ascii_grid(spark, f"file://{tmp_path}/g")
    assert grid.count() == 180_000 and took < 8
    got = grid.where("b1 IS NOT NULL").agg(F.count("*"), F.min("row"), F.max("row"), F.count_if(F.col("col") != 2 * F.col("b1") + 1)).head()
    assert tuple(got) == (30_000, 1, 1, 0)


def test_extraction_settles_what_lies_inside_once(spark, monkeypatch):
    """The join of pixels and outlines runs once; without objects that have no pixel, the grid is read no second time."""
    seen, real = [], spatial.settled
    monkeypatch.setattr(spatial, "settled", lambda df, name: seen.append(name) or real(df, name))
    grid = spark.range(400).selectExpr("CAST(id DIV 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col", "CAST(id AS DOUBLE) AS b1")
    meta = {"x0": 0.0, "dx": 1.0, "y0": 20.0, "dy": -1.0, "width": 20, "height": 20}
    ring = lambda a, b: [[[{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]]]
    shapes = spark.createDataFrame([(1, "a", ring(0.0, 7.0)), (2, "a", ring(5.0, 19.0))], "objeto_id long, clase string, polygons array<array<array<struct<x:double,y:double>>>>")
    got = spatial.extract_pixels(grid, shapes, meta, ["b1"])
    assert seen == ["inside", "alone"] and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["objeto_id"]: r["count"] for r in got.groupBy("objeto_id").count().collect()} == {1: 49, 2: 196}


def test_moran_in_slices_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PER_BLOCK", 300)
    rng = np.random.default_rng(7)
    p, z = rng.integers(0, 60, (800, 2)).astype(float), rng.normal(size=800)
    rows = pd.DataFrame({"objeto_id": np.arange(800), "cx": p[:, 0], "cy": p[:, 1], "value": z})
    got = spatial.morans_i(spark.createDataFrame(rows)).head()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    w = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
    z = z - z.mean()
    assert got["moran_i"] == pytest.approx(float(z @ (w @ z / w.sum(1)) / (z @ z)), rel=1e-9)


def test_information_where_equal_gaps_are_unlike_doubles(spark):
    """Tenths: x - d, rounded, lies on either side of the value that is d away; differences are compared as SQL does."""
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 500)
    a = np.round(rng.normal(size=500) * 4 + y) / 10
    b = rng.integers(-40, 40, 500).astype(float) * 0.1 + 0.1 * y
    rows = spark.createDataFrame([(str(c), float(p), float(q)) for c, p, q in zip(y, a, b)], "clase string, a double, b double")
    got = {r["variable"]: r["mi"] for r in separability.mutual_information(rows, ["a", "b"]).collect()}
    assert got == {"a": pytest.approx(brute_information(a, y), rel=1e-9, abs=1e-12), "b": pytest.approx(brute_information(b, y), rel=1e-9, abs=1e-12)}


def test_bounds_are_the_last_doubles_that_far():
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=300) / 10, [1.0, 0.3, -0.3, 0.0, 5.0]])
    d = np.concatenate([np.abs(rng.normal(size=300)) / 10, [1.0, 0.0, 0.3, 0.1, 1e300]])
    low = separability.last_at(x, d)
    assert (x - low >= d).all() and (x[d > 0] - np.nextafter(low, np.inf)[d > 0] < d[d > 0]).all() and low[301] == 0.3


def test_repulsion_equals_the_sum_of_all_pairs():
    """Places that nearly meet, and ones far apart."""
    for scale, most in ((1e-4, 1e-5), (1, 1e-3), (8, 0.01)):
        y = np.random.default_rng(0).normal(size=(2000, 2)) * scale
        apart = y[:, None] - y[None]
        q = 1 / (1 + (apart**2).sum(-1))
        want = (q[..., None] ** 2 * apart).sum(1)
        got, total = tsne.Repulsion()(y, np.arange(2000))
        assert np.sqrt(((got - want) ** 2).sum() / (want**2).sum()) < most and total == pytest.approx(q.sum() - 2000, rel=1e-3)


def test_tsne_of_few_objects_lies_as_well_as_with_all_pairs(spark):
    """1,200 objects in three blocks, moved by two tasks: groups stay together, and each object comes back once."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(400, 3)) + 12 * k for k in range(3)])
    rows = spark.createDataFrame([(7 * k + 1, *map(float, v)) for k, v in enumerate(x)], "objeto_id long, a double, b double, c double")
    got = tsne.tsne(rows, ["a", "b", "c"], iterations=300, tasks=2).orderBy("objeto_id").toPandas()
    assert got["objeto_id"].tolist() == [7 * k + 1 for k in range(1200)]
    y = got[["x", "y"]].to_numpy()
    own = ((y[:, None] - y[None]) ** 2).sum(-1) + 1e18 * np.eye(1200)
    assert (own.argmin(1) // 400 == np.arange(1200) // 400).mean() > 0.99 and np.allclose(y.mean(0), 0, atol=1e-3)


def test_nearest_others_are_exact():
    x = np.random.default_rng(2).normal(size=(700, 4))
    d, j = tsne.nearest(x[300:500], [(0, x[:300]), (300, x[300:500]), (500, x[500:])], 300, 20)
    full = ((x[300:500, None] - x[None]) ** 2).sum(-1)
    full[np.arange(200), 300 + np.arange(200)] = np.inf
    want = np.sort(full, 1)[:, :20]
    assert np.allclose(np.sort(d, 1), want) and np.allclose(np.sort(np.take_along_axis(full, j, 1), 1), want)


def test_nearest_others_of_many_objects_need_few_of_all_pairs():
    """Exact with copies among the objects too, and several times as quick as a look at all pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60_000, 6)) + rng.integers(0, 3, (60_000, 1))
    x[:30] = x[30]
    x = x[np.argsort(tsne.z_order(x, x.mean(0), np.eye(6), x.std() / 8), kind="stable")]
    parts = [(b, x[b : b + 5000]) for b in range(0, len(x), 5000)]
    start = time.perf_counter()
    d, j = tsne.nearest(x[5000:6024], parts, 5000, 91)
    took, start, want = time.perf_counter() - start, time.perf_counter(), []
    for a in range(5000, 6024, 256):
        full = np.maximum((x[a : a + 256] ** 2).sum(1)[:, None] + (x * x).sum(1) - 2 * x[a : a + 256] @ x.T, 0)
        full[np.arange(256), np.arange(a, a + 256)] = np.inf
        want.append(np.sort(np.partition(full, 90, axis=1)[:, :91], 1))
    assert np.allclose(np.sort(d, 1), np.concatenate(want), atol=1e-9) and took < 0.6 * (time.perf_counter() - start)
    assert all(len(set(r)) == 91 for r in j.tolist()) and (j != np.arange(5000, 6024)[:, None]).all()


def test_few_places_far_apart_make_no_wide_grid():
    y = np.random.default_rng(1).normal(size=(30, 2)) * 3000
    apart = y[:, None] - y[None]
    q = 1 / (1 + (apart**2).sum(-1))
    start = time.perf_counter()
    got, total = tsne.Repulsion()(y, np.arange(30))
    assert np.allclose(got, (q[..., None] ** 2 * apart).sum(1), rtol=1e-9, atol=0) and total == pytest.approx(q.sum() - 30, rel=1e-6) and time.perf_counter() - start < 1


class Thread:
    """What ``Repulsion`` needs of ``tsne.Peers``, for tasks that are threads."""

    def __init__(self, rank, ways):
        self.rank, self.ways, self.peers = rank, ways, {k: None for k in range(len(ways)) if k != rank}

    def swap(self, parts):
        for k, one in enumerate(parts):
            self.ways[self.rank][k].put(one)
        return [self.ways[k][self.rank].get(timeout=60) for k in range(len(parts))]


@pytest.mark.parametrize("scale", [(1e-4, 1e-4), (20.0, 20.0), (20.0, 1e-3)])
def test_tasks_share_the_grid(monkeypatch, scale):
    monkeypatch.setattr(tsne, "SHARED", 0)
    y = np.random.default_rng(0).normal(size=(3000, 2)) * scale
    want, total = tsne.Repulsion()(y, np.arange(3000))
    ways = [[queue.Queue() for _ in range(7)] for _ in range(7)]
    got, totals = np.zeros_like(want), []

    def run(k):
        got[k::7], one = tsne.Repulsion(Thread(k, ways))(y, np.arange(k, 3000, 7))
        totals.append(one)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(7)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4 * np.abs(want).max()) and totals == [pytest.approx(total, rel=1e-6)] * 7 and len(set(totals)) == 1
