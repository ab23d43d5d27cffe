"""Plans for data of unlike sizes give what plain ones give: boxes, tiles, objects with very many pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions import geometry as G
from terralith.operators import separability, spatial, stats, topology, variogram

SHAPES = "objeto_id long, clase string, polygons array<array<array<struct<x:double,y:double>>>>"


def box(x, y, w, h):
    return [[[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]]]


def test_boxes_of_unlike_sizes_touch(spark):
    """Parcels in a country that holds them, strips, a point-like one, far and negative places."""
    rng = np.random.default_rng(6)
    shapes = [(x, y, 1, 1) for x in range(-6, 6) for y in range(-6, 6)]
    shapes += [(-1000, -1000, 994, 3000), (6, -6, 5000, 12), (-6, 6, 12, 0.25), (5000, 5000, 1e-7, 1e-7), (5000 + 1e-7, 5000, 40, 40), (0.5, 6.25, 3, 2)]
    shapes += [(float(a), float(b), float(2.0 ** rng.integers(-3, 9)), float(2.0 ** rng.integers(-3, 9))) for a, b in rng.integers(7000, 7400, (40, 2))]
    rows = [(k, "a", box(*s)) for k, s in enumerate(shapes)]
    got = {r["objeto_id"]: r["neighbors"] for r in topology.touch_degree(spark.createDataFrame(rows, SHAPES)).collect()}
    want = {k: sum(G.touches(a, b) for j, (_, _, b) in enumerate(rows) if j != k) for k, (_, _, a) in enumerate(rows)}
    assert got == want and max(want.values()) > 10


def test_one_country_among_parcels_makes_few_cells(spark, monkeypatch):
    """A box a million times as wide as 2,000 others: the join's input stays at some cells a box."""
    side = spark.range(2000).select((F.col("id") % 50 * 2.0).alias("x"), F.floor(F.col("id") / 50).cast("double").alias("y"), F.col("id"))
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x, y = F.col("x"), F.col("y")
    small = side.select(F.col("id").alias("objeto_id"), F.array(F.array(F.array(p(x, y), p(x + 1, y), p(x + 1, y + 1), p(x, y + 1), p(x, y)))).alias("polygons"))
    all_ = small.unionByName(spark.createDataFrame([(-1, box(-1e6, -1e6, 2e6, 2e6))], "objeto_id long, polygons array<array<array<struct<x:double,y:double>>>>"))
    joined, join = [], type(all_).join

    def counted(self, other, on=None, how=None):
        if on == ["level", "gx", "gy"]:
            joined.extend((self.count(), other.count()))
        return join(self, other, on, how)

    monkeypatch.setattr(type(all_), "join", counted)
    got = {r["objeto_id"]: r["neighbors"] for r in topology.touch_degree(all_).collect()}
    assert joined[0] <= 4 * 2001 and joined[1] <= 8 * 2001
    assert got[-1] == 0 and got[0] == 1 and got[50] == 2


def test_outlines_far_beyond_the_raster_make_no_tiles_there(spark):
    grid = spark.range(100 * 80).select((F.col("id") / 80).cast("int").alias("row"), (F.col("id") % 80).cast("int").alias("col"), F.col("id").cast("double").alias("b1"))
    meta = {"x0": 0.0, "dx": 1.0, "y0": 100.0, "dy": -1.0, "width": 80, "height": 100}
    shapes = [(1, "a", box(-1e12, -1e12, 2e12, 2e12)), (2, "a", box(60.5, 90.5, 1e9, 1e9)), (3, "b", box(500, 500, 10, 10)), (4, "b", box(-50, -50, 20, 1e6))]
    got = spatial.extract_pixels(grid, spark.createDataFrame(shapes, SHAPES), meta, ["b1"], tile=16)
    assert {r["objeto_id"]: r["count"] for r in got.groupBy("objeto_id").count().collect()} == {1: 8000, 2: len([1 for r in range(100) for c in range(80) if c + 0.5 > 60.5 and 100 - r - 0.5 > 90.5]), 3: 1, 4: 1}


def test_quantiles_of_large_objects_as_of_small_ones(spark):
    rng = np.random.default_rng(9)
    values = [(1, float(v), float(v) ** 3) for v in rng.normal(size=700)] + [(2, float(v), 5.0) for v in rng.integers(0, 4, 300)] + [(3, 1.5, None), (4, 2.5, 1.0), (4, 3.5, float("nan"))]
    values += [(5, 1e12 if k == 0 else k / 1000, -1.0 * k) for k in range(500)]
    pixels = spark.createDataFrame(values, "objeto_id long, b1 double, b2 double").repartition(5)
    plain = {(r["objeto_id"], r["band"]): r for r in stats.object_band_statistics(pixels, ["b1", "b2"]).collect()}
    spread = {(r["objeto_id"], r["band"]): r for r in stats.object_band_statistics(pixels, ["b1", "b2"], large=200).collect()}
    assert plain.keys() == spread.keys() and len(plain) >= 9
    for k, r in plain.items():
        assert r.__fields__ == spread[k].__fields__
        assert {c: spread[k][c] for c in r.__fields__ if c != "band"} == {c: pytest.approx(r[c], rel=1e-9, abs=1e-9) for c in r.__fields__ if c != "band"}
    x = np.array([v for i, v, _ in values if i == 1])
    assert [spread[1, "b1"][c] for c in ("p25", "median", "p75")] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist())
    assert spread[1, "b1"]["mad"] == pytest.approx(float(np.median(np.abs(x - np.median(x)))))


def test_nearest_among_clustered_and_repeated_places(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.uniform(0, 1e6, (12, 2)), 5e5 + rng.uniform(0, 1, (900, 2)), np.repeat([[7e5, 7e5], [2e5, 1e5]], [300, 2], 0)])
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "objeto_id long, cx double, cy double")
    got = {r["objeto_id"]: r["proximity"] for r in spatial.nearest(rows).collect()}
    gaps = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    want = np.sort(gaps, 1)[:, :3].mean(1)
    assert len(got) == len(p) and np.allclose([got[i] for i in range(len(p))], want, rtol=1e-9, atol=1e-12)


def test_nearest_of_few(spark):
    few = lambda *p: {r[0]: r[1] for r in spatial.nearest(spark.createDataFrame(list(p), "objeto_id long, cx double, cy double")).collect()}
    assert few((1, 2.0, 3.0)) == {1: None}
    assert few((1, 0.0, 0.0), (2, 3.0, 4.0)) == {1: 5.0, 2: 5.0}
    assert few((1, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0)) == {1: 0.0, 2: 0.0, 3: 0.0}


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute_information(x, y):
    terms = []
    for i in range(len(x)):
        same = np.sort([abs(x[j] - x[i]) for j in range(len(x)) if j != i and y[j] == y[i]])
        if len(same):
            k = min(3, len(same))
            terms.append(psi(k) - psi(len(same) + 1) - psi(max(1, int((np.abs(x - x[i]) < same[k - 1]).sum()))))
    return max(0.0, psi(len(terms)) + sum(terms) / len(terms))


def test_information_with_repeated_values_lone_classes_and_few_values_a_range(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400).astype(object)
    y[0], y[1:5] = "alone", None
    a = rng.normal(size=400) + np.array([0.0 if v is None or v == "alone" else float(v) for v in y])
    b = np.where(rng.random(400) < 0.4, 1.0, np.round(a * 8) / 8)  # one value holds two fifths of the rows; eighths, so that equal gaps are equal doubles
    rows = spark.createDataFrame([(None if v is None else str(v), float(p), float(q)) for v, p, q in zip(y, a, b)], "clase string, a double, b double")
    got = {r["variable"]: r["mi"] for r in separability.mutual_information(rows, ["a", "b"]).collect()}
    assert got == {"a": pytest.approx(brute_information(a, y), rel=1e-9), "b": pytest.approx(brute_information(b, y), rel=1e-9)}


def test_lags_of_an_object_in_many_blocks(spark, monkeypatch):
    """Blocks of 20 pixels against all pairs; pixels at one place, without a value and objects of one pixel included."""
    monkeypatch.setattr(variogram, "PER_BLOCK", 20)
    rng = np.random.default_rng(5)
    rows = [(1, float(x), float(y), float(v)) for x, y, v in rng.integers(0, 40, (300, 3))]
    rows += [(2, float(k), 0.0, float(k % 3)) for k in range(25)] + [(3, 1.0, 1.0, 1.0), (4, 1.0, 1.0, None), (4, None, 1.0, 2.0), (1, 3.0, 3.0, float("nan"))]
    got = variogram.local_lags(spark.createDataFrame(rows, "objeto_id long, pixel_x double, pixel_y double, v double")).collect()
    assert {r["objeto_id"] for r in got} == {1, 2}
    for key in (1, 2):
        p = [r[1:] for r in rows if r[0] == key and r[3] == r[3]]
        pairs = [(np.hypot(a[0] - b[0], a[1] - b[1]), (a[2] - b[2]) ** 2 / 2) for i, a in enumerate(p) for b in p[:i] if a[:2] != b[:2]]
        width = max(d for d, _ in pairs) / 5
        for r in (r for r in got if r["objeto_id"] == key):
            want = [g for d, g in pairs if int(d // width) == r["lag"]]
            assert r["pairs"] == len(want) and r["gamma"] == pytest.approx(np.mean(want)) and r["h"] == pytest.approx((r["lag"] + 0.5) * width)
        assert sum(r["pairs"] for r in got if r["objeto_id"] == key) == sum(d // width < 5 for d, _ in pairs)


def test_positions_count_through_rows_of_a_raster(spark):
    rows = [(0, 0, 1.0, None), (0, 1, None, 10.0), (0, 2, 2.0, 20.0), (2, 0, 3.0, None), (2, 1, 4.0, 30.0)]
    got = stats.positional(spark.createDataFrame(rows, "row int, col int, a double, b double"), ["a", "b"], ["row", "col"])
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 3.0, 30.0)]
    assert got.where("false").count() == 0
