"""Registered queries against their SQL, and kernels against values known by hand."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions import crs
from terralith.functions import geometry as G
from terralith.operators import compat, separability, spatial, stats, texture, topology, variogram
from terralith.plans import engine, registry
from terralith.sources import pixels, raster, sinks, vector

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SQUARE = [[ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]]
HOLED = [[SQUARE[0][0], ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))]]
ELL = [[ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0))]]
TWO = [SQUARE[0], [ring((10, 0), (11, 0), (11, 1), (10, 1), (10, 0))]]
SHAPES = "objeto_id long, clase string, polygons array<array<array<struct<x:double,y:double>>>>"


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([(1, "a", SQUARE), (2, "a", HOLED), (3, "b", ELL), (4, "b", TWO), (5, "b", None), (6, "b", [])], SHAPES)


def test_areas_and_perimeters(shapes):
    g = F.col("polygons")
    got = {r[0]: r[1:] for r in shapes.where(G.present(g)).select("objeto_id", G.area(g), G.perimeter(g), G.shannon_shape(g)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (16.0, 16.0), 2: (15.0, 20.0), 3: (5.0, 12.0), 4: (17.0, 20.0)}
    assert got[4][2] == 0.0 and got[1][2] == pytest.approx(math.log2(5))


def test_contains_leaves_out_boundary_and_holes(spark, shapes):
    points = spark.createDataFrame([(0.5, 0.5), (0.0, 2.0), (1.5, 1.5), (4.0, 4.0), (10.5, 0.5), (2.5, 2.5)], "x double, y double")
    got = {(r[0], r[1], r[2]) for r in shapes.where(G.present(F.col("polygons"))).crossJoin(points).where(G.contains(F.col("polygons"), F.col("x"), F.col("y"))).select("objeto_id", "x", "y").collect()}
    assert {p[1:] for p in got if p[0] == 2} == {(0.5, 0.5), (2.5, 2.5)}
    assert {p[1:] for p in got if p[0] == 4} == {(0.5, 0.5), (1.5, 1.5), (2.5, 2.5), (10.5, 0.5)}


def test_hull_and_touches():
    area, elongation = G.hull_measures(np.array([(0, 0), (4, 0), (4, 2), (0, 2), (1, 1)], float))
    assert (area, elongation) == (pytest.approx(8), pytest.approx(0.5))
    moved = [[ring((4, 0), (8, 0), (8, 4), (4, 4), (4, 0))]]
    assert G.touches(SQUARE, moved) and not G.touches(SQUARE, HOLED) and not G.touches(SQUARE, TWO[1:])


def test_long_outlines_with_holes_as_by_numpy(spark):
    """A star of 1,000 corners, which is not convex, with a hole: sums by numpy, and no more than linear work."""
    t = np.linspace(0, 2 * np.pi, 1001)[:-1]
    far = 50 + 20 * np.cos(9 * t)
    star = np.stack([1000 + far * np.cos(t), far * np.sin(t)], 1)
    hole = np.stack([1000 + 10 * np.cos(t[::-50]), 10 * np.sin(t[::-50])], 1)
    closed = [np.concatenate([p, p[:1]]) for p in (star, hole)]
    rows = spark.createDataFrame([(1, "a", [[ring(*p) for p in closed]])], SHAPES)
    g = F.col("polygons")
    got = rows.select(G.area(g).alias("a"), G.perimeter(g).alias("p"), G.centroid(g).alias("c"), G.shannon_shape(g).alias("s"), G.hull_shape(g).alias("h")).head()

    def sums(p):
        x, y = p[:, 0], p[:, 1]
        k = x[:-1] * y[1:] - x[1:] * y[:-1]
        return np.array([k.sum() / 2, ((x[:-1] + x[1:]) * k).sum() / 6, ((y[:-1] + y[1:]) * k).sum() / 6]) * np.sign(k.sum())

    total = sums(closed[0]) - sums(closed[1])
    assert got["a"] == pytest.approx(total[0], rel=1e-9) and got["p"] == pytest.approx(sum(np.linalg.norm(np.diff(p, axis=0), axis=1).sum() for p in closed), rel=1e-9)
    centre = total[1:] / total[0]
    assert (got["c"]["x"], got["c"]["y"]) == (pytest.approx(centre[0], rel=1e-9), pytest.approx(centre[1], abs=1e-6))
    d = np.linalg.norm(closed[0] - centre, axis=1)
    assert got["s"] == pytest.approx(float(-(d / d.sum() * np.log2(d / d.sum())).sum()), rel=1e-9)
    assert got["h"]["hull_area"] > total[0]


def test_outlines_of_any_lengths_touch(shapes):
    near = shapes.where("objeto_id IN (2, 4)").unionByName(shapes.sparkSession.createDataFrame([(9, "a", [[ring((4, 1), (6, 0), (7, 2), (6, 4), (4, 3), (4, 1))]])], SHAPES))
    assert {r["objeto_id"]: r["neighbors"] for r in topology.touch_degree(near).collect()} == {2: 1, 4: 1, 9: 2}


def test_sums_over_pairs_of_blocks_as_over_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y, v = rng.uniform(0, 100, (3, 90))
    x[1], y[1] = x[0], y[0]  # two objects at one place
    points = spark.createDataFrame([(k, float(x[k]), float(y[k]), float(v[k])) for k in range(90)], "objeto_id long, cx double, cy double, value double")
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    w = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
    z = v - v.mean()
    monkeypatch.setattr(spatial, "PER_BLOCK", 13)
    assert spatial.morans_i(points).head()["moran_i"] == pytest.approx(float(z @ (w @ z / w.sum(1)) / (z @ z)), rel=1e-9)
    i, j = np.triu_indices(90, 1)
    cutoff = d.max() / 2
    near = d[i, j] < cutoff
    lag = np.minimum(np.floor(d[i, j][near] / (cutoff / 15)), 14).astype(int)
    half = (v[i] - v[j])[near] ** 2 / 2
    got = spatial.semivariogram(points).orderBy("lag").collect()
    assert [r["pairs"] for r in got] == np.bincount(lag, minlength=15).tolist()
    assert [r["gamma"] for r in got] == pytest.approx([half[lag == k].mean() if (lag == k).any() else 0.0 for k in range(15)])


def test_wide_correlations_as_one_by_one(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 20)) + 1e4
    x[:, 3] = 2 * x[:, 2] + 0.1 * rng.normal(size=200)
    x[:, 5] = 7.0
    rows = [[None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(u) for u in r] for r in x]
    columns = [f"c{k}" for k in range(20)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = {(r["a"], r["b"]): r["r"] for r in stats.wide_pearson(table, columns).collect()}
    few = {(r["a"], r["b"]): r["r"] for r in stats.pearson(table, columns[:6]).collect()}
    assert len(got) == 190 and got["c2", "c5"] is None and got["c2", "c3"] > 0.9
    assert {k: got[k] for k in few} == {k: v if v is None else pytest.approx(v, abs=1e-7) for k, v in few.items()}


def test_components_and_pruning_as_by_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 4))
    x[:, 3] = x[:, 0] + 0.05 * rng.normal(size=150)
    table = spark.createDataFrame([(k, "ab"[k % 2], *map(float, r)) for k, r in enumerate(x)], "objeto_id long, clase string, " + ", ".join(f"c{k} double" for k in range(4)))
    columns = [f"c{k}" for k in range(4)]
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    got = stats.pca(table, columns).orderBy("component").collect()
    assert [r["ratio"] for r in got] == pytest.approx((values[::-1] / values.sum()).tolist())
    assert got[0]["effective_dim"] == int((np.cumsum(values[::-1]) / values.sum() < 0.95).sum()) + 1
    first = {r["variable"]: r["loading"] for r in stats.loadings(table, columns).where("component = 1").collect()}
    assert np.abs(list(first.values())) == pytest.approx(np.abs(vectors[:, -1]))
    assert len(separability.prune_collinear(table, columns)) == 3


def test_pixel_tables_are_read_or_extracted(spark, tmp_path):
    (tmp_path / "good.csv").write_text("objeto_id,clase,pixel_x,pixel_y,b1,extra\n1,a,2.5,3.5,7.25,x\n2,b,4.5,5.5,,y\n")
    (tmp_path / "bad.csv").write_text("objeto_id,clase,pixel_x,pixel_y,b1\none,a,2.5,3.5,7.25\n")
    (tmp_path / "band.csv").write_text("objeto_id,clase,pixel_x,pixel_y,b1\n1,a,2.5,3.5,7.25\n1,a,2.5,4.5,bad\n")
    (tmp_path / "head.csv").write_text("objeto_id,clase,pixel_x,pixel_y,b1\n")
    other = lambda: spark.createDataFrame([(9,)], "objeto_id long")
    assert [tuple(r) for r in pixels.pixels_or(spark, f"{tmp_path}/good.csv", ["b1"], other).orderBy("objeto_id").collect()] == [(1, "a", 2.5, 3.5, 7.25), (2, "b", 4.5, 5.5, None)]
    for path in (f"{tmp_path}/bad.csv", f"{tmp_path}/band.csv", f"{tmp_path}/head.csv", f"{tmp_path}/none.csv", None):
        assert pixels.pixels_or(spark, path, ["b1"], other).head()["objeto_id"] == 9
    with pytest.raises(ValueError):
        pixels.read_pixels(spark, f"{tmp_path}/good.csv", ["b2"])


def test_checkerboard_texture(spark):
    grid = spark.createDataFrame([(1, r, c, float((r + c) % 2), r, c) for r in range(6) for c in range(6)], "objeto_id long, row int, col int, v double, pixel_y int, pixel_x int")
    got = texture.texture_features(texture.cells(grid, "v"), "objeto_id").head().asDict()
    assert got["glcm_contrast"] == pytest.approx(49) and got["glcm_homogeneity"] == pytest.approx(1 / 50)
    assert got["glcm_asm"] == pytest.approx(0.5) and got["glcm_correlation"] == pytest.approx(-1)


def test_fits_recover_their_parameters():
    h = (np.arange(15) + 0.5) * 10
    spherical = 1 + 4 * np.where(h < 80, 1.5 * h / 80 - 0.5 * (h / 80) ** 3, 1)
    got = variogram.fit_global(h, spherical, 5.0, 150.0)
    assert got["modelo"] == "esferico" and got["range"] == pytest.approx(80, rel=0.02) and got["sill"] == pytest.approx(5, rel=0.02)


def test_degenerate_groups(spark):
    rows = spark.createDataFrame([(1.0, float(k)) for k in range(5)] + [(1.0, None)], "a double, b double")
    assert stats.pearson(rows, ["a", "b"]).head()["r"] is None
    assert stats.band_statistics(rows, ["a"]).head()["entropia"] == 0.0
    with pytest.raises(separability.MissingValuesError):
        separability.without_missing(rows, ["b"])
    assert separability.without_missing(rows, ["b"], "drop").count() == 5


def test_reprojection_there_and_back():
    x, y = np.array([-70.5, -71.2]), np.array([-33.1, -20.0])
    for code in ("EPSG:3857", "EPSG:32719"):
        a, b = crs.reproject(*crs.reproject(x, y, "EPSG:4326", code), code, "EPSG:4326")
        assert np.allclose(a, x, atol=1e-7) and np.allclose(b, y, atol=1e-7)
    with pytest.raises(crs.UnsupportedCRS):
        crs.reproject(x, y, "EPSG:4326", "EPSG:2154")


def test_both_diagnoses_from_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = np.add.outer(np.arange(40), np.arange(40)) + rng.normal(size=(40, 40))
    (tmp_path / "g.asc").write_text("ncols 40\nnrows 40\nxllcorner 0\nyllcorner 0\ncellsize 1\nnodata_value -9999\n" + "\n".join(" ".join(f"{v:.4f}" for v in row) for row in values) + "\n")
    box = lambda x, y: [[[x, y], [x + 7.5, y], [x + 7.5, y + 7.5], [x, y + 7.5], [x, y]]]
    places = [(k, 0.2 + 10 * (k % 4), 0.2 + 10 * (k // 4)) for k in range(16)]
    import json

    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"clase": "ab"[k % 8 // 4]}, "geometry": {"type": "Polygon", "coordinates": box(x, y)}} for k, x, y in places]}))
    grid, meta, objects = engine.load(spark, f"{tmp_path}/g.asc", f"{tmp_path}/l.geojson", "clase")
    got = engine.observability(grid, meta, objects, ["b1"])
    assert got["coverage"].head()["coverage_pct"] == 100.0
    toi = got["toi"].head()
    assert 0 < toi["toi"] <= 100 and toi["cobertura"] == 100.0 and got["moran"].head()["moran_i"] > 0
    assert got["pixels"].groupBy("objeto_id").count().count() == 16
    page = sinks.report("M1", {k: got[k] for k in ("coverage", "semivariogram_lags")})
    assert "polyline" in page and "coverage_pct" in page
    sinks.write_geojson(got["coverage"].select(F.lit(1).cast("long").alias("objeto_id"), "total"), objects, f"{tmp_path}/out")
    assert json.loads(spark.read.text(f"{tmp_path}/out").head()[0])["geometry"]["type"] == "MultiPolygon"
    sinks.write_csv(got["coverage"], f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == got["coverage"].columns
    with pytest.raises(compat.ValidationError):
        engine.load(spark, f"{tmp_path}/g.asc", f"{tmp_path}/l.geojson", "no such field")
    with pytest.raises(ValueError):
        raster.read_raster(spark, "x.img")
    assert vector.split_path("/a/b.gpkg|layername=c") == ("/a/b.gpkg", "c")


def test_kmeans_as_by_brute_force(spark):
    """Three heaps: the steps end where plain Lloyd steps from the same starts end, and every pair counts in the silhouette."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.6, (20, 2)) for m in (-4, 0, 5)])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "objeto_id long, a double, b double")
    table, clusters = separability.kmeans(rows, ["a", "b"], most=4, starts=3)
    z = (x - x.mean(0)) / x.std(0)

    def lloyd(c):
        for _ in range(100):
            at = ((z[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.stack([z[at == k].mean(0) if (at == k).any() else c[k] for k in range(len(c))])
        gap = ((z[:, None] - c) ** 2).sum(2)
        return gap.min(1).sum(), gap.argmin(1)

    got = {r["k"]: r for r in table.collect()}
    sample = [r["objeto_id"] for r in rows.orderBy(F.xxhash64("objeto_id", F.lit(42)), "objeto_id").collect()]
    for k in (2, 3, 4):
        inertia, at = min((lloyd(separability.first_centres(z[sample], k, 42 + s)) for s in range(3)), key=lambda r: r[0])
        assert got[k]["inertia"] == pytest.approx(inertia, rel=1e-6)
        d = np.sqrt(((z[:, None] - z) ** 2).sum(2))
        near = np.stack([d[:, at == j].sum(1) for j in range(k)], axis=1) / [(at == j).sum() for j in range(k)]
        own = near[np.arange(60), at] * np.bincount(at)[at] / (np.bincount(at)[at] - 1)
        near[np.arange(60), at] = np.inf
        assert got[k]["silhouette"] == pytest.approx(((near.min(1) - own) / np.maximum(near.min(1), own)).mean(), rel=1e-6)
    assert [k for k, r in got.items() if r["selected"]] == [3]
    found = {r["objeto_id"]: r["cluster"] for r in clusters.collect()}
    assert len(found) == 60 and all(len({found[i] for i in range(h, h + 20)}) == 1 for h in (0, 20, 40))


def test_kmeans_of_few_or_missing_rows(spark):
    few = spark.createDataFrame([(1, 1.0), (2, 2.0)], "objeto_id long, a double")
    table, clusters = separability.kmeans(few, ["a"])
    assert table.count() == 0 and {r["cluster"] for r in clusters.collect()} == {0}
    same = spark.createDataFrame([(k, 1.0) for k in range(5)], "objeto_id long, a double")
    assert {r["inertia"] for r in separability.kmeans(same, ["a"], most=3, starts=2)[0].collect()} == {0.0}
    with pytest.raises(separability.MissingValuesError):
        separability.kmeans(few.union(spark.sql("SELECT 3L, CAST(NULL AS DOUBLE)")), ["a"])


def test_separability_as_a_whole(spark):
    """Three classes apart in all of six columns, one of them doubled: every section has its rows and the index its parts."""
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(m, 1.0, (10, 5)) for m in (0, 6, 12)])
    x = np.column_stack([x, 2 * x[:, 0] + 1])
    names = [f"f{i}" for i in range(6)]
    table = spark.createDataFrame([(i, "abc"[i // 10], *map(float, v)) for i, v in enumerate(x)], f"objeto_id long, clase string, {', '.join(f'{c} double' for c in names)}")
    got = engine.separable(table, most_clusters=4, starts=2)
    assert ("f0", "f5") in {(r["a"], r["b"]) for r in got["collinearity"].collect()}
    assert {r["variable"] for r in got["mutual_info"].collect()} == set(names)
    assert [r["k"] for r in got["clustering"].where("selected").collect()] == [3]
    assert all(r["purity"] == 1.0 and r["n"] == 10 for r in got["purity"].collect()) and got["correspondence"].count() == 9
    assert got["distances"].count() == 3 and got["clusters"].count() == 30 and got["tsne"].count() == 30
    tli = got["tli"].head()
    assert tli["pureza"] == 100.0 and 0 < tli["tli"] <= 100
