"""Queries over all rows of their tables, where others of the registry take a part."""

import inspect
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from terralith.operators import separability, spatial, tsne, variogram
from terralith.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
KMEANS = separability.kmeans


@pytest.mark.parametrize("name", ["toi_whole", "tli_whole"])
def test_every_line_is_scored(spark, name):
    assert registry.QUERIES[name](spark, SF).count() == pq.ParquetFile(f"{SF}/lineitem.parquet").metadata.num_rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_raster_covers_all_pixels(spark, sf):
    d = f"/root/testdata/{sf}"
    meta, pixels = registry.whole_meta(spark, d), fixtures.pixels(spark, d)
    cells = registry.raster_of(pixels, meta)
    assert cells.where(f"row < 0 OR col < 0 OR row >= {meta['height']} OR col >= {meta['width']}").count() == 0
    objects = {r["objeto_id"] for r in pixels.select("objeto_id").distinct().collect()}
    assert {r["objeto_id"] for r in registry.QUERIES["pixel_extraction_whole"](spark, d).select("objeto_id").distinct().collect()} == objects


def test_objects_outside_the_raster_take_its_nearest_cell(spark):
    meta = {"x0": 0.0, "dx": 10.0, "y0": 40.0, "dy": -10.0, "width": 4, "height": 4}
    cells = spark.createDataFrame([(r, c, 10.0 * r + c) for r in range(4) for c in range(4)], "row int, col int, b1 double")
    boxes = [(1, "a", 0.0, 20.0, 20.0, 40.0), (2, "b", 100.0, 110.0, 120.0, 130.0), (3, "b", -90.0, -50.0, -70.0, -30.0)]
    objects = fixtures.with_polygons(spark.createDataFrame(boxes, "objeto_id long, clase string, xmin double, ymin double, xmax double, ymax double"))
    got = sorted((r["objeto_id"], r["row"], r["col"], r["b1"]) for r in spatial.extract_pixels(cells, objects, meta, ["b1"]).collect())
    assert got == [(1, 0, 0, 0.0), (1, 0, 1, 1.0), (1, 1, 0, 10.0), (1, 1, 1, 11.0), (2, 0, 3, 3.0), (3, 3, 0, 30.0)]


def test_zonal_mean_of_an_object_without_pixels(spark):
    pixels = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 7.0), (3, None)], "objeto_id long, b2 double")
    objects = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "objeto_id long")
    assert {r["objeto_id"]: r["value"] for r in spatial.zonal_mean(pixels, objects, "b2").collect()} == {1: 3.0, 2: 7.0, 3: 0.0, 4: 0.0}


def test_zonal_mean_whole_takes_every_pixel(spark):
    want = {r["objeto_id"]: r["m"] for r in fixtures.pixels(spark, SF).groupBy("objeto_id").agg({"b2": "avg"}).toDF("objeto_id", "m").collect()}
    got = {r["objeto_id"]: r["value"] for r in registry.QUERIES["zonal_mean_whole"](spark, SF).collect()}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-5)


def test_lags_whole_take_every_pair_of_an_object(spark):
    """Brute force over all pixels of one object."""
    key, rows = 3, [(r["pixel_x"], r["pixel_y"], r["b5"]) for r in fixtures.pixels(spark, SF).where("objeto_id = 3").collect()]
    pairs = [(math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2), (a[2] - b[2]) ** 2 / 2) for i, a in enumerate(rows) for b in rows[:i]]
    width = max(p[0] for p in pairs) / 5
    want = {k: [g for d, g in pairs if math.floor(d / width) == k] for k in range(5)}
    got = {r["lag"]: r for r in registry.QUERIES["local_variogram_lags_whole"](spark, SF).where(f"objeto_id = {key}").collect()}
    assert {k: r["pairs"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k]["gamma"] == pytest.approx(sum(v) / len(v), abs=1e-3) for k, v in want.items())


def shape_of(x, y, v):
    """RSF, FDO and FML of one object, by brute force over all pairs of its pixels."""
    i, j = np.triu_indices(len(v), 1)
    d, g = np.hypot(x[i] - x[j], y[i] - y[j]), (v[i] - v[j]) ** 2 / 2
    lag = np.floor(d / (d.max() / 5))
    h, g = (np.arange(5) + 0.5) * d.max() / 5, np.array([g[(lag == k) & (d > 0)].mean() for k in range(5)])
    peaks = [k for k in range(1, 5) if g[k] >= g[k - 1] and (k == 4 or g[k] >= g[k + 1])]
    return g[1] / g[0], (g[1] - g[0]) / (h[1] - h[0]), h[peaks[0] if peaks else g.argmax()]


def test_variogram_descriptors_come_from_every_pixel_of_an_object(spark):
    pixels = fixtures.pixels(spark, SF).where("objeto_id = 3").toPandas()
    assert len(pixels) > 500
    got = registry.QUERIES["local_variogram_descriptors"](spark, SF).where("objeto_id = 3").head()
    want = shape_of(*(pixels[c].to_numpy() for c in ("pixel_x", "pixel_y", "b5")))
    assert (got["var_RSF"], got["var_FDO"], got["var_FML"]) == pytest.approx(want, abs=1e-4)


def test_feature_table_takes_every_pixel_of_an_object(spark):
    """The variogram of the first component, by brute force over all pixels."""
    pixels = fixtures.pixels(spark, SF).where("objeto_id = 3").toPandas()
    bands = pixels[registry.BANDS[:4]].to_numpy(float)
    component = (bands - bands.mean(0)) @ np.linalg.eigh(np.cov(bands.T))[1][:, -1]
    got = registry.QUERIES["feature_table"](spark, SF).where("objeto_id = 3").head()
    want = shape_of(pixels["pixel_x"].to_numpy(), pixels["pixel_y"].to_numpy(), component)
    assert (got["var_RSF"], got["var_FDO"], got["var_FML"]) == pytest.approx(want, abs=1e-3)


def test_tsne_gives_a_row_for_every_object(spark):
    rows = spark.range(3050).selectExpr("id AS objeto_id", "sin(id) AS a", "cos(id * id) AS b")
    assert tsne.tsne(rows, ["a", "b"], iterations=1).count() == 3050


def test_tsne_query_runs_past_early_exaggeration(spark, monkeypatch):
    seen, real = {}, tsne.tsne
    monkeypatch.setattr(tsne, "tsne", lambda *a, **k: seen.update(k) or real(*a, **k))
    registry.QUERIES["tsne_2d"](spark, SF)
    assert seen.get("iterations", inspect.signature(real).parameters["iterations"].default) == 1000


def test_tsne_by_parts_equals_the_whole_matrix():
    x = np.random.default_rng(0).normal(size=(60, 4))
    one, many = tsne.embed(x, 10.0, 20, step=60), tsne.embed(x, 10.0, 20, step=7)
    assert np.allclose(one[0], many[0], rtol=1e-6, atol=1e-12) and one[1] == pytest.approx(many[1])


def test_kmeans_query_takes_all_columns_and_defaults(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(separability, "kmeans", lambda rows, columns, **k: seen.append((rows.columns, columns, k)) or (rows, rows))
    registry.QUERIES["kmeans_elbow"](spark, SF)
    have, asked, more = seen[0]
    defaults = inspect.signature(KMEANS).parameters
    assert (more.get("most", defaults["most"].default), more.get("starts", defaults["starts"].default)) == (8, 10)
    assert asked == [*(f"f{i}" for i in range(64)), "f_sig", "f_col"] and set(asked) <= set(have)


def test_mutual_information_of_all_columns(spark):
    got = {r["variable"]: r["mi"] for r in registry.QUERIES["mutual_information_whole"](spark, SF).collect()}
    few = {r["variable"]: r["mi"] for r in registry.QUERIES["mutual_information"](spark, SF).collect()}
    assert set(got) == set(registry.EVERY) and {k: got[k] for k in few} == pytest.approx(few, abs=1e-4)
