"""Reports with their charts and stated totals, progress by section, and the second diagnosis from files."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.plans import engine, progress
from terralith.sources import charts, sinks


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A grid that rises from corner to corner, and 16 boxes of two classes, as files."""
    folder = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(1)
    values = np.add.outer(np.arange(40), np.arange(40)) + rng.normal(size=(40, 40))
    (folder / "g.asc").write_text("ncols 40\nnrows 40\nxllcorner 0\nyllcorner 0\ncellsize 1\nnodata_value -9999\n" + "\n".join(" ".join(f"{v:.4f}" for v in row) for row in values) + "\n")
    box = lambda x, y: [[[x, y], [x + 7.5, y], [x + 7.5, y + 7.5], [x, y + 7.5], [x, y]]]
    places = [(k, 0.2 + 10 * (k % 4), 0.2 + 10 * (k // 4)) for k in range(16)]
    features = [{"type": "Feature", "properties": {"clase": "ab"[k % 8 // 4]}, "geometry": {"type": "Polygon", "coordinates": box(x, y)}} for k, x, y in places]
    (folder / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return folder


@pytest.fixture(scope="module")
def loaded(spark, files):
    return engine.load(spark, f"{files}/g.asc", f"{files}/l.geojson", "clase")


def test_separability_from_files(spark, files, loaded, monkeypatch):
    """Features from the raster, and the same from an earlier extraction that lacks some objects."""
    grid, meta, objects = loaded
    options = {"with_tsne": False, "most_clusters": 3, "starts": 1, "nulls": "drop"}
    got = engine.separability_of(grid, meta, objects, ["b1"], **options)
    rows = {r["objeto_id"]: r for r in got["features"].collect()}
    assert len(rows) == 16 and {r["clase"] for r in rows.values()} == {"a", "b"}
    pixels = engine.observability(grid, meta, objects, ["b1"])["pixels"]
    mean = {r["objeto_id"]: r["m"] for r in pixels.groupBy("objeto_id").agg(F.avg("b1").alias("m")).collect()}
    assert {k: r["b1_mean"] for k, r in rows.items()} == {k: pytest.approx(v) for k, v in mean.items()}
    assert all(r["geom_area"] == pytest.approx(56.25) for r in rows.values())
    tli = got["tli"].head()
    assert 0 <= tli["tli"] <= 100 and tli["pureza"] >= 50.0
    sinks.write_csv(pixels.where("objeto_id < 12").select("objeto_id", "clase", "pixel_x", "pixel_y", "b1"), f"{files}/pixels.csv")
    monkeypatch.setattr(engine, "separable", lambda table, *_, **__: {"features": table})
    again = engine.separability_of(grid, meta, objects, ["b1"], pixels=f"{files}/pixels.csv", **options)
    assert {r["objeto_id"]: r["b1_mean"] for r in again["features"].collect()} == {k: pytest.approx(r["b1_mean"]) for k, r in rows.items()}


def test_observability_report_and_progress(spark, loaded, caplog):
    grid, meta, objects = loaded
    sections = engine.observability(grid, meta, objects, ["b1"], band="b1")
    page = sinks.observability_report(sections)
    assert page.count("<svg") == 4 and all(t in page for t in ("Cells to objects", "Correlation of bands", "Share of variance", "Semivariogram", "Index", "coverage_pct"))
    events = []
    with caplog.at_level("INFO", "terralith.progress"):
        rows = progress.collected({k: sections[k] for k in ("coverage", "toi")}, events.append, every=0.05)
    assert rows["coverage"][0]["coverage_pct"] == 100.0
    assert [(e.section, e.what) for e in events if e.what != "tasks"] == [("coverage", "start"), ("coverage", "end"), ("toi", "start"), ("toi", "end")]
    assert events[-1].percent == 100.0 and events[-1].done > 0 and len(caplog.records) == len(events)
    broken = spark.range(3).select(F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        progress.collected({"first": spark.range(2).toDF("id"), "second": broken}, events.append)
    assert [(e.section, e.what) for e in events[-3:] if e.what != "tasks"][-1] == ("second", "failed")


def test_separability_report_states_its_totals(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1.0, (12, 15)) for m in (0, 5)])
    x = np.column_stack([x, x[:, :10] * 3 + 1])
    names = [f"f{k:02}" for k in range(25)]
    table = spark.createDataFrame([(i, "ab"[i // 12], *map(float, v)) for i, v in enumerate(x)], f"objeto_id long, clase string, {', '.join(f'{c} double' for c in names)}")
    sections = engine.separable(table, with_tsne=False, most_clusters=3, starts=1)
    sections["tsne"] = table.select("objeto_id", F.col("f00").alias("x"), F.col("f01").alias("y"))
    page = sinks.separability_report(sections)
    assert page.count("<svg") == 5
    n = sections["collinearity"].count()
    assert n > 8 and f"8 of {n} rows" in page and "12 of 25 rows" in page and "6 of 25 rows" in page
    best = [r["variable"] for r in sections["mutual_info"].orderBy(F.desc("mi"), "variable").limit(12).collect()]
    listed = re.search(r"Mutual information with the class.*?<table>(.*?)</table>", page)[1]
    assert re.findall(r"<td>(f\d\d)</td>", listed) == best


def test_reports_cut_nothing_in_silence(spark):
    rows = spark.range(250).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    page = sinks.report("All", {"rows": rows})
    assert page.count("<tr>") == 251 and page.index("<td>3</td>") < page.index("<td>249</td>")
    assert "5 of 250 rows" in sinks.report("Some", {"rows": rows}, 5)


def test_charts_of_nothing_and_of_one_value():
    for svg in (charts.lines("t", {}), charts.bars("t", []), charts.matrix("t", [], {}), charts.lines("<t>", {"a": [(1, 2)]}), charts.bars("t", [("a", None)]), charts.matrix("t", ["a", "b"], {("a", "b"): None})):
        assert svg.startswith("<svg") and svg.endswith("</svg>") and "<t>" not in svg
