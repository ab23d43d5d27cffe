"""Sources that tasks read in parts, against plain sequential reads; writers that leave all of a layer or nothing."""

import os
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.sources import geopackage, raster, shapefile, sinks, vector
from terralith.sources.parts import part_files

LAYER = "number long, name string, share double, there boolean, long_name_of_one int, long_name_of_two int, polygons array<array<array<struct<x:double,y:double>>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(x, y, w):
    return ring((x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y))


def features(n):
    """Features with holes and several parts, some without a geometry or attributes."""
    for k in range(n):
        outer = [square(10 * k, 0, 8), square(10 * k + 1, 1, 2)[::-1]]
        polygons = None if k % 11 == 5 else [outer, [square(10 * k, 20, 3)]] if k % 3 == 0 else [outer]
        yield (k, None if k % 7 == 2 else f"ñandú {k}", None if k % 5 == 1 else 1 / (k + 1), k % 2 == 0, k, -k, polygons)


def plain(polygons):
    """Rings as sets of polygons of points, each ring from its least point and in one direction."""

    def turned(r):
        p = [(q["x"], q["y"]) for q in r][:-1]
        k = p.index(min(p))
        p = p[k:] + p[:k]
        return tuple(p if p[1] < p[-1] else [p[0], *p[:0:-1]])

    return polygons and sorted(tuple(turned(r) for r in g) for g in polygons)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(features(70)), LAYER)


FORMATS = {
    "shapefile": (sinks.write_shapefile, vector.read_shapefile, ".shp", ("long_name_", "long_nam_1")),
    "geopackage": (sinks.write_geopackage, vector.read_geopackage, ".gpkg", ("long_name_of_one", "long_name_of_two")),
}


@pytest.mark.parametrize("kind", FORMATS)
def test_layers_come_back_as_they_were_written(spark, table, tmp_path, kind):
    write, read, ending, (one, two) = FORMATS[kind]
    path = f"{tmp_path}/layer"
    write(table.repartitionByRange(3, "number"), path)
    assert len(part_files(path, ending)) == 3 and not [f for f in os.listdir(path) if f.startswith("_")]
    got = read(spark, path, records=7)
    assert got.rdd.getNumPartitions() >= 10
    rows = got.orderBy("objeto_id").collect()
    assert [r["objeto_id"] for r in rows] == list(range(1, 71))
    for r, (k, name, share, there, a, b, polygons) in zip(rows, features(70), strict=True):
        assert (int(r["number"]), r["name"], r["share"] and float(r["share"]), int(r[one]), int(r[two])) == (k, name, share, a, b)
        assert r["there"] in (("T", "1") if there else ("F", "0"))
        assert plain(r["polygons"]) == plain(polygons)
    # the same rows and numbers, whatever the size of the parts
    assert [tuple(r) for r in read(spark, path, records=1000).orderBy("objeto_id").collect()] == [tuple(r) for r in rows]
    box = (205.0, -5.0, 300.5, 2.0)
    want = [r["objeto_id"] for r in rows if r["polygons"] and 10 * (r["objeto_id"] - 1) <= box[2] and 10 * (r["objeto_id"] - 1) + 8 >= box[0]]
    assert [r["objeto_id"] for r in read(spark, path, box=box, records=7).orderBy("objeto_id").collect()] == want and len(want) > 7


@pytest.mark.parametrize("kind", FORMATS)
def test_a_failed_task_leaves_nothing(spark, table, tmp_path, kind):
    write, read, ending, _ = FORMATS[kind]
    path = f"{tmp_path}/layer"
    broken = table.repartitionByRange(3, "number").withColumn("share", F.when(F.col("number") == 60, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("share")))
    with pytest.raises(Exception, match="lost"):
        write(broken, path)
    assert not os.path.exists(path) or not os.listdir(path)
    write(table.where("number < 3").coalesce(1), path)
    with pytest.raises(FileExistsError):
        write(table, path)
    with pytest.raises(Exception, match="lost"):
        write(broken, path, overwrite=True)
    assert read(spark, path).count() == 3
    write(table.where("number < 5").repartition(2), path, overwrite=True)
    assert read(spark, path).count() == 5
    write(table.where("false"), path, overwrite=True)
    assert read(spark, path).count() == 0 and "name" in read(spark, path).columns
    with pytest.raises(ValueError, match="polygons"):
        write(table.drop("polygons"), f"{tmp_path}/other")


def test_text_that_a_shapefile_cannot_hold(spark, table, tmp_path):
    with pytest.raises(Exception, match="254"):
        sinks.write_shapefile(table.withColumn("name", F.repeat(F.lit("é"), 128)), f"{tmp_path}/layer")


def test_geopackages_of_others(spark, tmp_path):
    """Row ids with gaps, several layers, no spatial index, an attribute called like a column of the reader."""
    path = f"{tmp_path}/x.gpkg"
    db = sqlite3.connect(path)
    db.executescript(geopackage.TABLES + "CREATE TABLE other (fid INTEGER PRIMARY KEY, g BLOB); CREATE TABLE fields (fid INTEGER PRIMARY KEY, g BLOB, objeto_id TEXT);")
    for name in ("other", "fields"):
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, 4326)", [name, f"the {name}"])
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'g', 'POLYGON', 4326, 0, 0)", [name])
    ids = [3, 4, 1000, 1001, 500_000, 10**12]
    for k, i in enumerate(ids):
        blob = None if k == 3 else b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", k, 0, k, 1, k + 1, 0, k, 0)
        db.execute("INSERT INTO fields VALUES (?, ?, ?)", [i, blob, f"f{k}"])
    db.commit()
    db.close()
    got = vector.read_layer(spark, f"{path}|layername=fields").orderBy("objeto_id").collect()
    assert [(r["objeto_id"], r["objeto_id_1"], r["polygons"] is None) for r in got] == [(k + 1, f"f{k}", k == 3) for k in range(6)]
    assert [r["objeto_id"] for r in vector.read_geopackage(spark, path, "fields", (1.5, 0, 2.5, 1), records=2).collect()] == [2, 3]
    with pytest.raises(Exception, match="no layer"):
        vector.read_geopackage(spark, path, "none").collect()
    with pytest.raises(ValueError, match="no features"):
        vector.read_layer(spark, path)
    listed = {(r["layer"], r["title"], r["geometry_type"], r["epsg"]) for r in vector.catalogue(spark, str(tmp_path)).collect()}
    assert listed == {("other", "the other", "POLYGON", 4326), ("fields", "the fields", "POLYGON", 4326)}


def write_tiff(path, a, tile, nodata=None, deflate=True, predictor=False):
    """A tiled GeoTIFF of (rows, columns, bands) with cells of 30 units from (1000, 9000)."""
    height, width, bands = a.shape
    across, down = -(-width // tile), -(-height // tile)
    blocks = []
    for r in range(down):
        for c in range(across):
            b = np.zeros((tile, tile, bands), a.dtype)
            part = a[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]
            b[: part.shape[0], : part.shape[1]] = part
            if predictor:
                b[:, 1:] = b[:, 1:] - b[:, :-1]
            blocks.append(zlib.compress(b.tobytes()) if deflate else b.tobytes())
    tags = [(256, "H", [width]), (257, "H", [height]), (258, "H", [8 * a.dtype.itemsize] * bands), (259, "H", [8 if deflate else 1]), (277, "H", [bands]), (284, "H", [1])]
    tags += [(317, "H", [2])] if predictor else []
    at, offsets, counts = 8, [], []
    for b in blocks:
        offsets.append(at)
        counts.append(len(b))
        at += len(b)
    tags += [(322, "H", [tile]), (323, "H", [tile]), (324, "I", offsets), (325, "I", counts), (339, "H", [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * bands)]
    tags += [(33550, "d", [30.0, 30.0, 0.0]), (33922, "d", [0, 0, 0, 1000.0, 9000.0, 0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 32719])]
    tags += [(42113, "s", [str(nodata).encode() + b"\0"])] if nodata is not None else []
    data, entries, extra = b"".join(blocks), b"", b""
    start = 8 + len(data) + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        n = len(raw) if kind == "s" else len(values)
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", start + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[kind], n) + where
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + entries + bytes(4) + extra)


@pytest.mark.parametrize("kind,deflate,predictor", [("<u2", True, True), ("<f4", True, False), ("<i4", False, False)])
def test_a_window_of_a_geotiff_reads_its_tiles_only(spark, tmp_path, kind, deflate, predictor):
    rng = np.random.default_rng(3)
    a = rng.integers(1, 5000, (100, 150, 2)).astype(kind)
    a[7, 9, 1] = 9999
    path = f"{tmp_path}/r.tif"
    write_tiff(path, a, 16, 9999, deflate, predictor)
    grid, meta = raster.read_raster(spark, path)
    assert {k: meta[k] for k in ("x0", "y0", "dx", "dy", "width", "height", "n_bands", "epsg")} == {"x0": 1000.0, "y0": 9000.0, "dx": 30.0, "dy": -30.0, "width": 150, "height": 100, "n_bands": 2, "epsg": "EPSG:32719"}
    whole = {(r["row"], r["col"]): (r["b1"], r["b2"]) for r in grid.collect()}
    assert whole == {(r, c): (float(a[r, c, 0]), None if (r, c) == (7, 9) else float(a[r, c, 1])) for r in range(100) for c in range(150)}

    tiles = spark.read.format("geotiff").option("group", "1").load(path)
    assert tiles.rdd.getNumPartitions() == 7 * 10
    box = (1000 + 30 * 33, 9000 - 30 * 50, 1000 + 30 * 70, 9000 - 30 * 20)  # rows 20 to 50, columns 33 to 70
    some = raster.window(tiles, meta, box)
    assert some.rdd.getNumPartitions() == 3 * 3
    assert {(r["row"], r["col"]): (r["b1"], r["b2"]) for r in some.collect()} == {k: v for k, v in whole.items() if 20 <= k[0] <= 50 and 33 <= k[1] <= 70}
    for where, n in (("row = 17 AND col IN (3, 20)", 2), ("row < 16", 10), ("row > 200", 1), ("row >= 96 AND col > 143", 1), ("b1 > 0", 70)):
        assert tiles.where(where).rdd.getNumPartitions() == n
        assert tiles.where(where).count() == sum(eval(where.replace("AND", "and").replace(" = ", " == ").replace("IN", "in"), {"row": r, "col": c, "b1": v[0]}) for (r, c), v in whole.items())  # noqa: S307


def test_an_ascii_grid_in_splits(spark, tmp_path):
    """Values wrapped at odd places, in splits of some KB each: every cell where a sequential read puts it."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 70)).round(3)
    a[5, 6] = -9999
    words = [f"{v:.3f}" if v != -9999 else "-9999" for v in a.ravel()]
    lines, at = [], 0
    while at < len(words):
        n = int(rng.integers(1, 200))
        lines.append(" ".join(words[at : at + n]))
        at += n
    (tmp_path / "g.asc").write_text("NCOLS 70\nNROWS 300\nXLLCENTER 5\nYLLCENTER 5\nCELLSIZE 10\nNODATA_VALUE -9999\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        grid, meta = raster.read_raster(spark, f"{tmp_path}/g.asc")
        assert grid.rdd.getNumPartitions() > 20 and (meta["x0"], meta["y0"]) == (0.0, 3000.0)
        got = np.full((300, 70), np.nan)
        rows = grid.collect()
        assert len(rows) == 300 * 70
        for r in rows:
            got[r["row"], r["col"]] = -9999 if r["b1"] is None else r["b1"]
        assert (got == a).all()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # written as a folder of parts and read back; cells that the table lacks hold no value
    sinks.write_ascii_grid(grid.where("row % 3 <> 1"), meta, f"{tmp_path}/parts.asc")
    again, other = raster.read_raster(spark, f"{tmp_path}/parts.asc")
    assert other == meta
    assert again.where("b1 IS NOT NULL").exceptAll(grid.where("row % 3 <> 1 AND b1 IS NOT NULL")).count() == 0 and again.where("b1 IS NULL").count() == 70 * 100 + 1
    (tmp_path / "short.asc").write_text("ncols 3\nnrows 2\ncellsize 1\nxllcorner 0\nyllcorner 0\n1 2 3\n4 5\n")
    with pytest.raises(OSError, match="5 values"):
        raster.read_ascii_grid(spark, f"{tmp_path}/short.asc")
    (tmp_path / "none.asc").write_text("1 2 3\n")
    with pytest.raises(OSError, match="no ASCII grid"):
        raster.read_ascii_grid(spark, f"{tmp_path}/none.asc")


def test_names_are_told_apart():
    assert shapefile.apart(["objeto_id", "Polygons", "a", "A", "a_1"]) == ["objeto_id_1", "Polygons_1", "a", "A_1", "a_1_1"]
    assert shapefile.apart(["abcdefghijkl", "abcdefghijkm", "ABCDEFGHIJ"], (), 10) == ["abcdefghij", "abcdefgh_1", "ABCDEFGH_2"]
