"""GeoPackages, read and written in parts: format("geopackage").

A partition is a range of row ids.  A box is looked up in the file's R-tree where it has one, and in the envelopes that stand
before the geometries where it hasn't.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from terralith.functions.crs import GEOMETRY
from terralith.sources.parts import PartsWriter, local, part_files, polygon_columns
from terralith.sources.shapefile import apart, meets

Box = tuple[float, float, float, float]


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layers(path: str) -> list[tuple[str, str, str | None, str | None, int]]:
    """(layer, title, geometry column, type, code of the reference system) of the feature tables, in the order of the file."""
    with connect(path) as db:
        return db.execute(
            "SELECT c.table_name, coalesce(c.identifier, c.table_name), g.column_name, g.geometry_type_name, coalesce(c.srs_id, 0) FROM gpkg_contents c "
            "LEFT JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type = 'features' ORDER BY c.rowid"
        ).fetchall()


def layer_of(path: str, layer: str | None) -> tuple[str, str, list[str]]:
    """(layer, geometry column, attributes); the first layer if none is named."""
    known = {r[0]: r[2] for r in layers(path)}
    layer = layer or next(iter(known), None)
    if layer not in known:
        raise ValueError(f"{path} has no layer {layer!r}; it has {', '.join(known)}")
    with connect(path) as db:
        names = [r[1] for r in db.execute(f"PRAGMA table_info({quoted(layer)})") if r[1] != known[layer] and not r[5]]
    return layer, known[layer], names


def wkb_polygons(data: bytes | None) -> list | None:
    """Polygons of well-known binary (2D, or with further ordinates, which are dropped)."""
    if not data:
        return None

    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) if kind & 0xC0000000 else 2 + {0: 0, 1: 1, 2: 1, 3: 2}[kind % 10000 // 1000]
        at, base = at + 5 + 4 * bool(kind & 0x20000000), (kind & 0x0FFFFFFF) % 1000
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        out: list = []
        if base == 3:
            rings = []
            for _ in range(n):
                m = struct.unpack_from(order + "I", data, at)[0]
                xy = np.frombuffer(data, order + "f8", m * dims, at + 4).reshape(m, dims)[:, :2]
                rings.append([{"x": float(x), "y": float(y)} for x, y in xy])
                at += 4 + 8 * m * dims
            return ([rings] if rings else []), at
        if base == 6:
            for _ in range(n):
                part, at = read(at)
                out += part
            return out, at
        raise ValueError(f"geometry type {base} is no polygon")

    return read(0)[0] or None


def gpkg_wkb(blob: bytes | None) -> bytes | None:
    """The well-known binary in a GeoPackage geometry; None for an empty one."""
    if not blob or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] :]


def envelope(blob: bytes, polygons: list | None) -> Box | None:
    """(xmin, ymin, xmax, ymax) as the geometry's head has it, else of its points."""
    if blob[3] >> 1 & 7:
        a = struct.unpack_from(("<" if blob[3] & 1 else ">") + "4d", blob, 8)
        return a[0], a[2], a[1], a[3]
    xy = np.array([(p["x"], p["y"]) for g in polygons or [] for r in g for p in r]).reshape(-1, 2)
    return (*xy.min(0), *xy.max(0)) if len(xy) else None


class RowIds(InputPartition):
    def __init__(self, file: str, first: int, end: int, before: int):
        self.file, self.first, self.end, self.before = file, first, end, before


class GeoPackageReader(DataSourceReader):
    def __init__(self, files: list[str], layer: str | None, records: int, box: Box | None):
        self.files, self.records, self.box = files, records, box
        self.layer, self.column, self.names = layer_of(files[0], layer)

    def partitions(self) -> list[RowIds]:
        """Ranges of row ids of equal width, each with the number of rows before it: one pass over the ids."""
        out, before = [], 0
        for file in self.files:
            with connect(file) as db:
                low, high, n = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {quoted(self.layer)}").fetchone()
                width = -(-(high - low + 1) // max(1, -(-n // self.records))) if n else 1
                for k, held in db.execute(f"SELECT (rowid - ?) / ?, count(*) FROM {quoted(self.layer)} GROUP BY 1 ORDER BY 1", [low, width]) if n else []:
                    out.append(RowIds(file, low + k * width, low + (k + 1) * width, before))
                    before += held
        return out or [RowIds(self.files[0], 0, 0, 0)]

    def read(self, part: RowIds) -> Iterator[tuple]:
        with connect(part.file) as db:
            where, values = "rowid >= ? AND rowid < ?", [part.first, part.end]
            tree = f"rtree_{self.layer}_{self.column}"
            if self.box and db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", [tree]).fetchone():
                where += f" AND rowid IN (SELECT id FROM {quoted(tree)} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)"  # stored in single precision, rounded outwards
                values += [self.box[0], self.box[2], self.box[1], self.box[3]]
            ids = db.execute(f"SELECT rowid FROM {quoted(self.layer)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", [part.first, part.end])
            place = part.before
            columns = ", ".join(map(quoted, [*self.names, self.column]))
            for rowid, *row in db.execute(f"SELECT rowid, {columns} FROM {quoted(self.layer)} WHERE {where} ORDER BY rowid", values):
                while True:
                    place += 1
                    if next(ids)[0] == rowid:
                        break
                polygons = wkb_polygons(gpkg_wkb(row[-1]))
                if self.box and (polygons is None or not meets(envelope(row[-1], polygons), self.box)):
                    continue
                yield (place, *(None if v is None else str(v) for v in row[:-1]), polygons)


# Tables that every GeoPackage has, and the spatial index of its standard.
TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT '2000-01-01T00:00:00.000Z',
  min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys (srs_id));
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);
INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL), ('WGS 84', 4326, 'EPSG', 4326, 'undefined', NULL);
"""
APPLICATION, VERSION = 0x47504B47, 10300


def gpkg_blob(polygons: list | None, srs: int) -> tuple[bytes | None, np.ndarray | None]:
    """(geometry with its envelope, box) of a multipolygon."""
    rings = [[np.array([(p["x"], p["y"]) for p in r], "<f8").reshape(-1, 2) for r in g] for g in polygons or []]
    points = [r for g in rings for r in g if len(r)]
    if not points:
        return None, None
    xy = np.concatenate(points)
    low, high = xy.min(0), xy.max(0)
    one = lambda g: struct.pack("<BII", 1, 3, len(g)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in g)
    head = struct.pack("<2sBBi4d", b"GP", 0, 0b011, srs, low[0], high[0], low[1], high[1])
    return head + struct.pack("<BII", 1, 6, len(rings)) + b"".join(map(one, rings)), np.concatenate([low, high])


def column_type(f: StructField) -> str:
    kind = f.dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return "INTEGER"
    return "DOUBLE" if isinstance(kind, (FloatType, DoubleType)) else "BOOLEAN" if isinstance(kind, BooleanType) else "BLOB" if isinstance(kind, BinaryType) else "TEXT"


class GeoPackageWriter(PartsWriter):
    endings = (".gpkg",)

    def __init__(self, path: str, schema: StructType, overwrite: bool, layer: str, srs: int):
        super().__init__(path, schema, overwrite)
        self.layer, self.srs = layer, srs

    def write_file(self, stem: str, rows: Iterator[Row]) -> int:
        shape = polygon_columns(self.schema)[0]
        fields = [f for f in self.schema if f.name != shape]
        names = apart([f.name for f in fields], ("fid", "geom"))
        low, high, n = np.full(2, np.inf), np.full(2, -np.inf), 0
        db = sqlite3.connect(f"{stem}.gpkg", isolation_level=None)
        try:
            db.executescript(f"PRAGMA application_id = {APPLICATION}; PRAGMA user_version = {VERSION}; PRAGMA synchronous = OFF; PRAGMA journal_mode = OFF; BEGIN; {TABLES}")
            tree = f"rtree_{self.layer}_geom"
            db.execute(f"CREATE TABLE {quoted(self.layer)} (fid INTEGER PRIMARY KEY, geom BLOB" + "".join(f", {quoted(n)} {column_type(f)}" for n, f in zip(names, fields, strict=True)) + ")")
            db.execute(f"CREATE VIRTUAL TABLE {quoted(tree)} USING rtree(id, minx, maxx, miny, maxy)")
            db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", [f"EPSG:{self.srs}", self.srs, self.srs])
            insert = f"INSERT INTO {quoted(self.layer)} VALUES (?, ?{', ?' * len(fields)})"
            for row in rows:
                blob, box = gpkg_blob(row[shape], self.srs)
                n += 1
                values = [row[f.name] if column_type(f) != "TEXT" or row[f.name] is None else str(row[f.name]) for f in fields]
                db.execute(insert, [n, blob, *values])
                if box is not None:
                    db.execute(f"INSERT INTO {quoted(tree)} VALUES (?, ?, ?, ?, ?)", [n, box[0], box[2], box[1], box[3]])
                    low, high = np.minimum(low, box[:2]), np.maximum(high, box[2:])
            extent = [float(v) for v in (*low, *high)] if np.isfinite(low).all() else [None] * 4
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", [self.layer, self.layer, *extent, self.srs])
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'MULTIPOLYGON', ?, 0, 0)", [self.layer, self.srs])
            db.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", [self.layer])
            db.execute("COMMIT")
        finally:
            db.close()
        return n


class GeoPackage(DataSource):
    """Options path (a .gpkg file or a folder of them), layer, records (for each task), box (xmin,ymin,xmax,ymax), srs (for writing)."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def files(self) -> list[str]:
        return part_files(self.options["path"], ".gpkg")

    def schema(self) -> StructType:
        names = apart(layer_of(self.files()[0], self.options.get("layer"))[2])
        return StructType([StructField("objeto_id", LongType()), *(StructField(n, StringType()) for n in names), StructField("polygons", GEOMETRY)])

    def reader(self, schema: StructType) -> GeoPackageReader:
        box = self.options.get("box")
        return GeoPackageReader(self.files(), self.options.get("layer"), int(self.options.get("records", "20000")), tuple(map(float, box.split(","))) if box else None)

    def writer(self, schema: StructType, overwrite: bool) -> GeoPackageWriter:
        return GeoPackageWriter(local(self.options["path"]), schema, overwrite, self.options.get("layer") or "objects", int(self.options.get("srs", "0")))
