"""Shapefiles, read and written in parts: format("shapefile").

A partition is a range of records: the index (.shx) says where they are, so each task seeks to its own in .shp and .dbf.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from terralith.functions.crs import GEOMETRY
from terralith.functions.geometry import inside
from terralith.sources.parts import PartsWriter, local, part_files, polygon_columns

#: Columns that readers add; attributes of these names get a number.
OWN = ("objeto_id", "polygons")


def apart(names: list[str], taken: tuple[str, ...] = OWN, longest: int = 1 << 20) -> list[str]:
    """The names cut to ``longest`` bytes, with numbers where they would be taken or alike, whatever the case of their letters."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        cut = lambda k, name=name: name.encode()[: longest - k].decode(errors="ignore")
        new, k = cut(0), 0
        while new.lower() in used:
            k += 1
            new = f"{cut(1 + len(str(k)))}_{k}"
        used.add(new.lower())
        out.append(new)
    return out


def shp_polygons(content: bytes) -> list | None:
    """Polygons of a shape record: clockwise rings are outer, the others holes of the outer ring that holds them."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return None
    if kind not in (5, 15, 25):
        raise ValueError(f"shape type {kind} is no polygon")
    parts, n = struct.unpack_from("<ii", content, 36)
    cuts = [*struct.unpack_from(f"<{parts}i", content, 44), n]
    xy = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    rings = [xy[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 2]
    turn = [turning(r) for r in rings]
    outer = [[r] for r, t in zip(rings, turn, strict=True) if t < 0] or [[r] for r in rings]
    if any(t < 0 for t in turn):
        for r, t in zip(rings, turn, strict=True):
            if t >= 0:
                owner = next((o for o in outer if inside(np.hstack([o[0][:-1], o[0][1:]]), r[:1])[0]), outer[0])
                owner.append(r)
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in o] for o in outer] or None


def turning(ring: np.ndarray) -> float:
    """Twice the area inside a closed ring, negative if it runs clockwise."""
    x, y = (ring - ring[0]).T  # about its first point, lest far coordinates swallow a small ring
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())


class Records(InputPartition):
    def __init__(self, file: str, first: int, end: int, before: int):
        self.file, self.first, self.end, self.before = file, first, end, before


def dbf_head(shp: str) -> tuple[int, int, int, list[tuple[str, int]], str | None]:
    """(records, length of the head, of a record, [(name, width)], encoding by the .cpg file) of the attributes."""
    with open(f"{shp[:-4]}.dbf", "rb") as f:
        n, head, size = struct.unpack("<IHH", f.read(32)[4:12])
        raw = f.read(head - 32)
    fields = []
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 0x0D:
            break
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), raw[at + 16]))
    cpg = f"{shp[:-4]}.cpg"
    return n, head, size, fields, open(cpg).read().strip() if os.path.exists(cpg) else None


class ShapefileReader(DataSourceReader):
    def __init__(self, files: list[str], records: int, box: tuple[float, float, float, float] | None):
        self.files, self.records, self.box = files, records, box

    def partitions(self) -> list[Records]:
        out, before = [], 0
        for file in self.files:
            n = dbf_head(file)[0]
            shapes = (os.path.getsize(f"{file[:-4]}.shx") - 100) // 8
            if n != shapes:
                raise ValueError(f"{file}: {shapes} shapes, but {n} rows of attributes")
            out += [Records(file, k, min(n, k + self.records), before) for k in range(0, n, self.records)]
            before += n
        return out or [Records("", 0, 0, 0)]

    def read(self, part: Records) -> Iterator[tuple]:
        if part.first == part.end:
            return
        _, head, size, fields, encoding = dbf_head(part.file)
        with open(f"{part.file[:-4]}.shx", "rb") as shx, open(part.file, "rb") as shp, open(f"{part.file[:-4]}.dbf", "rb") as dbf:
            shx.seek(100 + 8 * part.first)
            dbf.seek(head + size * part.first)
            for k in range(part.first, part.end):
                at, length = struct.unpack(">ii", shx.read(8))
                record = dbf.read(size)
                shp.seek(2 * at + 8)
                content = shp.read(2 * length)
                if self.box and (struct.unpack_from("<i", content)[0] == 0 or not meets(struct.unpack_from("<4d", content, 4), self.box)):
                    continue
                yield (part.before + k + 1, *attributes(record, fields, encoding), shp_polygons(content))


def meets(a: tuple, b: tuple) -> bool:
    """Whether boxes (xmin, ymin, xmax, ymax) have a point in common."""
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def attributes(record: bytes, fields: list[tuple[str, int]], encoding: str | None) -> list[str | None]:
    values, at = [], 1
    for _, width in fields:
        raw = record[at : at + width]
        try:
            text = raw.decode(encoding or "utf-8")
        except (UnicodeDecodeError, LookupError):
            text = raw.decode("latin-1")
        values.append(text.strip(" \0") or None)
        at += width
    return values


def field_of(f: StructField) -> tuple[str, int, int]:
    """(DBF type, width, decimals)."""
    kind = f.dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return "N", 20, 0
    if isinstance(kind, (FloatType, DoubleType)):
        return "F", 25, 15
    if isinstance(kind, DecimalType):
        return "N", min(254, kind.precision + 2), kind.scale
    return ("L", 1, 0) if isinstance(kind, BooleanType) else ("C", 254, 0)


class ShapefileWriter(PartsWriter):
    """Attributes keep their values: doubles with all their digits, text in UTF-8; text of over 254 bytes is an error."""

    endings = (".shp", ".shx", ".dbf", ".cpg")

    def write_file(self, stem: str, rows: Iterator[Row]) -> int:
        shape = polygon_columns(self.schema)[0]
        fields = [f for f in self.schema if f.name != shape]
        names = apart([f.name for f in fields], (), 10)
        kinds = [field_of(f) for f in fields]
        low, high, n = np.full(2, np.inf), np.full(2, -np.inf), 0
        with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf, open(f"{stem}.cpg", "w") as cpg:
            cpg.write("UTF-8")
            shp.write(bytes(100))
            shx.write(bytes(100))
            head = b"".join(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, digits) for name, (kind, width, digits) in zip(names, kinds, strict=True)) + b"\r"
            size = 1 + sum(width for _, width, _ in kinds)
            dbf.write(bytes(32) + head)
            for row in rows:
                content, box = shape_record(row[shape])
                if box is not None:
                    low, high = np.minimum(low, box[:2]), np.maximum(high, box[2:])
                n += 1
                shx.write(struct.pack(">ii", shp.tell() // 2, len(content) // 2))
                shp.write(struct.pack(">ii", n, len(content) // 2) + content)
                dbf.write(b" " + b"".join(cell(row[f.name], kind, width, f.name) for f, (kind, width, _) in zip(fields, kinds, strict=True)))
            dbf.write(b"\x1a")
            dbf.seek(0)
            dbf.write(struct.pack("<4BIHH", 3, 126, 1, 1, n, 32 + len(head), size))
            extent = [*low, *high] if np.isfinite(low).all() else [0.0] * 4
            for f in (shp, shx):
                length = f.seek(0, 2) // 2
                f.seek(0)
                f.write(struct.pack(">i20xi", 9994, length) + struct.pack("<ii8d", 1000, 5, *extent, 0, 0, 0, 0))
        return n


def shape_record(polygons: list | None) -> tuple[bytes, np.ndarray | None]:
    """(record, box): outer rings clockwise, holes the other way round."""
    rings = []
    for polygon in polygons or []:
        for k, ring in enumerate(polygon):
            xy = np.array([(p["x"], p["y"]) for p in ring], "<f8")
            if len(xy):
                rings.append(xy[::-1] if (turning(xy) > 0) == (k == 0) else xy)
    if not rings:
        return struct.pack("<i", 0), None
    points = np.concatenate(rings)
    box = np.concatenate([points.min(0), points.max(0)])
    starts = np.cumsum([0, *map(len, rings[:-1])]).astype("<i4")
    return struct.pack("<i4dii", 5, *box, len(rings), len(points)) + starts.tobytes() + points.tobytes(), box


def cell(value: object, kind: str, width: int, name: str) -> bytes:
    if kind == "L":
        return b"?" if value is None else b"T" if value else b"F"
    if value is None:
        return b" " * width
    text = (repr(value) if kind == "F" else str(value)).encode()
    if len(text) > width:
        raise ValueError(f"a value of {name} has {len(text)} bytes, a shapefile holds {width}")
    return text.rjust(width) if kind in "NF" else text.ljust(width)


class Shapefile(DataSource):
    """Options path (a .shp file or a folder of them), records (for each task), box (xmin,ymin,xmax,ymax)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def files(self) -> list[str]:
        return part_files(self.options["path"], ".shp")

    def schema(self) -> StructType:
        names = apart([f for f, _ in dbf_head(self.files()[0])[3]])
        return StructType([StructField("objeto_id", LongType()), *(StructField(n, StringType()) for n in names), StructField("polygons", GEOMETRY)])

    def reader(self, schema: StructType) -> ShapefileReader:
        box = self.options.get("box")
        return ShapefileReader(self.files(), int(self.options.get("records", "20000")), tuple(map(float, box.split(","))) if box else None)

    def writer(self, schema: StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(local(self.options["path"]), schema, overwrite)
