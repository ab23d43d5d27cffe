"""Rasters: ESRI ASCII grids and GeoTIFF, as (row, col, b1 .. bN) with null for NoData, and their meta data.

A GeoTIFF is a Python data source with one partition for each group of strips or tiles, so tasks decode their own part; filters
on row and col leave only the strips and tiles that meet them.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


# Words that begin the lines before the values of an ASCII grid.
HEAD = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")


def grid_meta(path: str, head: dict[str, float]) -> dict:
    if not {"ncols", "nrows", "cellsize"} <= head.keys():
        raise OSError(f"{path} is no ASCII grid")
    width, height, size = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    x0 = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - size / 2
    low = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - size / 2
    return {"x0": x0, "dx": size, "y0": low + height * size, "dy": -size, "width": width, "height": height, "n_bands": 1, "epsg": None, "wkt": None}


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(pixels, meta) of an .asc grid of one band: a file, or a folder of text parts in the order of their names.

    Spark splits the text.  One pass counts the values of each split; their sums before each split number its values, wherever
    lines break.  No row holds more than a line, and a task no more than some lines.  Values beyond the last cell are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where(F.lower(F.split(F.trim("value"), r"\s+")[0]).isin(*HEAD)).select(F.split(F.trim("value"), r"\s+").alias("w")).limit(len(HEAD)).collect()
    head = {r["w"][0].lower(): float(r["w"][1]) for r in first}
    meta = grid_meta(path, head)
    width, cells, nodata = meta["width"], meta["width"] * meta["height"], head.get("nodata_value", -9999.0)

    def values(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
        for line, file, at in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "at")), strict=True):
            words = line.split()
            if words and words[0].lower() not in HEAD:
                yield (file, at), words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], int] = {}
        for batch in batches:
            for split, words in values(batch):
                held[split] = held.get(split, 0) + len(words)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], pa.string()), pa.array([a for _, a in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["file", "at", "n"])

    counts = lines.mapInArrow(count, "file string, at long, n long").groupBy("file", "at").agg(F.sum("n").alias("n"))
    before, total = {}, 0
    for r in sorted(counts.collect()):  # a row for each split
        before[r["file"], r["at"]] = total
        total += r["n"]
    if total < cells:
        raise OSError(f"{path} has {total} values, {cells} cells")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict(before)
        for batch in batches:
            for split, words in values(batch):
                for k in range(0, len(words), 1 << 16):
                    v = np.array(words[k : k + (1 << 16)], np.float64)
                    place = at[split] + np.arange(len(v))
                    at[split] += len(v)
                    v, place = v[place < cells], place[place < cells]
                    yield pa.RecordBatch.from_arrays([pa.array((place // width).astype(np.int32)), pa.array((place % width).astype(np.int32)), pa.array(v, mask=(v == nodata) | np.isnan(v))], names=["row", "col", "b1"])

    return lines.mapInArrow(number, "row int, col int, b1 double"), meta


# TIFF tags.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT, SCALE, TIE, MATRIX, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}


def tiff_tags(path: str) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the first image."""
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] not in (42, 43):
            raise OSError(f"{path} is no TIFF")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        f.seek(struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0])
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        width, word = (20, "Q") if big else (12, "I")
        entries = [f.read(width) for _ in range(n)]
        tags = {}
        for e in entries:
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + word, e[4:12] if big else e[4:8])[0]
            if kind not in TYPES:
                continue
            inline = e[12:20] if big else e[8:12]
            size = struct.calcsize("<" + TYPES[kind]) * count
            if size > len(inline):
                f.seek(struct.unpack(order + word, inline)[0])
                inline = f.read(size)
            tags[tag] = (inline[:count].rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + TYPES[kind] * count, inline[:size])
    return order, tags


def tiff_meta(path: str) -> dict:
    """Size, affine transform, number of bands, NoData and EPSG code.  Rotated rasters are refused."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    _, t = tiff_tags(path)
    if MATRIX in t:
        m = t[MATRIX]
        if m[1] or m[4]:
            raise ValueError(f"{path}: rotated rasters are not supported")
        x0, dx, y0, dy = m[3], m[0], m[7], m[5]
    elif SCALE in t and TIE in t:
        dx, dy = t[SCALE][0], -t[SCALE][1]
        x0, y0 = t[TIE][3] - t[TIE][0] * dx, t[TIE][4] - t[TIE][1] * dy
    else:
        x0, dx, y0, dy = 0.0, 1.0, 0.0, -1.0
    epsg = None
    keys = t.get(KEYS, ())
    for k in range(4, len(keys), 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0 and keys[k + 3] not in (0, 32767):
            epsg = f"EPSG:{keys[k + 3]}"
    nodata = float(t[NODATA][0]) if NODATA in t and t[NODATA][0].strip() else None
    return {"x0": float(x0), "dx": float(dx), "y0": float(y0), "dy": float(dy), "width": t[WIDTH][0], "height": t[HEIGHT][0], "n_bands": t.get(SAMPLES, (1,))[0], "nodata": nodata, "epsg": epsg, "wkt": None}


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, widened one code early."""
    out, table, width, hold, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        hold, bits = hold << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = hold >> bits
            hold &= (1 << bits) - 1
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
                width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
            last = entry
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


class Chunks(InputPartition):
    """Strips or tiles, by number."""

    def __init__(self, places: list[int]):
        self.places = places


class TiffReader(DataSourceReader):
    def __init__(self, path: str, group: int):
        self.path, self.group = path, group
        self.order, self.tags = tiff_tags(path)
        t = self.tags
        self.width, self.height, self.bands = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
        self.planes = self.bands if t.get(PLANAR, (1,))[0] == 2 else 1
        if TILES in t:
            self.offsets, self.counts, self.w, self.h = t[TILES], t[TILE_COUNTS], t[TILE_WIDTH][0], t[TILE_HEIGHT][0]
        else:
            self.offsets, self.counts, self.w, self.h = t[STRIPS], t[COUNTS], self.width, min(t.get(ROWS, (self.height,))[0], self.height)
        self.across = -(-self.width // self.w)
        self.places = self.across * -(-self.height // self.h)
        self.window = {"row": (0, self.height - 1), "col": (0, self.width - 1)}
        bits, form = t.get(BITS, (1,))[0], t.get(FORMAT, (1,))[0]
        self.kind = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Narrows the window of rows and columns; Spark still applies all filters to what the strips and tiles in it hold."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("row",), ("col",)):
                low, high = self.window[f.attribute[0]]
                values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
                if isinstance(f, (EqualTo, EqualNullSafe, In)):
                    low, high = (max(low, min(values)), min(high, max(values))) if values else (1, 0)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                else:
                    high = min(high, f.value - isinstance(f, LessThan))
                self.window[f.attribute[0]] = low, high
            yield f

    def partitions(self) -> list[Chunks]:
        (top, bottom), (left, right) = self.window["row"], self.window["col"]
        rows = range(max(0, top // self.h), min(-(-self.height // self.h), bottom // self.h + 1)) if top <= bottom else range(0)
        cols = range(max(0, left // self.w), min(self.across, right // self.w + 1)) if left <= right else range(0)
        places = [r * self.across + c for r in rows for c in cols]
        return [Chunks(places[k : k + self.group]) for k in range(0, len(places), self.group)] or [Chunks([])]

    def block(self, k: int) -> np.ndarray:
        """(rows, columns, samples) of a strip or tile."""
        t = self.tags
        with open(self.path, "rb") as f:
            f.seek(self.offsets[k])
            data = f.read(self.counts[k])
        how = t.get(COMPRESSION, (1,))[0]
        if how in (8, 32946):
            data = zlib.decompress(data)
        elif how == 5:
            data = unlzw(data)
        elif how == 32773:
            data = unpackbits(data)
        elif how != 1:
            raise OSError(f"{self.path}: compression {how} isn't read")
        samples = 1 if self.planes > 1 else self.bands
        rows = len(data) // (self.w * samples * self.kind.itemsize)
        predictor = t.get(PREDICTOR, (1,))[0]
        if predictor == 3:
            raw = np.cumsum(np.frombuffer(data, np.uint8)[: rows * self.w * samples * self.kind.itemsize].reshape(rows, self.w * self.kind.itemsize, samples), axis=1, dtype=np.uint8)
            raw = raw.reshape(rows, self.kind.itemsize, self.w * samples).transpose(0, 2, 1)
            return np.ascontiguousarray(raw).view(self.kind.newbyteorder(">")).reshape(rows, self.w, samples)
        a = np.frombuffer(data, self.kind, rows * self.w * samples).reshape(rows, self.w, samples)
        return np.cumsum(a, axis=1, dtype=self.kind.newbyteorder("=")) if predictor == 2 else a

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        nodata = float(self.tags[NODATA][0]) if NODATA in self.tags and self.tags[NODATA][0].strip() else None
        for k in partition.places:
            parts = [self.block(k + p * self.places) for p in range(self.planes)]
            a = np.concatenate(parts, axis=2).astype(float)
            r, c = np.mgrid[: a.shape[0], : self.w]
            r, c = r + k // self.across * self.h, c + k % self.across * self.w
            there = (r < self.height) & (c < self.width)
            columns = [pa.array(r[there].astype(np.int32)), pa.array(c[there].astype(np.int32))]
            for b in range(self.bands):
                v = a[:, :, b][there]
                columns.append(pa.array(v, mask=np.isnan(v) | (v == nodata if nodata is not None else False)))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "col", *(f"b{b + 1}" for b in range(self.bands))])


class GeoTiff(DataSource):
    """format("geotiff"), options path and group (strips or tiles for each task).  The file must be where all tasks see it."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        bands = tiff_tags(self.options["path"])[1].get(SAMPLES, (1,))[0]
        return "row int, col int, " + ", ".join(f"b{b + 1} double" for b in range(bands))

    def reader(self, schema) -> TiffReader:  # noqa: ANN001
        return TiffReader(self.options["path"], int(self.options.get("group", "16")))


def window(grid: DataFrame, meta: dict, box: tuple[float, float, float, float]) -> DataFrame:
    """The cells of ``grid`` that meet a box (xmin, ymin, xmax, ymax): a range of rows and columns, which the source takes."""
    cols = sorted((x - meta["x0"]) / meta["dx"] for x in (box[0], box[2]))
    rows = sorted((y - meta["y0"]) / meta["dy"] for y in (box[1], box[3]))
    inside = lambda c, ends: F.col(c).between(math.floor(ends[0]), math.floor(ends[1]))
    return grid.where(inside("row", rows) & inside("col", cols))


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(pixels, meta), by the file's ending."""
    ending = os.path.splitext(path)[1].lower()
    if ending == ".asc":
        return read_ascii_grid(spark, path)
    if ending in (".tif", ".tiff"):
        meta = tiff_meta(path)
        spark.dataSource.register(GeoTiff)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters is refused without it
        return spark.read.format("geotiff").load(path), meta
    raise ValueError(f"{path}: rasters are .asc or .tif")
