"""Reprojection between geographic WGS 84, Web Mercator and UTM zones, by published series (no other pairs)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# Semi-major axis and flattening of WGS 84, and the scale of UTM on its central meridian.
A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of Krueger's series up to the fourth power of the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_E = np.sqrt(FLATTENING * (2 - FLATTENING))


class UnsupportedCRS(ValueError):
    """A coordinate system that this library has no formulas for."""


def _zone(epsg: int) -> tuple[float, float]:
    """(central meridian, false northing) of a UTM zone."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return np.radians(epsg % 100 * 6 - 183.0), 0.0 if epsg < 32700 else 1e7
    raise UnsupportedCRS(f"EPSG:{epsg}")


def from_geographic(epsg: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Degrees of longitude and latitude to the system's x and y."""
    if epsg == 4326:
        return lambda lon, lat: (lon, lat)
    if epsg == 3857:
        return lambda lon, lat: (A * np.radians(lon), A * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)))
    meridian, north = _zone(epsg)

    def forward(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, d = np.sin(np.radians(lat)), np.radians(lon) - meridian
        t = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s))
        xi, eta = np.arctan2(t, np.cos(d)), np.arcsinh(np.sin(d) / np.hypot(t, np.cos(d)))
        x, y = eta.copy(), xi.copy()
        for j, a in enumerate(_ALPHA, 1):
            x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return 500000 + K0 * _RADIUS * x, north + K0 * _RADIUS * y

    return forward


def to_geographic(epsg: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    if epsg == 4326:
        return lambda x, y: (x, y)
    if epsg == 3857:
        return lambda x, y: (np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - np.pi / 2))
    meridian, north = _zone(epsg)

    def inverse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xi, eta = (y - north) / (K0 * _RADIUS), (x - 500000) / (K0 * _RADIUS)
        p, q = xi.copy(), eta.copy()
        for j, b in enumerate(_BETA, 1):
            p -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            q -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        target = np.arcsinh(np.sin(p) / np.hypot(np.sinh(q), np.cos(p)))  # isometric latitude
        s = np.tanh(target)
        for _ in range(8):
            s = np.tanh(target + _E * np.arctanh(_E * s))
        return np.degrees(meridian + np.arctan2(np.sinh(q), np.cos(p))), np.degrees(np.arcsin(s))

    return inverse


def code(epsg: str | int) -> int:
    try:
        return int(str(epsg).upper().removeprefix("EPSG:"))
    except ValueError as e:
        raise UnsupportedCRS(str(epsg)) from e


def reproject(x: np.ndarray, y: np.ndarray, source: str | int, target: str | int) -> tuple[np.ndarray, np.ndarray]:
    return from_geographic(code(target))(*to_geographic(code(source))(np.asarray(x, float), np.asarray(y, float)))


POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
GEOMETRY = ArrayType(ArrayType(ArrayType(POINT)))


def reprojected(g: Column, source: str | int, target: str | int) -> Column:
    """A geometry column in another system; nulls stay null."""
    from_geographic(code(target)), to_geographic(code(source))  # unsupported systems fail here

    @F.pandas_udf(GEOMETRY)
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for geometry in s:
                if geometry is None:
                    out.append(None)
                    continue
                polygons = []
                for polygon in geometry:
                    rings = []
                    for ring in polygon:
                        x, y = reproject(np.array([p["x"] for p in ring]), np.array([p["y"] for p in ring]), source, target)
                        rings.append([{"x": a, "y": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)])
                    polygons.append(rings)
                out.append(polygons)
            yield pd.Series(out, dtype=object)

    return convert(g)


def aligned(objects: DataFrame, epsg: str | None, raster_epsg: str | None, polygons: str = "polygons") -> DataFrame:
    """``objects`` in the raster's system; as they are if the codes are equal."""
    if epsg is None or raster_epsg is None:
        raise UnsupportedCRS("a layer or raster without a coordinate system")
    return objects if code(epsg) == code(raster_epsg) else objects.withColumn(polygons, reprojected(F.col(polygons), epsg, raster_epsg))
