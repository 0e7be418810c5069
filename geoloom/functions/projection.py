"""Transverse Mercator (UTM) by Krueger's series, as Python and as Column expressions.

Public formulas (Krueger 1912; the n-series to fourth order), accurate to well
under a millimetre inside a zone. `EPSG:4326` passes through; `EPSG:3857` is the
spherical web Mercator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 ellipsoid and UTM constants. Fixed values.
A_AXIS, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A_AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


class _Maths:
    """The functions both forms need, over floats."""

    sin, cos, tan, asin, atan, atan2, sinh, cosh, exp, log, sqrt, radians, degrees = math.sin, math.cos, math.tan, math.asin, math.atan, math.atan2, math.sinh, math.cosh, math.exp, math.log, math.sqrt, math.radians, math.degrees
    atanh = math.atanh


class _Columns:
    """The same over Columns."""

    sin, cos, tan, asin, atan, atan2, sinh, cosh, exp, log, sqrt, radians, degrees = F.sin, F.cos, F.tan, F.asin, F.atan, F.atan2, F.sinh, F.cosh, F.exp, F.log, F.sqrt, F.radians, F.degrees
    atanh = F.atanh


def zone_of(crs: str) -> tuple[float, float]:
    """Central meridian and false northing of a UTM code."""
    code = int(crs.split(":")[1])
    if not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"not a UTM zone: {crs}")
    return (code % 100) * 6 - 183.0, FALSE_NORTH if code > 32700 else 0.0


def _forward(m, lon, lat, crs: str):
    if crs == "EPSG:4326":
        return lon, lat
    if crs == "EPSG:3857":
        return m.radians(lon) * A_AXIS, m.log(m.tan(m.radians(lat) / 2 + math.pi / 4)) * A_AXIS
    meridian, north = zone_of(crs)
    phi, lam = m.radians(lat), m.radians(lon - meridian)
    root = 2 * math.sqrt(N) / (1 + N)
    s = m.sin(phi)
    t = m.sinh(m.atanh(s) - root * m.atanh(root * s))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    east, north_part = eta, xi
    for k, a in enumerate(ALPHA, 1):
        east = east + a * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
        north_part = north_part + a * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
    return east * (SCALE * RECTIFYING) + FALSE_EAST, north_part * (SCALE * RECTIFYING) + north


def _inverse(m, x, y, crs: str):
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:3857":
        return m.degrees(x / A_AXIS), m.degrees(m.atan(m.exp(y / A_AXIS)) * 2 - math.pi / 2)
    meridian, north = zone_of(crs)
    xi, eta = (y - north) / (SCALE * RECTIFYING), (x - FALSE_EAST) / (SCALE * RECTIFYING)
    xi1, eta1 = xi, eta
    for k, b in enumerate(BETA, 1):
        xi1 = xi1 - b * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
        eta1 = eta1 - b * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
    chi = m.asin(m.sin(xi1) / m.cosh(eta1))
    phi = chi
    for k, d in enumerate(DELTA, 1):
        phi = phi + d * m.sin(2 * k * chi)
    return m.degrees(m.atan2(m.sinh(eta1), m.cos(xi1))) + meridian, m.degrees(phi)


def project(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """x and y in `crs` of a longitude and latitude."""
    return _forward(_Columns, lon, lat, crs)


def unproject(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """Longitude and latitude of x and y in `crs`."""
    return _inverse(_Columns, x, y, crs)


def project_point(lon: float, lat: float, crs: str) -> tuple[float, float]:
    return _forward(_Maths, lon, lat, crs)


def unproject_point(x: float, y: float, crs: str) -> tuple[float, float]:
    return _inverse(_Maths, x, y, crs)


def project_bounds(bounds: tuple[float, float, float, float], crs: str, points: int = 21) -> tuple[float, float, float, float]:
    """Bounds in `crs` of a WGS84 box whose edges are traced with `points` points each."""
    west, south, east, north = bounds
    steps = [k / (points - 1) for k in range(points)]
    edge = [(west + (east - west) * s, v) for s in steps for v in (south, north)] + [(v, south + (north - south) * s) for s in steps for v in (west, east)]
    xy = [project_point(*p, crs) for p in edge]
    return min(p[0] for p in xy), min(p[1] for p in xy), max(p[0] for p in xy), max(p[1] for p in xy)


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG number of the UTM zone, as an expression."""
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")
