"""WGS84 to and from S-JTSK / Krovak East North (EPSG:5514), by the published formulas.

The formulas are NumPy; ``to_plane`` applies them to Arrow batches (as Columns their expression
tree would repeat every shared term and take the code generator minutes).
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

M = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, sqrt=np.sqrt, pow=np.power)

# The ellipsoids, the datum shift (metres, arc seconds, ppm) and the projection's constants.
WGS = (6378137.0, 1 / 298.257223563)
BESSEL = (6377397.155, 1 / 299.1528128)
SHIFT = (570.8, 85.7, 462.8)
TURN = (4.998, 1.587, 5.261)
SCALE = 3.56e-6
LAT_C, LON_0 = math.radians(49.5), math.radians(24 + 50 / 60)
AZIMUTH, PARALLEL, FACTOR = math.radians(30 + 17 / 60 + 17.30311 / 3600), math.radians(78.5), 0.9999

_a, _f = BESSEL
_e2 = 2 * _f - _f * _f
_e = math.sqrt(_e2)
_A = _a * math.sqrt(1 - _e2) / (1 - _e2 * math.sin(LAT_C) ** 2)
_B = math.sqrt(1 + _e2 * math.cos(LAT_C) ** 4 / (1 - _e2))
_g = math.asin(math.sin(LAT_C) / _B)
_t0 = math.tan(math.pi / 4 + _g / 2) * ((1 + _e * math.sin(LAT_C)) / (1 - _e * math.sin(LAT_C))) ** (_e * _B / 2) / math.tan(math.pi / 4 + LAT_C / 2) ** _B
_n = math.sin(PARALLEL)
_r0 = FACTOR * _A / math.tan(PARALLEL)


def _geocentric(m, lat, lon, ellipsoid):
    a, f = ellipsoid
    e2 = 2 * f - f * f
    v = a / m.sqrt(1 - m.sin(lat) * m.sin(lat) * e2)
    return v * m.cos(lat) * m.cos(lon), v * m.cos(lat) * m.sin(lon), v * (1 - e2) * m.sin(lat)


def _geodetic(m, x, y, z, ellipsoid):
    a, f = ellipsoid
    e2 = 2 * f - f * f
    b = a * (1 - f)
    p = m.sqrt(x * x + y * y)
    u = m.atan2(z * a, p * b)
    return m.atan2(z + m.sin(u) * m.sin(u) * m.sin(u) * (e2 / (1 - e2) * b), p - m.cos(u) * m.cos(u) * m.cos(u) * (e2 * a)), m.atan2(y, x)


def _turned(x, y, z, sign):
    rx, ry, rz = (sign * math.radians(r / 3600) for r in TURN)
    return (x - y * rz + z * ry), (x * rz + y - z * rx), (y * rx - x * ry + z)


def project(m, lat, lon):
    """Bessel latitude and longitude (radians) to easting and northing."""
    s = m.sin(lat) * _e
    u = (m.atan(m.pow(m.tan(lat / 2 + math.pi / 4), _B) * _t0 / m.pow((1 + s) / (1 - s), _e * _B / 2)) - math.pi / 4) * 2
    v = (LON_0 - lon) * _B
    t = m.asin(m.sin(u) * math.cos(AZIMUTH) + m.cos(u) * m.cos(v) * math.sin(AZIMUTH))
    d = m.asin(m.cos(u) * m.sin(v) / m.cos(t)) * _n
    r = _r0 * math.tan(math.pi / 4 + PARALLEL / 2) ** _n / m.pow(m.tan(t / 2 + math.pi / 4), _n)
    return -(r * m.sin(d)), -(r * m.cos(d))


def unproject(m, e, n):
    r, d = m.sqrt(e * e + n * n), m.atan2(-e, -n) / _n
    t = (m.atan(m.pow(_r0 / r, 1 / _n) * math.tan(math.pi / 4 + PARALLEL / 2)) - math.pi / 4) * 2
    u = m.asin(m.sin(t) * math.cos(AZIMUTH) - m.cos(t) * m.cos(d) * math.sin(AZIMUTH))
    v = m.asin(m.cos(t) * m.sin(d) / m.cos(u))
    lat = u
    for _ in range(4):
        s = m.sin(lat) * _e
        lat = (m.atan(m.pow(m.tan(u / 2 + math.pi / 4), 1 / _B) * _t0 ** (-1 / _B) * m.pow((1 + s) / (1 - s), _e / 2)) - math.pi / 4) * 2
    return lat, LON_0 - v / _B


def _forward(m, lat, lon):
    x, y, z = _geocentric(m, lat, lon, WGS)
    x, y, z = _turned((x - SHIFT[0]) / (1 + SCALE), (y - SHIFT[1]) / (1 + SCALE), (z - SHIFT[2]) / (1 + SCALE), -1)
    return project(m, *_geodetic(m, x, y, z, BESSEL))


def to_plane(lat: Column, lon: Column) -> Column:
    """Degrees to metres: struct<x, y>, null where a coordinate is."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = to_plane_np(a, b)
        return pd.DataFrame({"x": x, "y": y})

    ok = lat.isNotNull() & lon.isNotNull()
    return F.when(ok, F.pandas_udf(run, "x double, y double")(lat, lon))


def to_plane_np(lat, lon):
    return _forward(M, np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float)))


def to_degrees_np(e, n):
    x, y, z = _geocentric(M, *unproject(M, np.asarray(e, float), np.asarray(n, float)), BESSEL)
    x, y, z = (v * (1 + SCALE) + s for v, s in zip(_turned(x, y, z, 1), SHIFT, strict=True))
    lat, lon = _geodetic(M, x, y, z, WGS)
    return np.degrees(lat), np.degrees(lon)
