"""Coordinates of EPSG:4326, 3035 and 31287 to and from WGS 84, by published formulas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orogen.functions.geo import from_laea, to_laea

# Bessel 1841 and WGS 84, the Austrian Lambert projection, and the shift of its datum (position vector).
_BESSEL, _WGS84 = (6377397.155, 1 / 299.1528128), (6378137.0, 1 / 298.257223563)
_LAT0, _LON0, _LAT1, _LAT2, _FE, _FN = math.radians(47.5), math.radians(13 + 1 / 3), math.radians(49), math.radians(46), 400000.0, 400000.0
_SHIFT = (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232)


def _e2(ellipsoid: tuple[float, float]) -> float:
    return ellipsoid[1] * (2 - ellipsoid[1])


def _geocentric(lat, lon, ellipsoid: tuple[float, float]):
    n = ellipsoid[0] / np.sqrt(1 - _e2(ellipsoid) * np.sin(lat) ** 2)
    return n * np.cos(lat) * np.cos(lon), n * np.cos(lat) * np.sin(lon), n * (1 - _e2(ellipsoid)) * np.sin(lat)


def _geodetic(x, y, z, ellipsoid: tuple[float, float]):
    """Latitude (after Bowring, exact to far below a millimetre on the ground) and longitude in radians."""
    a, e2 = ellipsoid[0], _e2(ellipsoid)
    b = a * (1 - ellipsoid[1])
    p = np.hypot(x, y)
    t = np.arctan2(z * a, p * b)
    return np.arctan2(z + e2 / (1 - e2) * b * np.sin(t) ** 3, p - e2 * a * np.cos(t) ** 3), np.arctan2(y, x)


def _shifted(x, y, z, back: bool):
    """Bessel to WGS 84 coordinates by seven parameters, or back."""
    tx, ty, tz = _SHIFT[:3]
    rx, ry, rz = (math.radians(v / 3600) for v in _SHIFT[3:6])
    turn = (1 + _SHIFT[6] * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])
    at = np.stack([x, y, z])
    move = np.array([[tx], [ty], [tz]])
    return tuple(np.linalg.solve(turn, at - move) if back else turn @ at + move)


def _t(lat, e: float):
    return np.tan(math.pi / 4 - lat / 2) / ((1 - e * np.sin(lat)) / (1 + e * np.sin(lat))) ** (e / 2)


_E = math.sqrt(_e2(_BESSEL))
_M1, _M2 = (math.cos(x) / math.sqrt(1 - _e2(_BESSEL) * math.sin(x) ** 2) for x in (_LAT1, _LAT2))
_N = (math.log(_M1) - math.log(_M2)) / (math.log(_t(_LAT1, _E)) - math.log(_t(_LAT2, _E)))
_G = _M1 / (_N * _t(_LAT1, _E) ** _N)
_R0 = _BESSEL[0] * _G * _t(_LAT0, _E) ** _N


def to_lambert(lat, lon):
    """Easting and northing in the Austrian Lambert projection of radians on its own datum."""
    r, turn = _BESSEL[0] * _G * _t(lat, _E) ** _N, _N * (lon - _LON0)
    return _FE + r * np.sin(turn), _FN + _R0 - r * np.cos(turn)


def from_lambert(e, n):
    x, y = e - _FE, _R0 - (n - _FN)
    t = (np.hypot(x, y) / (_BESSEL[0] * _G)) ** (1 / _N)
    lat = math.pi / 2 - 2 * np.arctan(t)
    for _ in range(8):  # converges by a factor of 150 each time
        lat = math.pi / 2 - 2 * np.arctan(t * ((1 - _E * np.sin(lat)) / (1 + _E * np.sin(lat))) ** (_E / 2))
    return lat, np.arctan2(x, y) / _N + _LON0


# the datum shift chains too many terms for a column expression, so it runs on Arrow batches
def _austrian(latitude: pd.Series, longitude: pd.Series) -> pd.DataFrame:
    xyz = _shifted(*_geocentric(np.radians(latitude.to_numpy(float)), np.radians(longitude.to_numpy(float)), _WGS84), back=True)
    return pd.DataFrame(dict(zip("xy", to_lambert(*_geodetic(*xyz, _BESSEL)), strict=True)))


def _from_austrian(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    lat, lon = _geodetic(*_shifted(*_geocentric(*from_lambert(x.to_numpy(float), y.to_numpy(float)), _BESSEL), back=False), _WGS84)
    return pd.DataFrame({"x": np.degrees(lat), "y": np.degrees(lon)})


def from_wgs84(latitude: Column, longitude: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing (longitude and latitude for 4326) of WGS 84 degrees."""
    if epsg == 4326:
        return longitude, latitude
    if epsg == 3035:
        return to_laea(latitude, longitude)
    if epsg == 31287:
        both = F.pandas_udf(_austrian, "x double, y double")(latitude, longitude)
        return both["x"], both["y"]
    raise ValueError(f"no projection for EPSG:{epsg}")


def to_wgs84(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Latitude and longitude in WGS 84 degrees."""
    if epsg == 4326:
        return y, x
    if epsg == 3035:
        return from_laea(x, y)
    if epsg == 31287:
        both = F.pandas_udf(_from_austrian, "x double, y double")(x, y)
        return both["x"], both["y"]
    raise ValueError(f"no projection for EPSG:{epsg}")


def origin_in_base(e: Column, n: Column, epsg: int, base_epsg: int, base_x: float, base_y: float) -> tuple[Column, Column]:
    """Where the corner of a fine tier lies on the base: metres east and south of its corner."""
    x, y = from_wgs84(*to_wgs84(e, n, epsg), base_epsg)
    return x - base_x, base_y - y
