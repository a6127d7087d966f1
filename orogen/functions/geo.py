"""Scalar functions: sun, calendar, tile names, labels, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0


def sun_elevation_sine(day: Column, hour: Column, latitude: Column) -> Column:
    decl = F.radians(23.45 * F.sin(F.radians(F.lit(360.0) / 365.0 * (day + 284))))
    lat, turn = F.radians(latitude), F.radians(15.0 * (hour - 12.0))
    return F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(turn)


def sun_position(day: Column, hour: Column, latitude: Column) -> tuple[Column, Column]:
    """Azimuth (clockwise from north) and elevation of the sun, in radians."""
    decl = F.radians(23.45 * F.sin(F.radians(F.lit(360.0) / 365.0 * (day + 284))))
    lat = F.radians(latitude)
    sine = sun_elevation_sine(day, hour, latitude)
    elevation = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))
    cosine = (F.sin(decl) - sine * F.sin(lat)) / (F.cos(elevation) * F.cos(lat))
    azimuth = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    azimuth = F.when(hour > 12.0, 2 * math.pi - azimuth).otherwise(azimuth)
    return F.when(F.cos(elevation) < 1e-6, 0.0).otherwise(azimuth), elevation


def sun_direction(azimuth: float, elevation: float) -> tuple[float, float, float]:
    return math.cos(elevation) * math.sin(azimuth), -math.cos(elevation) * math.cos(azimuth), math.sin(elevation)


def wrapped_day(day: Column) -> Column:
    return F.pmod(day - 1, F.lit(365)) + 1


def wrapped_hour(hour: Column) -> Column:
    return F.pmod(hour, F.lit(24))


def calendar_label(day: Column) -> Column:
    """Month and day of a day of a 365-day year, clamped to 1 .. 365."""
    clamped = F.greatest(F.lit(1), F.least(F.lit(365), day)).cast("int")
    return F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), clamped - 1), "MMM d")


def clock_label(hour: Column) -> Column:
    return F.format_string("Time: %02d:%02d", F.floor(hour), F.floor((hour - F.floor(hour)) * 60))


def season(day: Column) -> Column:
    """Season by days after day 172: 93, 183 and 273 days end summer, autumn and winter."""
    after = F.pmod(day - 172, F.lit(365))
    return F.when(after < 93, "summer").when(after < 183, "autumn").when(after < 273, "winter").otherwise("spring")


def tile_path(latitude: Column, longitude: Column) -> Column:
    name = F.format_string("Copernicus_DSM_COG_10_N%02d_00_E%03d_00_DEM", latitude, longitude)
    return F.concat(name, F.lit("/"), name, F.lit(".tif"))


def tile_corner(path: Column) -> tuple[Column, Column]:
    """Northing and easting in the name of a 50 km tile, null for other names."""
    pattern = r"CRS3035RES50000mN(\d+)E(\d+)\.tif$"
    return tuple(F.regexp_extract(path, pattern, k).try_cast("long") for k in (1, 2))


def size_label(size: Column) -> Column:
    gb, mb, kb = 1 << 30, 1 << 20, 1 << 10
    return F.when(size >= gb, F.format_string("%.1f GB", size / float(gb))).when(size >= mb, F.format_string("%d MB", F.floor(size / mb))).otherwise(F.format_string("%d KB", F.floor(size / kb)))


def degrees_to_metres(degrees_x: Column, latitude: Column) -> Column:
    return METRES_PER_DEGREE * degrees_x * F.cos(F.radians(latitude))


# ETRS89 / LAEA Europe: published constants of GRS 80 and EPSG:3035 (fixed values)
_A, _F = 6378137.0, 1 / 298.257222101
_LAT0, _LON0, _FE, _FN = math.radians(52), math.radians(10), 4321000.0, 3210000.0
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(s):
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


_QP, _Q0 = _q(1.0), _q(math.sin(_LAT0))
_B0, _RQ = math.asin(_Q0 / _QP), _A * math.sqrt(_QP / 2)
_D = _A * math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) / (_RQ * math.cos(_B0))


def to_laea(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Easting and northing in EPSG:3035 of WGS 84 degrees."""
    s = F.sin(F.radians(latitude))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    beta, turn = F.asin(q / _QP), F.radians(longitude) - _LON0
    b = _RQ * F.sqrt(F.lit(2.0) / (1 + math.sin(_B0) * F.sin(beta) + math.cos(_B0) * F.cos(beta) * F.cos(turn)))
    return _FE + b * _D * F.cos(beta) * F.sin(turn), _FN + b / _D * (math.cos(_B0) * F.sin(beta) - math.sin(_B0) * F.cos(beta) * F.cos(turn))


def from_laea(e: Column, n: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of EPSG:3035 coordinates."""
    x, y = (e - _FE) / _D, (n - _FN) * _D
    rho = F.greatest(F.sqrt(x * x + y * y), F.lit(1e-12))
    c = 2 * F.asin(rho / (2 * _RQ))
    beta = F.asin(F.cos(c) * math.sin(_B0) + y * F.sin(c) * math.cos(_B0) / rho)
    lon = _LON0 + F.atan2(x * F.sin(c), rho * math.cos(_B0) * F.cos(c) - y * math.sin(_B0) * F.sin(c))
    e4, e6 = _E2**2, _E2**3
    lat = beta + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.degrees(lat), F.degrees(lon)
