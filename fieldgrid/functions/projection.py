"""UTM in column expressions (Krueger series to sixth order, WGS 84), so points are reprojected in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLATTENING, K0, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_n = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Coefficients of the published series in the third flattening.
ALPHA = [
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
]
BETA = [
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
]


class ProjectionError(ValueError):
    """The pair of reference systems isn't supported."""


def utm_zone(srid: int) -> tuple[int, bool]:
    """(zone, south) of a WGS 84 UTM code."""
    if 32601 <= srid <= 32660 or 32701 <= srid <= 32760:
        return srid % 100, srid >= 32700
    raise ProjectionError(f"EPSG:{srid} is no WGS 84 UTM zone")


def _central(zone: int) -> int:
    """Degrees; taken off before the turn to radians, so near the meridian no digits go."""
    return zone * 6 - 183


def _conformal(s: Column) -> Column:
    """From the sine of the latitude to the tangent of the conformal latitude."""
    return F.sinh(F.atanh(s) - _E * F.atanh(_E * s))


def _sphere(t: Column, lam: Column) -> tuple[Column, Column]:
    """Northing and easting on the sphere (xi, eta)."""
    return F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))


def _series(terms: list[float], xi: Column, eta: Column) -> tuple[Column, Column]:
    north, east = xi, eta
    for j, a in enumerate(terms, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return north, east


def _metres(north: Column, east: Column, south: bool) -> tuple[Column, Column]:
    return FALSE_EAST + K0 * RADIUS * east, (FALSE_NORTH if south else 0.0) + K0 * RADIUS * north


def _unscaled(x: Column, y: Column, south: bool) -> tuple[Column, Column]:
    return (y - (FALSE_NORTH if south else 0.0)) / (K0 * RADIUS), (x - FALSE_EAST) / (K0 * RADIUS)


def _latitude(chi: Column) -> Column:
    """The conformal latitude inverted by fixed-point steps, each of which gains about two digits and a half."""
    phi = chi
    for _ in range(6):
        phi = F.asin(F.tanh(F.atanh(F.sin(chi)) + _E * F.atanh(_E * F.sin(phi))))
    return phi


def to_utm(lon: Column, lat: Column, srid: int) -> tuple[Column, Column]:
    zone, south = utm_zone(srid)
    xi, eta = _sphere(_conformal(F.sin(F.radians(lat))), F.radians(lon - _central(zone)))
    return _metres(*_series(ALPHA, xi, eta), south)


def from_utm(x: Column, y: Column, srid: int) -> tuple[Column, Column]:
    zone, south = utm_zone(srid)
    xi, eta = _series([-b for b in BETA], *_unscaled(x, y, south))
    lon = _central(zone) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    return lon, F.degrees(_latitude(F.asin(F.sin(xi) / F.cosh(eta))))


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Between WGS 84 longitude/latitude and UTM zones; equal systems pass through."""
    if source == target:
        return x, y
    lon, lat = (x, y) if source == 4326 else from_utm(x, y, source)
    return (lon, lat) if target == 4326 else to_utm(lon, lat, target)


def widest(source: int, target: int) -> float:
    """At most how many target units a source unit's half square reaches from its centre, corners and stretch included."""
    if source == target:
        return 1.0
    if 4326 in (source, target):
        if target == 4326:
            raise ProjectionError("rasters are resampled onto projected grids")
        return 111_700.0 * 1.5  # metres a degree along the meridian, at most
    apart = abs(utm_zone(source)[0] - utm_zone(target)[0])
    if min(apart, 60 - apart) > 2:
        raise ProjectionError(f"EPSG:{source} and EPSG:{target} are more than two zones apart")
    return 1.5


def with_projected(df: DataFrame, x: str, y: str, source: int, target: int) -> DataFrame:
    """df with the columns x and y in the target system.

    The same arithmetic as ``reproject``, but every intermediate value is a column of its own and the result comes out of
    a generator: a filter on it can't be pushed below, which would put the formulas into one another and grow them to
    millions of nodes."""
    if source == target:
        return df
    old = df.columns

    def step(a: Column, b: Column) -> None:
        nonlocal df
        df = df.withColumns({"_pa": a, "_pb": b})

    a, b = F.col("_pa"), F.col("_pb")
    step(F.col(x), F.col(y))
    if source != 4326:
        zone, south = utm_zone(source)
        step(*_unscaled(a, b, south))
        step(*_series([-k for k in BETA], a, b))
        step(F.atan2(F.sinh(b), F.cos(a)), F.asin(F.sin(a) / F.cosh(b)))
        step(_central(zone) + F.degrees(a), F.degrees(_latitude(b)))
    if target != 4326:
        zone, south = utm_zone(target)
        step(F.sin(F.radians(b)), F.radians(a - _central(zone)))
        step(_conformal(a), b)
        step(*_sphere(a, b))
        step(*_series(ALPHA, a, b))
        step(*_metres(a, b, south))
    kept = [c for c in old if c not in (x, y)]
    return df.select(*kept, F.inline(F.array(F.struct(a.alias(x), b.alias(y))))).select(*old)
