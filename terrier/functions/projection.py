"""Lambert-93 (EPSG:2154) to and from longitude and latitude, as column expressions.

Lambert conformal conic with two standard parallels (Snyder, USGS Professional
Paper 1395, chapter 15) on the GRS80 ellipsoid. WGS84 and RGF93 count as equal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 and the definition of EPSG:2154.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
ORIGIN_LAT, ORIGIN_LON = 46.5, 3.0
PARALLEL_1, PARALLEL_2 = 44.0, 49.0
FALSE_EASTING, FALSE_NORTHING = 700000.0, 6600000.0

_F = 1 / INVERSE_FLATTENING
ECC = math.sqrt(_F * (2 - _F))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (ECC * math.sin(lat)) ** 2)


def _t(lat: float) -> float:
    s = ECC * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (ECC / 2)


_LAT1, _LAT2, _LAT0 = (math.radians(d) for d in (PARALLEL_1, PARALLEL_2, ORIGIN_LAT))
CONE = (math.log(_m(_LAT1)) - math.log(_m(_LAT2))) / (math.log(_t(_LAT1)) - math.log(_t(_LAT2)))
SCALE = SEMI_MAJOR * _m(_LAT1) / (CONE * _t(_LAT1) ** CONE)
RHO_0 = SCALE * _t(_LAT0) ** CONE


def to_lambert(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of a point in degrees."""
    phi = F.radians(lat)
    s = F.sin(phi) * ECC
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(ECC / 2))
    rho = F.pow(t, F.lit(CONE)) * SCALE
    theta = F.radians(lon - ORIGIN_LON) * CONE
    return rho * F.sin(theta) + FALSE_EASTING, FALSE_NORTHING + RHO_0 - rho * F.cos(theta)


def from_lambert(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a point in metres."""
    dx, dy = x - FALSE_EASTING, F.lit(RHO_0 + FALSE_NORTHING) - y
    theta = F.atan2(dx, dy)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / SCALE, F.lit(1 / CONE))
    # a closed series, not the usual iteration, whose nesting would grow the expression
    chi = F.lit(math.pi / 2) - F.atan(t) * 2
    return F.degrees(theta / CONE) + ORIGIN_LON, F.degrees(_geodetic(chi))


def _geodetic(chi: Column) -> Column:
    """Geodetic from conformal latitude: the series of Snyder (3-5), to order e^8."""
    e2 = ECC * ECC
    a = e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360
    b = 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520
    c = 7 * e2**3 / 120 + 81 * e2**4 / 1120
    d = 4279 * e2**4 / 161280
    return (chi + F.sin(chi * 2) * a + F.sin(chi * 4) * b + F.sin(chi * 6) * c
            + F.sin(chi * 8) * d)
