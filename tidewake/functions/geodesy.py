"""Measures and map coordinates on the WGS 84 ellipsoid, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half axis in km, flattening, and the scale and false easting and northing (km) of UTM.
A_KM, FLATTENING = 6378.137, 1 / 298.257223563
UTM_SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500.0, 10_000.0
E2 = FLATTENING * (2 - FLATTENING)
# Latitudes at which the polar maps of EPSG 3413 and 3031 are true, and the meridians that run down and up from the pole.
POLAR = {3413: (70.0, -45.0), 3031: (-71.0, 0.0)}
E = math.sqrt(E2)
#: Third flattening, and the radius of the circle whose quarter is as long as a quarter meridian.
N = FLATTENING / (2 - FLATTENING)
MERIDIAN_KM = A_KM / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Coefficients of Krueger's series, to the third power of N.
TO_GRID = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
FROM_GRID = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
FROM_CONFORMAL = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
#: Area of the ellipsoid between equator and pole over 2 pi half axes squared.
_Q_POLE = 1 + (1 - E2) / E * math.atanh(E)
#: Radius of the sphere of the same surface.
AUTHALIC_KM = A_KM * math.sqrt(_Q_POLE / 2)


def authalic(lat: Column) -> Column:
    """Latitude (radians) on the sphere of equal area."""
    s = F.sin(F.radians(lat))
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(E * s) / E) / _Q_POLE)))


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length of the geodesic by Lambert's correction of the great circle: right to some metres in a thousand kilometres."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(x))) for x in (lat1, lat2))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    h = F.pow(F.sin(q), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    arc = 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    x = (arc - F.sin(arc)) * F.pow(F.sin(p) * F.cos(q), 2) / (1 - h)
    y = (arc + F.sin(arc)) * F.pow(F.cos(p) * F.sin(q), 2) / h
    return F.when((h > 0) & (h < 1), A_KM * (arc - FLATTENING / 2 * (x + y))).otherwise(A_KM * arc)


def _legs(ring: Column, f) -> Column:
    steps = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), f)
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def ring_geodesic_km(ring: Column) -> Column:
    """Perimeter of a closed ring of (lon, lat)."""
    return _legs(ring, lambda a, b: geodesic_km(a["lat"], a["lon"], b["lat"], b["lon"]))


def ring_geodesic_km2(ring: Column) -> Column:
    """Area of a closed ring of (lon, lat): spherical excess of its legs over the equator, on the sphere of equal area."""

    def excess(a: Column, b: Column) -> Column:
        s, t = F.tan(authalic(a["lat"]) / 2), F.tan(authalic(b["lat"]) / 2)
        return 2 * F.atan2(F.tan(F.radians(b["lon"] - a["lon"]) / 2) * (s + t), 1 + s * t)

    return F.abs(_legs(ring, excess)) * AUTHALIC_KM**2


def _series(terms: tuple[float, ...], f) -> Column:
    return sum((f(k, c) for k, c in enumerate(terms, 1)), F.lit(0.0))


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres; northings of the south count from 10,000 km below the equator."""
    s, away = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(s) - E * F.atanh(E * s))
    x, y = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east = y + _series(TO_GRID, lambda k, c: c * F.cos(2 * k * x) * F.sinh(2 * k * y))
    north = x + _series(TO_GRID, lambda k, c: c * F.sin(2 * k * x) * F.cosh(2 * k * y))
    scale, base = UTM_SCALE * MERIDIAN_KM, F.when(lat < 0, FALSE_NORTH).otherwise(0.0)
    return (FALSE_EAST + scale * east) * 1000, (base + scale * north) * 1000


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of metres on the grid."""
    scale = UTM_SCALE * MERIDIAN_KM * 1000
    x, y = (north - F.when(south, FALSE_NORTH * 1000).otherwise(0.0)) / scale, (east - FALSE_EAST * 1000) / scale
    xi = x - _series(FROM_GRID, lambda k, c: c * F.sin(2 * k * x) * F.cosh(2 * k * y))
    eta = y - _series(FROM_GRID, lambda k, c: c * F.cos(2 * k * x) * F.sinh(2 * k * y))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi + _series(FROM_CONFORMAL, lambda k, c: c * F.sin(2 * k * chi))
    return F.degrees(lat), 6 * zone - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def to_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres on the web's Mercator map, a sphere of the equator's radius."""
    return 1000 * A_KM * F.radians(lon), 1000 * A_KM * F.log(F.tan(F.radians(45 + lat / 2)))


def to_polar(lat: Column, lon: Column, true_at: float, meridian: float) -> tuple[Column, Column]:
    """(x, y) in metres on the stereographic map around the pole on the side of ``true_at``, the latitude where it is true."""
    sign = 1.0 if true_at > 0 else -1.0

    def t(phi: Column) -> Column:
        s = E * F.sin(phi)
        return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2))

    true = math.radians(abs(true_at))
    s = E * math.sin(true)
    scale = 1000 * A_KM * math.cos(true) / math.sqrt(1 - s * s) / (math.tan(math.pi / 4 - true / 2) / ((1 - s) / (1 + s)) ** (E / 2))
    r, turn = scale * t(F.radians(sign * lat)), F.radians(lon - meridian)
    return r * F.sin(turn), -sign * r * F.cos(turn)


def projection(epsg: int):
    """A function of (lat, lon) to the coordinates of a reference system: degrees, web Mercator, polar stereographic, UTM on WGS 84."""
    if epsg == 4326:
        return lambda lat, lon: (lon, lat)
    if epsg == 3857:
        return to_mercator
    if epsg in POLAR:
        return lambda lat, lon: to_polar(lat, lon, *POLAR[epsg])
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:

        def utm(lat: Column, lon: Column) -> tuple[Column, Column]:
            """UTM with northings that go on below the equator, or from 10,000 km in a southern zone."""
            east, north = to_utm(F.abs(lat), lon, F.lit(epsg % 100))
            return east, F.when(lat < 0, -north).otherwise(north) + (10_000_000.0 if epsg > 32700 else 0.0)

        return utm
    raise ValueError(f"EPSG:{epsg} is not known here")
