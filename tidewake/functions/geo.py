"""Geographic column functions.  Two distances and two bearings: great-circle (anomalies) and flat (scoring)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, KM_PER_DEGREE, KNOT_KMH = 6371.0, 111.0, 1.852


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def great_circle_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """111 km per degree, longitudes scaled by the cosine of the mean latitude."""
    return F.hypot((lat2 - lat1) * KM_PER_DEGREE, (lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2)))


def flat_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """atan2 of the raw differences; longitudes are not scaled."""
    return F.pmod(F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)) + 360, F.lit(360.0))


def wrap_degrees(a: Column, b: Column) -> Column:
    """Angle between two directions, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def lerp_bearing(a: Column, b: Column, share: Column) -> Column:
    """Direction of the chord between two directions: neither linear nor spherical."""
    y = F.sin(F.radians(a)) * (1 - share) + F.sin(F.radians(b)) * share
    x = F.cos(F.radians(a)) * (1 - share) + F.cos(F.radians(b)) * share
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def box_ring(lat: Column, lon: Column, half_lat: float, half_lon: float) -> Column:
    """Closed five-vertex ring of (lon, lat) structs around a point."""
    corner = lambda sy, sx: F.struct((lon + sx * half_lon).alias("lon"), (lat + sy * half_lat).alias("lat"))
    return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1))


def ring_centroid(ring: Column) -> Column:
    """(lat, lon): the mean of a closed ring's vertices without the last."""
    open_ring = F.slice(ring, F.lit(1), F.size(ring) - 1)
    mean = lambda f: F.aggregate(open_ring, F.lit(0.0), lambda s, p: s + p[f]) / F.size(open_ring)
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over a closed ring."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area in the flat frame at the ring's first latitude."""
    scale = KM_PER_DEGREE * KM_PER_DEGREE * F.cos(F.radians(ring[0]["lat"]))
    cross = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2 * scale


def ring_length_km(ring: Column) -> Column:
    legs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, v: s + v)


def eddy_current(lat: Column, lon: Column, centre_lat: float, centre_lon: float, radius_m: float = 50_000.0, top: float = 0.5) -> tuple[Column, Column]:
    """(u, v) of a counter-clockwise eddy: speed grows with the distance from its centre, and is 0 outside."""
    dx, dy = (lon - centre_lon) * 111_000 * F.cos(F.radians(lat)), (lat - centre_lat) * 111_000
    r = F.hypot(dx, dy)
    speed, angle = F.when(r < radius_m, top * r / radius_m).otherwise(0.0), F.atan2(dy, dx)
    return -speed * F.sin(angle), speed * F.cos(angle)


def diurnal_wind(hour: Column, minute: Column, u: float, v: float) -> tuple[Column, Column]:
    """(u, v) of a wind that swings by 30 % over the day."""
    swing = 1 + 0.3 * F.sin(2 * math.pi * (hour + minute / 60.0 - 6) / 24)
    return u * swing, v * swing


def round_half_even(v: Column, places: int = 2) -> Column:
    """``v`` rounded by its exact binary value, halves to the even digit: 2.675, which is a little less, becomes 2.67.

    Spark's own functions round the shortest decimal that reads back as ``v``.  The error of v * 10**places is found by splitting v into halves whose
    products are exact; values of 2**52 and more, by then whole numbers, stay.
    """
    scale = float(10**places)
    big = v * float((1 << 27) + 1)
    high = big - (big - v)
    product = v * scale
    error = (high * scale - product) + (v - high) * scale
    low = F.floor(product).cast("double")
    beyond = (product - low - 0.5) + error
    up = F.when((beyond > 0) | ((beyond == 0) & (F.pmod(low, F.lit(2.0)) == 1)), 1.0).otherwise(0.0)
    return F.when(F.abs(product) < float(1 << 52), (low + up) / scale).otherwise(v)
