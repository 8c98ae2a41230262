"""Points against tables of places, such as the vertices of routes: which are near one, and the nearest of each.

Places stand on the unit sphere and enter cubes of space, so neither the poles nor the date line are special; a place enters the 27 cubes around it, and a
point meets what is in its own, by equality.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators.anomalies import _runs, _track
from tidewake.operators.tracks import OWN, with_neighbours
from tidewake.scratch import saved

_CUBE = tuple(OWN + c for c in ("cx", "cy", "cz"))


def _sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def _cubes(rows: DataFrame, lat: str, lon: str, side: float) -> DataFrame:
    return rows.withColumns({c: F.floor(v / side).cast("long") for c, v in zip(_CUBE, _sphere(F.col(lat), F.col(lon)))})


def _spread(places: DataFrame, side: float) -> DataFrame:
    """Places, named ``__tw_lat`` and ``__tw_lon``, in the 27 cubes around each."""
    near = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("xyz", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    rows = _cubes(places, OWN + "lat", OWN + "lon", side).withColumn(OWN + "o", F.explode(near))
    return rows.select(OWN + "lat", OWN + "lon", *[(F.col(c) + F.col(f"{OWN}o.{k}")).alias(c) for c, k in zip(_CUBE, "xyz")])


def _named(places: DataFrame) -> DataFrame:
    return places.where("lat is not null and lon is not null").select(F.col("lat").cast("double").alias(OWN + "lat"), F.col("lon").cast("double").alias(OWN + "lon")).distinct()


def _km() -> Column:
    return geo.haversine_km(F.col("lat"), F.col("lon"), F.col(OWN + "lat"), F.col(OWN + "lon"))


def near_any(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """The rows of ``points(.., lat, lon)`` within ``km`` of some of ``places(lat, lon)``.  Points move once and are not repeated."""
    side = max(1e-9, 2 * math.sin(min(math.pi / 2, km / geo.EARTH_KM / 2)) * (1 + 1e-6))
    at = _cubes(points, "lat", "lon", side)
    met = at.join(_spread(_named(places), side).alias("s"), [*[at[c] == F.col(f"s.{c}") for c in _CUBE], geo.haversine_km(at["lat"], at["lon"], F.col(f"s.{OWN}lat"), F.col(f"s.{OWN}lon")) <= km], "left_semi")
    return met.drop(*_CUBE)


def nearest(points: DataFrame, places: DataFrame) -> DataFrame:
    """``points(.., lat, lon)`` with ``near_lat, near_lon, near_km`` of the nearest of ``places(lat, lon)``; ties by latitude, then longitude.

    Cubes start small, by how far places spread and how many there are.  A point whose best find is within a cube's side has its answer, as what is nearer would be in
    the cubes around; the others look again in cubes of four times the side, until one cube holds the earth.  Points without a position, and all without
    places, have NULLs.
    """
    spots = saved(_named(places), "places")
    x, y, z = _sphere(F.col(OWN + "lat"), F.col(OWN + "lon"))
    n, *ends = spots.agg(F.count("*"), *[f(v) for v in (x, y, z) for f in (F.min, F.max)]).first()
    rows = points.withColumn(OWN + "id", F.monotonically_increasing_id())
    none = {"near_lat": F.lit(None).cast("double"), "near_lon": F.lit(None).cast("double"), "near_km": F.lit(None).cast("double")}
    if not n:
        return points.withColumns(none)
    rows = saved(rows, "points")
    left, found = rows.where("lat is not null and lon is not null").select(OWN + "id", "lat", "lon"), None
    side = max(1e-6, max(b - a for a, b in zip(ends[::2], ends[1::2])) / math.sqrt(n))
    while True:
        met = _cubes(left, "lat", "lon", side).join(_spread(spots, side), list(_CUBE))
        best = met.groupBy(OWN + "id").agg(F.min(F.struct(_km().alias("km"), F.col(OWN + "lat").alias("lat"), F.col(OWN + "lon").alias("lon"))).alias("b"))
        sure = 2 * geo.EARTH_KM * math.asin(min(1.0, side / 2)) * (1 - 1e-9)
        best = saved(best if side > 2 else best.where(F.col("b.km") <= sure), "best").withColumnRenamed(OWN + "id", OWN + "of")
        found = best if found is None else found.unionByName(best)
        if side > 2:
            break
        left = saved(left.join(best, F.col(OWN + "id") == F.col(OWN + "of"), "left_anti"), "left")
        if left.isEmpty():
            break
        side *= 4
    out = rows.join(found, F.col(OWN + "id") == F.col(OWN + "of"), "left")
    return out.withColumns({"near_lat": F.col("b.lat"), "near_lon": F.col("b.lon"), "near_km": F.col("b.km")}).drop(OWN + "id", OWN + "of", "b")


def route_deviation(points: DataFrame, route: DataFrame, km: float = 10, chunk_hours: float | None = None) -> DataFrame:
    """:func:`tidewake.operators.anomalies.route_deviation` with the route's vertices as a table ``(lat, lon)``; none if it has under two rows."""
    if route.limit(2).count() < 2:
        route = route.limit(0)
        rows = with_neighbours(_track(points, "lat", "lon"), chunk_hours=chunk_hours)
        return _runs(rows, F.lit(False), chunk_hours)
    known = _track(points, "lat", "lon")
    keys = ("mmsi", "us", "ord")
    close = near_any(known.where("lat is not null and lon is not null"), route, km).select(*[F.col(c).alias(OWN + c) for c in keys]).distinct().withColumn("close_", F.lit(True))
    met = known.join(close, [F.col(c).eqNullSafe(F.col(OWN + c)) for c in keys], "left").drop(*[OWN + c for c in keys])
    rows = with_neighbours(met, chunk_hours=chunk_hours)
    far = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("close_").isNull()
    return _runs(rows, far, chunk_hours)
