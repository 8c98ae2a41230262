"""Particle drift as column expressions: particles, ensemble members and steps all stay in narrow JVM-side projections.

A field is a function ``(lat, lon, us) -> (u, v)`` from columns to columns, in m/s; ``us`` is the time in microseconds.
Draws are hashes of (seed, keys of the particle, step), so a recomputed task gives the same particles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import geo

Field = Callable[[Column, Column, Column], tuple[Column, Column]]
M_PER_DEGREE = geo.KM_PER_DEGREE * 1000
#: Random steps that are compiled one by one at most; longer runs are one fold, which Spark interprets.
UNROLLED = 96
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


# ---- fields


def uniform(u: float, v: float) -> Field:
    return lambda lat, lon, us: (F.lit(float(u)), F.lit(float(v)))


def eddy(centre_lat: float, centre_lon: float, radius_m: float = 50_000.0, top: float = 0.5) -> Field:
    return lambda lat, lon, us: geo.eddy_current(lat, lon, centre_lat, centre_lon, radius_m, top)


def diurnal(u: float, v: float) -> Field:
    """Wind by hour and minute of the day; seconds don't count."""

    def at(lat, lon, us):
        minute = F.floor(F.pmod(us, F.lit(DAY_US)) / 60_000_000)
        return geo.diurnal_wind(minute / 60.0, F.lit(0), u, v)

    return at


def grid(origin: tuple[int, float, float], step: tuple[int, float, float], u: Sequence[Sequence[Sequence[float]]], v: Sequence[Sequence[Sequence[float]]]) -> Field:
    """Trilinear in a regular grid [time][lat][lon] that travels with the plan; 0 outside.

    For grids of some thousand nodes; a large one is a table, see ``drift.gridded``.
    """
    sizes = (len(u), len(u[0]), len(u[0][0]))
    tables = [F.array(*[F.lit(float(x)) for plane in g for row in plane for x in row]) for g in (u, v)]

    def at(lat, lon, us):
        places = [(c - o) / s for c, o, s in zip((us, lat, lon), origin, step)]
        inside = F.lit(True)
        for p, n in zip(places, sizes):
            inside = inside & p.between(0, n - 1)
        low = [F.least(F.floor(p).cast("int"), F.lit(max(n - 2, 0))) for p, n in zip(places, sizes)]

        def value(table):
            total = F.lit(0.0)
            for corner in range(8):
                bits = [corner >> k & 1 for k in range(3)]
                index, weight = F.lit(0), F.lit(1.0)
                for p, i, n, bit in zip(places, low, sizes, bits):
                    index = index * n + F.least(i + bit, F.lit(n - 1))
                    weight = weight * (p - i if bit else 1 - (p - i))
                total = total + weight * F.get(table, index)
            return F.when(inside, total).otherwise(0.0)

        return value(tables[0]), value(tables[1])

    return at


def combined(current: Field, wind: Field, current_coefficient: Column, wind_coefficient: Column) -> Field:
    """What carries a particle: coefficients times current and wind."""

    def at(lat, lon, us):
        (a, b), (c, d) = current(lat, lon, us), wind(lat, lon, us)
        return current_coefficient * a + wind_coefficient * c, current_coefficient * b + wind_coefficient * d

    return at


# ---- draws


def uniform_draw(*keys: Column) -> Column:
    """In (0, 1)."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal_draw(*keys: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform_draw(*keys, F.lit("r")))) * F.cos(2 * math.pi * uniform_draw(*keys, F.lit("a")))


# ---- steps


def _vector(uv: tuple[Column, Column]) -> Column:
    return F.struct(uv[0].cast("double").alias("u"), uv[1].cast("double").alias("v"))


def _moved(lat: Column, lon: Column, east_m: Column, north_m: Column, at_lat: Column) -> Column:
    return F.struct((lat + north_m / M_PER_DEGREE).alias("lat"), (lon + east_m / (M_PER_DEGREE * F.cos(F.radians(at_lat)))).alias("lon"))


def rk4_step(lat: Column, lon: Column, us: Column, seconds: float, velocity: Field) -> Column:
    """struct(lat, lon) after a classical Runge-Kutta step in the flat frame at the particle's latitude."""

    def slope(k: Column, dt: float) -> Column:
        later = us + F.lit(round(dt * 1e6))
        return _let(_moved(lat, lon, k["u"] * dt, k["v"] * dt, lat), lambda p: _vector(velocity(p["lat"], p["lon"], later)))

    def end(a: Column, b: Column, c: Column, d: Column) -> Column:
        mean = lambda f: (a[f] + 2 * b[f] + 2 * c[f] + d[f]) / 6 * seconds
        return _moved(lat, lon, mean("u"), mean("v"), lat)

    half = seconds / 2
    return _let(_vector(velocity(lat, lon, us)), lambda a: _let(slope(a, half), lambda b: _let(slope(b, half), lambda c: _let(slope(c, seconds), lambda d: end(a, b, c, d)))))


def euler_maruyama_step(lat: Column, lon: Column, us: Column, seconds: float, velocity: Field, diffusion: Column, *keys: Column) -> Column:
    """struct(lat, lon) after an Euler step and a normal displacement of variance 2 * diffusion * seconds each way."""
    spread = F.sqrt(2 * diffusion * seconds)
    return _let(_vector(velocity(lat, lon, us)), lambda k: _moved(lat, lon, k["u"] * seconds + spread * normal_draw(*keys, F.lit("x")), k["v"] * seconds + spread * normal_draw(*keys, F.lit("y")), lat))


def advected(particles: DataFrame, velocity: Field, seconds: float, steps: int, diffusion: Column | None = None, keys: Sequence[str] = (), seed: int = 0, backward: bool = False, path: bool = False) -> DataFrame:
    """``particles(.., lat, lon, us)`` after ``steps`` steps: Runge-Kutta without ``diffusion``, else Euler-Maruyama.

    ``keys`` tell particles apart in their draws.  ``backward`` runs the clock back; reverse the field to reverse the way.
    ``path`` adds an array of (lat, lon, us), the start included.  NULL positions stay NULL.  No shuffle.
    Up to UNROLLED random steps are a projection each, with the same draws as the fold.
    """
    tick = F.lit(round(seconds * 1e6) * (-1 if backward else 1)).cast("long")
    own = [F.lit(seed), *[F.col(k) for k in keys]]
    if diffusion is not None and not path and steps <= UNROLLED:
        lat, lon, us = F.col("lat"), F.col("lon"), F.col("us")
        moved = particles.withColumns({"lat": lat.cast("double"), "lon": lon.cast("double"), "us": us.cast("long")})
        for k in range(1, steps + 1):
            spread = F.sqrt(2 * diffusion * seconds)
            u, v = (c.cast("double") for c in velocity(lat, lon, us))
            east, north = (c * seconds + spread * normal_draw(*own, F.lit(k), F.lit(axis)) for c, axis in ((u, "x"), (v, "y")))
            # a lambda keeps Spark from fusing all steps to one method, too long for the JVM to compile
            later = _let(us, lambda t: t + tick)
            moved = moved.withColumns({"lat": lat + north / M_PER_DEGREE, "lon": lon + east / (M_PER_DEGREE * F.cos(F.radians(lat))), "us": later})
        return moved
    spot = lambda lat, lon, us: F.struct(lat.alias("lat"), lon.alias("lon"), us.alias("us"))

    def step(state: Column, k: Column) -> Column:
        here = state["at"]
        args = (here["lat"], here["lon"], here["us"], seconds, velocity)
        new = rk4_step(*args) if diffusion is None else euler_maruyama_step(*args, diffusion, *own, k)
        return _let(new, lambda p: grown(state, spot(p["lat"], p["lon"], here["us"] + tick)))

    def grown(state: Column | None, at: Column) -> Column:
        parts = [at.alias("at")]
        if path:
            parts.append((F.array(at) if state is None else F.concat(state["path"], F.array(at))).alias("path"))
        return F.struct(*parts)

    start = grown(None, spot(F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("us").cast("long")))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step) if steps else start
    moved = particles.withColumn("_end", end)
    return moved.withColumns({"lat": F.col("_end.at.lat"), "lon": F.col("_end.at.lon"), "us": F.col("_end.at.us")} | ({"path": F.col("_end.path")} if path else {})).drop("_end")


# ---- particles and members


def _flat_area(ring: Column) -> Column:
    cross = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def particles_in(regions: DataFrame, key: str, n: int = 250, seed: int = 0, tries: int = 100) -> DataFrame:
    """``(.., part, particle_id, lat, lon)``: about ``n`` particles uniform in each region's polygon or polygons.

    ``rings`` is an array of closed rings of (lon, lat) structs, each a polygon; it gets its share of particles by area, rounded
    down, at least one.  A particle that finds no place inside in ``tries`` draws goes to the mean of the vertices.
    """
    areas = F.transform("rings", _flat_area)
    whole = regions.withColumn("_area", F.aggregate(areas, F.lit(0.0), lambda s, x: s + x))
    parts = whole.select(*[c for c in regions.columns if c != "rings"], "_area", F.posexplode("rings").alias("part", "_ring"))
    share = F.coalesce(F.floor(n * F.try_divide(_flat_area(F.col("_ring")), F.col("_area"))), F.lit(0))
    rows = parts.withColumn("particle_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), share).cast("long") - 1)))
    side = lambda f: F.transform("_ring", lambda p: p[f])
    rows = rows.withColumn("_box", F.struct(*[g(side(f)).alias(f"{f}_{k}") for f in ("lat", "lon") for k, g in (("min", F.array_min), ("max", F.array_max))]))
    ids = [F.lit(seed), F.col(key), F.col("part"), F.col("particle_id")]

    def draw(k: Column) -> Column:
        at = lambda f: F.col(f"_box.{f}_min") + uniform_draw(*ids, k, F.lit(f)) * (F.col(f"_box.{f}_max") - F.col(f"_box.{f}_min"))
        return F.struct(at("lat").alias("lat"), at("lon").alias("lon"))

    none = F.lit(None).cast("struct<lat:double,lon:double>")
    first = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), none, lambda s, k: F.when(s.isNotNull(), s).otherwise(_let(draw(k), lambda p: F.when(geo.point_in_ring(p["lat"], p["lon"], F.col("_ring")), p))))
    placed = rows.withColumn("_at", F.coalesce(first, geo.ring_centroid(F.col("_ring"))))
    return placed.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_at", "_box", "_ring", "_area")


def with_members(particles: DataFrame, members: int, ranges: dict[str, tuple[float, float]], seed: int = 0) -> DataFrame:
    """Each particle in each of the ``members``, with the coefficients that the member draws uniformly from ``ranges``."""
    rows = particles.withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(members - 1).cast("long"))))
    return rows.withColumns({k: lo + (hi - lo) * uniform_draw(F.lit(seed), F.col("member"), F.lit(k)) for k, (lo, hi) in ranges.items()})
