"""Particle drift: ensembles over regions, their statistics, densities, hulls, and fields as tables."""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators import contours, raster
from tidewake.operators import drift_steps as steps
from tidewake.scratch import saved, small

# Ranges from which members draw their coefficients.
RANGES = {"current": (0.8, 1.2), "wind": (0.02, 0.04), "diffusion": (5.0, 20.0)}


@dataclasses.dataclass(frozen=True)
class Request:
    """A drift run over polygons, each a closed ring of (lon, lat); fields give (u, v) in m/s."""

    rings: tuple[tuple[tuple[float, float], ...], ...]
    hours: float
    step_minutes: float
    particles: int = 250
    current: steps.Field = steps.uniform(0.0, 0.0)
    wind: steps.Field = steps.uniform(0.0, 0.0)
    current_coefficient: float = 1.0
    wind_coefficient: float = 0.03
    diffusion: float = 10.0
    stochastic: bool = True
    backward: bool = True
    #: ``reference``: a backward run moves as a forward one (only its clock runs back); ``physical``: velocities are reversed.
    backward_mode: str = "reference"
    seed: int = 0
    start_us: int = 0


def rk4(lat: Column, lon: Column, u: Column, v: Column, seconds: float) -> tuple[Column, Column]:
    """One step in a uniform field, where all four slopes are equal."""
    return lat + v * seconds / 1000 / geo.KM_PER_DEGREE, lon + u * seconds / 1000 / (geo.KM_PER_DEGREE * F.cos(F.radians(lat)))


def drifted(regions: DataFrame, key: str, r: Request, members: int = 10, perturb: bool = True) -> DataFrame:
    """``(key, part, particle_id, us, lat, lon, member, weight)`` of an ensemble over each row of ``regions(key, rings, us)``.

    ``r.rings`` and ``r.start_us`` are not used.  Members draw their coefficients from RANGES if ``perturb``.  Regions are dealt to all tasks, as
    adaptive execution would take their few bytes for one task's work (dealt by the key itself they could stay where an aggregation left them); from
    there to final positions there is no shuffle, and every draw is a hash of seed, region, particle, member and step.
    """
    dealt = regions.select(key, "rings", "us").repartition(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))
    ranges = RANGES if perturb else {"current": (r.current_coefficient,) * 2, "wind": (r.wind_coefficient,) * 2, "diffusion": (r.diffusion,) * 2}
    rows = steps.with_members(steps.particles_in(dealt, key, r.particles, r.seed), members, ranges, r.seed)
    sign = -1.0 if r.backward and r.backward_mode == "physical" else 1.0
    velocity = steps.combined(r.current, r.wind, sign * F.col("current"), sign * F.col("wind"))
    seconds = r.step_minutes * 60
    out = steps.advected(rows, velocity, seconds, int(r.hours * 3600 / seconds), F.col("diffusion") if r.stochastic else None, (key, "part", "particle_id", "member"), r.seed, r.backward)
    return out.drop(*ranges).withColumn("weight", F.lit(1.0))


def simulate(spark: SparkSession, r: Request, members: int = 10, perturb: bool = True) -> DataFrame:
    """``drifted`` over the request's own region, keyed by ``run`` 0."""
    region = spark.createDataFrame([(0, [[(float(x), float(y)) for x, y in ring] for ring in r.rings], r.start_us)], "run long, rings array<array<struct<lon:double,lat:double>>>, us long")
    return drifted(region, "run", r, members, perturb)


def statistics(particles: DataFrame, *by: str) -> DataFrame:
    """Count, mean and population deviation of positions, and confidence 1 / (1 + deviations) in [0, 1]."""
    spread = F.stddev_pop("lat") + F.stddev_pop("lon")
    return particles.groupBy(*by).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.stddev_pop("lat").alias("sd_lat"), F.stddev_pop("lon").alias("sd_lon"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + spread))).alias("confidence"))


def aggregated(particles: DataFrame, by: str, member: str = "member") -> DataFrame:
    """One row per ensemble: its members, all their trajectories, the mean of their confidences, deviations of all positions."""
    each = statistics(particles, by, member).groupBy(by).agg(F.count("*").alias("ensemble_size"), F.sum("n").alias("trajectories"), F.avg("confidence").alias("confidence"))
    return each.join(particles.groupBy(by).agg(F.stddev_pop("lat").alias("lat_std"), F.stddev_pop("lon").alias("lon_std")), by)


def kde_grid(particles: DataFrame, by: str, cells: int = 50, margin: float = 0.1) -> DataFrame:
    """Gaussian density (Scott's bandwidth) of each group on a cells x cells grid: ``(by, gy, gx, lat, lon, density)``.

    Every task adds up its particles' kernels in one array per group, and arrays' nodes are summed by group.
    """
    p = particles
    s = p.groupBy(by).agg(F.count("*").cast("double").alias("n"), F.var_samp("lat").alias("vy"), F.var_samp("lon").alias("vx"), F.covar_samp("lat", "lon").alias("c"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1")).where("n > 1")
    h2 = F.pow("n", F.lit(-1 / 3))
    s = s.withColumns({"a": F.col("vy") * h2, "b": F.col("vx") * h2, "r": F.col("c") * h2}).withColumn("det", F.col("a") * F.col("b") - F.col("r") * F.col("r")).where("det > 0")
    node = lambda lo, hi, g: F.col(lo) - margin * (F.col(hi) - F.col(lo)) + F.col(g) * ((1 + 2 * margin) * (F.col(hi) - F.col(lo)) / (cells - 1))
    met = p.where("lat is not null and lon is not null").join(s, by).select(F.col(by).alias("g"), "lat", "lon", "n", "a", "b", "r", "det", "y0", "y1", "x0", "x1")
    span = np.arange(cells) * ((1 + 2 * margin) / (cells - 1)) - margin

    def sums(batches):
        held: dict = {}
        kind = None

        def full():
            for g, total in held.items():
                gy, gx = np.divmod(np.arange(cells * cells, dtype=np.int32), cells)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(gy), kind), pa.array(gy, pa.int32()), pa.array(gx, pa.int32()), pa.array(total.ravel())], ["g", "gy", "gx", "v"])
            held.clear()

        for batch in batches:
            kind, keys = batch.schema.field(0).type, batch.column(0).dictionary_encode()
            code, rest = keys.indices.to_numpy(), {f: batch.column(i).to_numpy() for i, f in enumerate(batch.schema.names) if i}
            for c, g in enumerate(keys.dictionary.to_pylist()):
                mine = np.flatnonzero(code == c)
                one = {f: float(v[mine[0]]) for f, v in rest.items() if f not in ("lat", "lon")}
                total = held.setdefault(g, np.zeros((cells, cells)))
                for i in range(0, len(mine), 256):
                    part = mine[i : i + 256]
                    dy = one["y0"] + span * (one["y1"] - one["y0"]) - rest["lat"][part, None]
                    dx = one["x0"] + span * (one["x1"] - one["x0"]) - rest["lon"][part, None]
                    q = (one["b"] * dy * dy)[:, :, None] - (2 * one["r"] * dy)[:, :, None] * dx[:, None, :] + (one["a"] * dx * dx)[:, None, :]
                    total += np.exp(q / (-2 * one["det"])).sum(0) / (one["n"] * 2 * np.pi * np.sqrt(one["det"]))
            if len(held) * cells * cells > 4_000_000:
                yield from full()
        yield from full()

    kind = dict(particles.dtypes)[by]
    density = met.mapInArrow(sums, f"g {kind}, gy int, gx int, v double").groupBy("g", "gy", "gx").agg(F.sum("v").alias("density")).withColumnRenamed("g", by)
    return density.join(s, by).select(by, "gy", "gx", node("y0", "y1", "gy").alias("lat"), node("x0", "x1", "gx").alias("lon"), "density")


def density_region(grid: DataFrame, by: str, share: float = 0.5) -> DataFrame:
    """Grid nodes whose density is ``share`` of their group's greatest or more: the region of origin."""
    w = Window.partitionBy(by)
    return grid.withColumn("top", F.max("density").over(w)).where(F.col("density") >= share * F.col("top")).drop("top")


def region_polygons(particles: DataFrame, by: str, cells: int = 50, share: float = 0.5) -> DataFrame:
    """``(by, part, rings)``: regions of origin as polygons, closed rings of (lon, lat) structs, the outer one first.

    A region is all grid cells around nodes of ``density_region``; parts that don't touch are numbered from 0.  Groups without
    a density (under two particles, or all on a line) get their hull.  ``by`` is a number.
    """
    grid = saved(kde_grid(particles, by, cells), "density")
    nodes = density_region(grid, by, share).select(F.col(by).alias("scene_id"), F.col("gy").cast("long").alias("y"), F.col("gx").cast("long").alias("x"))
    shapes = raster.outlines(nodes, cells, (1.0, 0.0, -0.5, 0.0, 1.0, -0.5)).withColumnRenamed("scene_id", by)
    axis = lambda c: [F.min(c).alias(f"{c}0"), ((F.max(c) - F.min(c)) / (cells - 1)).alias(f"{c}1")]
    placed = shapes.join(grid.groupBy(by).agg(*axis("lat"), *axis("lon")), by)
    at = lambda p: F.struct((F.col("lon0") + p["lon"] * F.col("lon1")).alias("lon"), (F.col("lat0") + p["lat"] * F.col("lat1")).alias("lat"))
    part = (F.row_number().over(Window.partitionBy(by).orderBy("component")) - 1).cast("int").alias("part")
    regions = placed.select(by, part, F.transform("rings", lambda ring: F.transform(ring, at)).alias("rings"))
    return _with_hulls(regions, particles, grid, by)


def _with_hulls(regions: DataFrame, particles: DataFrame, grid: DataFrame, by: str) -> DataFrame:
    """``regions``, and the hulls of groups that have no density."""
    others = hulls(particles.join(grid.select(by).distinct(), by, "left_anti"), by)
    lines = others.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))).alias("h"))
    return regions.unionByName(lines.select(by, F.lit(0).alias("part"), F.array(F.transform("h", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))).alias("rings")))


def region_contours(particles: DataFrame, by: str, cells: int = 50, share: float = 0.5, holes: bool = False) -> DataFrame:
    """``(by, part, rings)``: regions of origin as polygons between interpolated level lines of the density, the largest part first.

    Without ``holes`` parts are the outermost lines alone, the union of what all lines enclose.  Groups without a density get their hull.
    """
    grid = saved(kde_grid(particles, by, cells), "density")
    lines = contours.polygons(contours.segments(grid, by, cells, share), by)
    return _with_hulls(lines if holes else contours.union(lines, by), particles, grid, by)


def hulls(particles: DataFrame, by: str, buffer: float = 0.01) -> DataFrame:
    """``(by, seq, lat, lon)``: the closed convex hull of each group, a small box if it has no area.

    Points that lie inside a hull of their own task go before the shuffle: only extreme points in 64 directions and
    whatever lies beyond the polygon that they make are kept.
    """
    angle = [2 * np.pi * k / 64 for k in range(64)]
    extreme = particles.groupBy(by).agg(F.array(*[F.max_by(F.struct("lat", "lon"), F.col("lat") * float(np.sin(t)) + F.col("lon") * float(np.cos(t))) for t in angle]).alias("e"))
    ring = extreme.select(by, F.concat("e", F.array(F.col("e")[0])).alias("ring"))
    outer = particles.join(ring, by).where(~geo.point_in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).select(by, "lat", "lon")
    outer = outer.unionByName(extreme.select(by, F.inline("e"))).distinct()

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({(x, y) for x, y in zip(pdf["lon"], pdf["lat"])})
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        halves = []
        for order in (pts, pts[::-1]):
            half: list = []
            for p in order:
                while len(half) > 1 and turn(half[-2], half[-1], p) <= 1e-12:  # on a line but for rounding
                    half.pop()
                half.append(p)
            halves += half[:-1]
        if len(halves) < 3:
            (x0, y0), (x1, y1) = pts[0], pts[-1]
            lo, hi = min(y0, y1) - buffer, max(y0, y1) + buffer
            halves = [(x0 - buffer, lo), (x1 + buffer, lo), (x1 + buffer, hi), (x0 - buffer, hi)]
        halves.append(halves[0])
        return pd.DataFrame({by: pdf[by].iloc[0], "seq": range(len(halves)), "lat": [p[1] for p in halves], "lon": [p[0] for p in halves]})

    kind = dict(particles.dtypes)[by]
    return outer.groupBy(by).applyInPandas(chain, f"{by} {kind}, seq long, lat double, lon double")


def gridded(points: DataFrame, field: DataFrame, t_step: float, y_step: float, x_step: float) -> DataFrame:
    """``points(.., t, lat, lon)`` with (u, v) by trilinear interpolation of ``field(ti, yi, xi, u, v)`` on a regular grid.

    Nodes are numbered from the origin in steps; a point meets its eight corners by equality and is 0 where one is missing.
    """
    rows = points.withColumn("_id", F.monotonically_increasing_id())
    part = {"t": F.col("t") / t_step, "y": F.col("lat") / y_step, "x": F.col("lon") / x_step}
    low = rows.withColumns({f"{k}0": F.floor(v).cast("long") for k, v in part.items()} | {f"{k}f": v - F.floor(v) for k, v in part.items()})
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    w = lambda k, bit: F.when(F.col(f"n.{bit}") == 1, F.col(f"{k}f")).otherwise(1 - F.col(f"{k}f"))
    ask = low.withColumn("n", corners).withColumns({"ti": F.col("t0") + F.col("n.a"), "yi": F.col("y0") + F.col("n.b"), "xi": F.col("x0") + F.col("n.c")}).withColumn("w", w("t", "a") * w("y", "b") * w("x", "c"))
    met = ask.where("w > 0").join(field, ["ti", "yi", "xi"], "left").groupBy("_id").agg(F.sum(F.col("w") * F.col("u")).alias("su"), F.sum(F.col("w") * F.col("v")).alias("sv"), F.count_if(F.col("u").isNull()).alias("out"))
    inside = F.col("out") == 0
    return rows.join(met, "_id", "left").withColumns({"u": F.when(inside, F.col("su")).otherwise(0.0), "v": F.when(inside, F.col("sv")).otherwise(0.0)}).drop("_id", "su", "sv", "out")


def _bracketed(points: DataFrame, value: str, axis: DataFrame, name: str) -> DataFrame:
    """``points`` with ``name_lo`` and ``name_hi``, the nodes of ``axis(a)`` around ``value`` (NULL outside of them).

    An as-of join by buckets: stretches between neighbouring nodes enter the buckets of equal width that they cover, as many as there are nodes;
    a point is in one bucket, and of the stretches there in one.
    """
    nodes = axis.select(F.col("a").cast("double").alias("a")).where("a is not null").distinct()
    low, high, n = nodes.agg(F.min("a"), F.max("a"), F.count("*")).first()
    if not n:
        return points.withColumns({f"{name}_lo": F.lit(None).cast("double"), f"{name}_hi": F.lit(None).cast("double")})
    width = (high - low) / max(1, n - 1) or 1.0
    bucket = lambda c: F.floor((c - low) / width).cast("long")
    spans = nodes.select(F.col("a").alias(f"{name}_lo"), F.lead("a").over(Window.orderBy("a")).alias(f"{name}_hi"))  # one row a node of an axis
    spans = spans.withColumn("last", F.col(f"{name}_hi").isNull()).withColumn(f"{name}_hi", F.coalesce(f"{name}_hi", f"{name}_lo"))
    spans = small(spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col(f"{name}_lo")), bucket(F.col(f"{name}_hi"))))))
    at = F.col(value)
    inside = (at >= spans[f"{name}_lo"]) & ((at < spans[f"{name}_hi"]) | (spans["last"] & (at == spans[f"{name}_lo"])))
    return points.join(spans, (bucket(at) == spans["bucket"]) & inside, "left").drop("bucket", "last")


def gridded_uneven(points: DataFrame, field: DataFrame) -> DataFrame:
    """``points(.., t, lat, lon)`` with (u, v) by trilinear interpolation of ``field(t, y, x, u, v)`` whose axes may have nodes at any distances.

    The axes are the distinct values of t, y and x.  A point finds its stretch on each axis by an as-of join and meets the corners by equality; it
    is 0 outside of the grid and where a corner that counts is missing.
    """
    rows = points.withColumn("_id", F.monotonically_increasing_id())
    axes = {"t": "t", "y": "lat", "x": "lon"}
    found = rows.select("_id", *axes.values())
    for k, value in axes.items():
        found = _bracketed(found, value, field.select(F.col(k).alias("a")), k)
    found = found.where(" and ".join(f"{k}_lo is not null" for k in axes))
    share = {k: F.when(F.col(f"{k}_hi") > F.col(f"{k}_lo"), (F.col(v) - F.col(f"{k}_lo")) / (F.col(f"{k}_hi") - F.col(f"{k}_lo"))).otherwise(0.0) for k, v in axes.items()}
    found = found.withColumns({f"{k}_f": c for k, c in share.items()})
    corners = F.explode(F.array(*[F.struct(*[F.lit(c >> i & 1).alias(k) for i, k in enumerate(axes)]) for c in range(8)]))
    pick = {k: F.when(F.col(f"n.{k}") == 1, F.col(f"{k}_hi")).otherwise(F.col(f"{k}_lo")).alias(f"{k}_at") for k in axes}
    weight = F.lit(1.0)
    for k in axes:
        weight = weight * F.when(F.col(f"n.{k}") == 1, F.col(f"{k}_f")).otherwise(1 - F.col(f"{k}_f"))
    asked = found.withColumn("n", corners).select("_id", *pick.values(), weight.alias("w")).where("w > 0")
    nodes = field.select(*[F.col(k).cast("double").alias(f"{k}_at") for k in axes], "u", "v")
    met = asked.join(nodes, [f"{k}_at" for k in axes], "left").groupBy("_id").agg(F.sum(F.col("w") * F.col("u")).alias("_u"), F.sum(F.col("w") * F.col("v")).alias("_v"), F.count_if(F.col("u").isNull()).alias("_out"))
    inside = F.col("_out") == 0
    return rows.join(met, "_id", "left").withColumns({"u": F.when(inside, F.col("_u")).otherwise(0.0), "v": F.when(inside, F.col("_v")).otherwise(0.0)}).drop("_id", "_u", "_v", "_out")
