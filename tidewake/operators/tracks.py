"""Tracks: de-duplication, gaps, interpolation, envelopes.  A track is the rows of one mmsi in order of time.

Points need ``mmsi, us`` (epoch microseconds), ``lat, lon`` and optionally ``sog, cog, heading``; ``ord`` breaks ties.  Tracks stay
implicit: all windows here share one partitioning and order, so Spark shuffles and sorts once for a chain of them.

A window over a vessel is one task.  Where one vessel may hold much of a table, ``chunk_hours`` cuts tracks into stretches of time: windows
run over (vessel, stretch), and what crosses an edge is carried by a window over one summary row per stretch.  Results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import geo

MINUTE, HOUR = 60_000_000, 3_600_000_000


def by_time() -> Window:
    return Window.partitionBy("mmsi").orderBy("us", "ord")


#: Prefix of helper columns, so that they can't clash with a caller's.
OWN = "__tw_"


#: Vessel and stretch without NULLs: windows, summaries and the join that brings them together share one partitioning by plain equality.
_KEYS = (OWN + "key", OWN + "chunk")


def _keyed(points: DataFrame, hours: float) -> DataFrame:
    vessel = F.coalesce(F.concat(F.lit("="), F.col("mmsi").cast("string")), F.lit("null"))
    return points.withColumns({_KEYS[0]: vessel, _KEYS[1]: F.coalesce(F.floor(F.col("us") / F.lit(int(hours * HOUR))), F.lit(-(1 << 62)))})


def _carried(points: DataFrame, columns: tuple[str, ...] = (), total: Column | None = None, per_vessel: tuple[Column, ...] = ()) -> DataFrame:
    """One row per vessel and stretch of keyed ``points``: its number of reports, those before, the values of the report before and of the one after it,
    the vessel's first and last time, the sum of ``total`` over earlier stretches, and aggregates of the whole vessel."""
    at, ends = F.struct("us", "ord"), F.struct(*columns) if columns else F.struct("us")
    sums = [F.sum(total).alias(OWN + "total")] if total is not None else []
    each = points.groupBy(*_KEYS).agg(F.count("*").alias(OWN + "n"), F.min_by(ends, at).alias(OWN + "first"), F.max_by(ends, at).alias(OWN + "last"), F.min("us").alias(OWN + "low"), F.max("us").alias(OWN + "high"), *sums)
    whole = Window.partitionBy(_KEYS[0])
    v = whole.orderBy(_KEYS[1])
    earlier = v.rowsBetween(Window.unboundedPreceding, -1)
    out = {"before": F.coalesce(F.sum(OWN + "n").over(earlier), F.lit(0)), "prev": F.lag(OWN + "last").over(v), "next": F.lead(OWN + "first").over(v), "u0": F.min(OWN + "low").over(whole), "u1": F.max(OWN + "high").over(whole)}
    if total is not None:
        out["sum"] = F.coalesce(F.sum(OWN + "total").over(earlier), F.lit(0))
    rows = each.select(*_KEYS, OWN + "n", *[c.alias(OWN + k) for k, c in out.items()])
    return rows.join(points.groupBy(_KEYS[0]).agg(*per_vessel), _KEYS[0]) if per_vessel else rows


def _plain(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith(OWN)])


def with_neighbours(points: DataFrame, *columns: str, chunk_hours: float | None = None, keep: tuple[str, ...] = (), per_vessel: tuple[Column, ...] = ()) -> DataFrame:
    """``pos`` (from 0), and ``prev_*`` and ``next_*`` of the columns.

    ``keep`` names of u0, u1 (a vessel's first and last time) stay as columns, and so do the aggregates ``per_vessel``.
    """
    if chunk_hours is None:
        w, whole = by_time(), Window.partitionBy("mmsi")
        out = {"pos": (F.row_number().over(w) - 1).cast("long")}
        for c in columns:
            out |= {f"prev_{c}": F.lag(c).over(w), f"next_{c}": F.lead(c).over(w)}
        out |= {k: v for k, v in (("u0", F.min("us").over(whole)), ("u1", F.max("us").over(whole))) if k in keep}
        rows = points.withColumns(out)
        if per_vessel:
            stats = points.groupBy(F.col("mmsi").alias(OWN + "v")).agg(*per_vessel)
            rows = rows.join(stats, rows["mmsi"].eqNullSafe(stats[OWN + "v"])).drop(OWN + "v")
        return rows
    w, keyed = Window.partitionBy(*_KEYS).orderBy("us", "ord"), _keyed(points, chunk_hours)
    inner = {OWN + "row": F.row_number().over(w)}
    for c in columns:
        inner |= {f"prev_{c}": F.lag(c).over(w), f"next_{c}": F.lead(c).over(w)}
    rows = keyed.withColumns(inner).join(_carried(keyed, columns, per_vessel=per_vessel), list(_KEYS))
    out = {"pos": (F.col(OWN + "before") + F.col(OWN + "row") - 1).cast("long")}
    for c in columns:
        out[f"prev_{c}"] = F.when(F.col(OWN + "row") == 1, F.col(f"{OWN}prev.{c}")).otherwise(F.col(f"prev_{c}"))
        out[f"next_{c}"] = F.when(F.col(OWN + "row") == F.col(OWN + "n"), F.col(f"{OWN}next.{c}")).otherwise(F.col(f"next_{c}"))
    return _plain(rows.withColumns(out | {k: F.col(OWN + k) for k in keep}))


def running_sum(points: DataFrame, name: str, value: Column, chunk_hours: float | None = None) -> DataFrame:
    """``name``: the sum of ``value`` over a vessel's reports up to each."""
    if chunk_hours is None:
        return points.withColumn(name, F.sum(value).over(by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    w, keyed = Window.partitionBy(*_KEYS).orderBy("us", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow), _keyed(points, chunk_hours)
    rows = keyed.withColumn(OWN + "inner", F.sum(value).over(w))
    return _plain(rows.join(_carried(keyed, total=value), list(_KEYS)).withColumn(name, F.col(OWN + "inner") + F.col(OWN + "sum")))


def deduplicate(points: DataFrame) -> DataFrame:
    """The first report (by ``ord``) of each vessel, time and position rounded to six places."""
    key = Window.partitionBy("mmsi", "us", F.round("lat", 6), F.round("lon", 6)).orderBy("ord")
    return points.withColumn(OWN + "n", F.row_number().over(key)).where(F.col(OWN + "n") == 1).drop(OWN + "n")


def at_least(points: DataFrame, n: int = 2) -> DataFrame:
    """Points of tracks with ``n`` points or more."""
    return points.withColumn(OWN + "n", F.count("*").over(Window.partitionBy("mmsi"))).where(F.col(OWN + "n") >= n).drop(OWN + "n")


def summaries(points: DataFrame) -> DataFrame:
    """One row per track: counts, times, first and last position, envelope, speed range.  One aggregation, no window."""
    at = F.struct("us", "ord")
    pos = F.struct("lat", "lon")
    agg = points.groupBy("mmsi").agg(F.count("*").alias("n"), F.min("us").alias("t0"), F.max("us").alias("t1"), F.min_by(pos, at).alias("first"), F.max_by(pos, at).alias("last"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.max(F.coalesce("sog", F.lit(0.0))).alias("max_sog"), F.min(F.coalesce("sog", F.lit(0.0))).alias("min_sog"))
    return agg.select("mmsi", "n", "t0", "t1", F.col("first.lat").alias("first_lat"), F.col("first.lon").alias("first_lon"), F.col("last.lat").alias("last_lat"), F.col("last.lon").alias("last_lon"), "min_lat", "max_lat", "min_lon", "max_lon", "min_sog", "max_sog")


def envelopes(points: DataFrame) -> DataFrame:
    """The track index: envelopes in space and time of tracks with two points or more."""
    return summaries(points).where("n >= 2")


def in_bbox(index: DataFrame, min_lon, min_lat, max_lon, max_lat) -> DataFrame:
    """Tracks whose envelope (not path) meets the closed box."""
    return index.where((F.col("max_lon") >= min_lon) & (F.col("min_lon") <= max_lon) & (F.col("max_lat") >= min_lat) & (F.col("min_lat") <= max_lat))


def in_radius(index: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Tracks whose envelope meets the square of radius / 111 degrees on both axes."""
    d = km / geo.KM_PER_DEGREE
    return in_bbox(index, lon - d, lat - d, lon + d, lat + d)


def in_time_range(index: DataFrame, start_us, end_us) -> DataFrame:
    return index.where((F.col("t0") <= end_us) & (F.col("t1") >= start_us))


def boxes_join(index: DataFrame, boxes: DataFrame, cell: float = 0.25) -> DataFrame:
    """(box_id, mmsi) of every box (box_id, min_lon, min_lat, max_lon, max_lat) and track envelope that meet.

    Both sides enter the grid cells that they cover and meet by equality of cells; the pair counts in the cell that holds the
    lower left corner of their overlap, so no distinct is needed.
    """
    def cells(df, p):
        c = lambda name: F.floor(F.col(p + name) / cell)
        return df.withColumn("cx", F.explode(F.sequence(c("min_lon"), c("max_lon")))).withColumn("cy", F.explode(F.sequence(c("min_lat"), c("max_lat"))))

    b = boxes.select("box_id", *[F.col(n).alias("b_" + n) for n in ("min_lon", "min_lat", "max_lon", "max_lat")])
    met = cells(index.select("mmsi", "min_lon", "min_lat", "max_lon", "max_lat"), "").join(cells(b, "b_"), ["cx", "cy"])
    left, low = F.greatest("min_lon", "b_min_lon"), F.greatest("min_lat", "b_min_lat")
    overlap = (left <= F.least("max_lon", "b_max_lon")) & (low <= F.least("max_lat", "b_max_lat"))
    return met.where(overlap & (F.floor(left / cell) == F.col("cx")) & (F.floor(low / cell) == F.col("cy"))).select("box_id", "mmsi")


def gaps(points: DataFrame, max_hours: float = 6.0, chunk_hours: float | None = None) -> DataFrame:
    """``(mmsi, pos0, pos1, hours)`` of consecutive reports more than ``max_hours`` apart."""
    hours = (F.col("us") - F.col("prev_us")) / HOUR
    return with_neighbours(points, "us", chunk_hours=chunk_hours).where(hours > max_hours).select("mmsi", (F.col("pos") - 1).alias("pos0"), F.col("pos").alias("pos1"), hours.alias("hours"))


def _lerp(a: str, share: Column) -> Column:
    return F.col(a) + (F.col("next_" + a) - F.col(a)) * share


def _made(rows: DataFrame, at: Column, *more: Column) -> DataFrame:
    """The report of each row where ``k`` is NULL, elsewhere a report at ``at`` between it and the next."""
    share, own = (at - F.col("us")) / (F.col("next_us") - F.col("us")), F.col("k").isNull()
    between = {c: _lerp(c, share) for c in ("lat", "lon", "sog")} | {c: geo.lerp_bearing(F.col(c), F.col("next_" + c), share) for c in ("cog", "heading")}
    return rows.select("mmsi", F.when(own, F.col("us")).otherwise(at).alias("us"), *[F.when(own, F.col(c)).otherwise(v).alias(c) for c, v in between.items()], *more)


def interpolate(points: DataFrame, minutes: float = 10, chunk_hours: float | None = None) -> DataFrame:
    """Tracks on a regular grid from their first report: ``(mmsi, us, lat, lon, sog, cog, heading)``.

    Each report makes the ticks of the half-open stretch that ends at the next one, so there is no range join.  A channel
    is NULL unless both ends have it, even on a report.  The first tick copies the first report.  Tracks with one
    report or no duration stay as they are.
    """
    step = int(minutes * MINUTE)
    cols = ["us", "lat", "lon", "sog", "cog", "heading"]
    rows = with_neighbours(points, *cols, chunk_hours=chunk_hours, keep=("u0", "u1"))
    k = lambda c: F.floor((F.col(c) - F.col("u0")) / F.lit(step)).cast("long")
    itself = F.when((F.col("u0") == F.col("u1")) | (F.col("pos") == 0), F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))
    ticks = F.when((F.col("next_us") > F.col("us")) & (k("us") + 1 <= k("next_us")), F.sequence(k("us") + 1, k("next_us"))).otherwise(F.array().cast("array<long>"))
    return _made(rows.withColumn("k", F.explode(F.concat(itself, ticks))), F.col("u0") + F.col("k") * step)


def fill_gaps(points: DataFrame, max_minutes: float = 60, chunk_hours: float | None = None) -> DataFrame:
    """Reports and, in gaps longer than ``max_minutes``, ticks every min(10 minutes, half of it); ``synthetic`` tells them apart.

    If the gap divides evenly, the last tick has the time of the next report.
    """
    step = int(min(600.0, max_minutes * 60 / 2) * 1_000_000)
    cols = ["us", "lat", "lon", "sog", "cog", "heading"]
    rows = with_neighbours(points, *cols, chunk_hours=chunk_hours)
    gap, itself = F.col("next_us") - F.col("us"), F.array(F.lit(None).cast("long"))
    ticks = F.concat(itself, F.sequence(F.lit(1).cast("long"), F.floor(gap / F.lit(step)).cast("long")))
    each = F.when(gap > int(max_minutes * MINUTE), ticks).otherwise(itself)
    return _made(rows.withColumn("k", F.explode(each)), F.col("us") + F.col("k") * step, F.col("k").isNotNull().alias("synthetic"))
