"""Anomaly detectors over tracks.  Positions are numbered from 0 in order of time."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.functions import geo
from tidewake.operators.tracks import MINUTE, OWN, running_sum, with_neighbours


def _runs(rows: DataFrame, inside: Column, chunk_hours: float | None = None) -> DataFrame:
    """``(mmsi, pos0, pos1, us0, us1)`` of maximal runs of positions where ``inside`` holds (gaps and islands)."""
    told = rows.withColumn(OWN + "in", inside)
    told = running_sum(told.withColumnRenamed(OWN + "in", "inside_"), "isle_", F.when(F.col("inside_"), 0).otherwise(1), chunk_hours)
    return told.where("inside_").groupBy("mmsi", "isle_").agg(F.min("pos").alias("pos0"), F.max("pos").alias("pos1"), F.min("us").alias("us0"), F.max("us").alias("us1")).drop("isle_")


def _track(points: DataFrame, *more: str) -> DataFrame:
    """The columns that a detector needs, so that others of the caller's can't clash with its own."""
    return points.select("mmsi", "us", "ord", *more)


def stops(points: DataFrame, knots: float = 0.5, minutes: float = 30, chunk_hours: float | None = None) -> DataFrame:
    """Runs slower than ``knots`` (NULL speed is 0) that last ``minutes`` or more."""
    runs = _runs(with_neighbours(_track(points, "sog"), chunk_hours=chunk_hours), F.coalesce("sog", F.lit(0.0)) < knots, chunk_hours)
    return runs.where(F.col("us1") - F.col("us0") >= int(minutes * MINUTE))


def route_deviation(points: DataFrame, route: list[tuple[float, float]], km: float = 10, chunk_hours: float | None = None) -> DataFrame:
    """Runs farther than ``km`` from every vertex (not leg) of ``route``, a list of (lat, lon); none if it has under two."""
    rows = with_neighbours(_track(points, "lat", "lon"), chunk_hours=chunk_hours)
    if len(route) < 2:
        return _runs(rows, F.lit(False), chunk_hours)
    nearest = F.least(*[geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)) for a, b in route])
    return _runs(rows, nearest > km, chunk_hours)


def speed_anomaly(points: DataFrame, z: float = 3.0, chunk_hours: float | None = None) -> DataFrame:
    """Positions whose speed is more than ``z`` population deviations from their track's mean; NULL speeds don't count."""
    stats = (F.count("sog").alias("n_"), F.avg("sog").alias("mean_"), F.stddev_pop("sog").alias("dev_"))
    if chunk_hours is None:
        w = Window.partitionBy("mmsi")
        rows = with_neighbours(_track(points, "sog")).withColumns({"n_": F.count("sog").over(w), "mean_": F.avg("sog").over(w), "dev_": F.stddev_pop("sog").over(w)})
    else:
        rows = with_neighbours(_track(points, "sog"), chunk_hours=chunk_hours, keep=("n_", "mean_", "dev_"), per_vessel=tuple(s.alias(OWN + k) for s, k in zip(stats, ("n_", "mean_", "dev_"))))
    score = F.abs(F.col("sog") - F.col("mean_")) / F.col("dev_")
    return rows.where((F.col("n_") >= 3) & (F.col("dev_") > 0)).where(score > z).select("mmsi", "pos", score.alias("z"))


def course_change(points: DataFrame, degrees: float = 45, chunk_hours: float | None = None) -> DataFrame:
    """Inner positions where the great-circle bearing turns by more than ``degrees``; all three reports need a course."""
    rows = with_neighbours(_track(points, "lat", "lon", "cog"), "lat", "lon", "cog", chunk_hours=chunk_hours)
    c = F.col
    turn = geo.wrap_degrees(geo.great_circle_bearing(c("lat"), c("lon"), c("next_lat"), c("next_lon")), geo.great_circle_bearing(c("prev_lat"), c("prev_lon"), c("lat"), c("lon")))
    return rows.where("cog is not null and prev_cog is not null and next_cog is not null").withColumn("turn", turn).where(F.col("turn") > degrees).select("mmsi", "pos", "turn")


def loitering(points: DataFrame, km: float = 5, minutes: float = 60, chunk_hours: float | None = None) -> DataFrame:
    """``(mmsi, pos0, pos1)`` of stays within ``km`` of a centre that last ``minutes`` or more.

    The centre is the first position, and from then on the one that left the circle; it is not part of a stay.  The
    state depends on what came before, so sorted tracks stream past a state of one centre and one stay; a track of any
    length takes no more memory, only its task's time.

    With ``chunk_hours`` a track is cut where its state is known to begin anew: the report before is within ``km`` of the centre or is the
    centre, so one that is over 2 ``km`` away from it has left the circle, whatever the centre is; and a report without a position is near
    nothing.  Pieces are dealt to tasks on their own.
    """
    span, kind = int(minutes * MINUTE), points.schema["mmsi"].dataType

    def walk(batches):
        first, vessel, piece = True, None, None
        lat = lon = us = p0 = us0 = pos = None

        def done():
            return p0 is not None and us is not None and us0 is not None and us - us0 >= span

        for batch in batches:
            out = []
            for m, s, p, t, y, x in zip(*(c.to_pylist() for c in batch.columns)):
                if first or m != vessel or s != piece:
                    if done():
                        out.append((vessel, p0, pos))
                    first, vessel, piece, pos, lat, lon, us, p0, us0 = False, m, s, p, y, x, t, None, None
                    continue
                if _near(lat, lon, y, x, km):
                    p0, us0 = p if p0 is None else p0, t if us0 is None else us0
                else:
                    if done():
                        out.append((vessel, p0, pos))
                    lat, lon, p0, us0 = y, x, None, None
                pos, us = p, t
            if out:
                yield _stays(out, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if done():
            yield _stays([(vessel, p0, pos)], last)

    schema = T.StructType([T.StructField("mmsi", kind), T.StructField("pos0", T.LongType()), T.StructField("pos1", T.LongType())])
    if chunk_hours is None:
        number = Window.partitionBy("mmsi").orderBy("us", "ord", "lat", "lon")
        rows = _track(points, "lat", "lon").select("mmsi", F.lit(0).cast("long").alias("piece"), (F.row_number().over(number) - 1).cast("long").alias("pos"), "us", "lat", "lon")
        return rows.mapInArrow(walk, schema)  # a vessel's rows are together and in order already
    rows = with_neighbours(_track(points, "lat", "lon"), "lat", "lon", chunk_hours=chunk_hours)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("prev_lat").isNotNull() & F.col("prev_lon").isNotNull()
    anew = ~known | (geo.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")) > 2 * km * (1 + 1e-9))
    rows = running_sum(rows, "piece", F.when(anew, 1).otherwise(0), chunk_hours)
    dealt = rows.select("mmsi", "piece", "pos", "us", "lat", "lon").repartition("mmsi", "piece").sortWithinPartitions("mmsi", "piece", "pos")
    return dealt.mapInArrow(walk, schema)


def _near(a: float | None, b: float | None, c: float | None, d: float | None, km: float) -> bool:
    """Whether the great-circle distance of (a, b) and (c, d) is ``km`` at most; unknown positions are near nothing."""
    if a is None or b is None or c is None or d is None:
        return False
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h if h <= 1 else 1.0)) <= km


def _stays(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    mmsi, pos0, pos1 = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(mmsi, kind), pa.array(pos0, pa.int64()), pa.array(pos1, pa.int64())], ["mmsi", "pos0", "pos1"])
