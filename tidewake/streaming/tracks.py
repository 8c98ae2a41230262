"""Track operators on streams of position reports ``(mmsi, ts, lat, lon, sog)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speed_windows(reports: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean and top speed per vessel and window; reports later than ``late`` are dropped by the watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = reports.withWatermark("ts", late).groupBy(w.alias("w"), "mmsi").agg(F.count("*").alias("n"), F.avg("sog").alias("mean_sog"), F.max("sog").alias("max_sog"))
    return out.select("mmsi", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_sog", "max_sog")


def voyages(reports: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Stretches of reports without a longer gap (session windows): the streaming form of gap detection."""
    s = F.session_window("ts", gap)
    out = reports.withWatermark("ts", late).groupBy(s.alias("s"), "mmsi").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("mmsi", "first", "last", "n")
