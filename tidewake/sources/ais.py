"""Position reports from CSV or Parquet: parsing, validity, rejects.

``strict`` follows the interactive service (headers trimmed and lower-cased, ISO timestamps with offsets, an unparsable
optional number rejects the row, no de-duplication); ``lenient`` follows the batch library (four fixed timestamp
formats, an unparsable optional number is NULL).  Timestamp columns pass as they are, numbers are seconds since 1970, and
whatever has no zone is UTC, whatever the session's is.  ``ingested`` makes the batch library's data set of reports: the first
of equal ones stays, tracks have two points or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import tracks

REQUIRED = ("mmsi", "timestamp", "latitude", "longitude")
OPTIONAL_NUMBERS = ("sog", "cog", "heading")
OPTIONAL_TEXT = ("imo", "vessel_type")
# Timestamp layouts of the lenient mode, as (shape, format).
LAYOUTS = ((r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "yyyy-MM-dd HH:mm:ss"), (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", "yyyy-MM-dd'T'HH:mm:ss"), (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"), (r"\d{4}-\d\d-\d\d", "yyyy-MM-dd"))


def _number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def _time(text: Column, mode: str) -> Column:
    if mode == "strict":
        iso = F.trim(text)
        zoned = F.when(iso.rlike(r"(Z|[+-]\d\d:?\d\d)$"), iso).otherwise(F.concat(iso, F.when(iso.rlike(r"^\d{4}-\d\d-\d\d$"), F.lit("T00:00:00Z")).otherwise(F.lit("Z"))))
        return F.when(iso.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d(:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:?\d\d)?)?$"), zoned.try_cast("timestamp"))
    out = F.lit(None).cast("timestamp")
    for shape, layout in LAYOUTS:
        out = F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(layout + "X"))).otherwise(out)
    return out


def _utc(raw: DataFrame, name: str, mode: str) -> Column:
    """The timestamp of a column of any type: instants stay, numbers are seconds, text is parsed."""
    kind, c = dict(raw.dtypes)[name], F.col(name)
    if kind == "timestamp":
        return c
    if kind == "timestamp_ntz":
        return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`))")
    if kind == "date":
        return F.timestamp_micros(F.unix_date(c).cast("long") * 86_400_000_000)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.timestamp_micros(F.round(c.cast("double") * 1_000_000).cast("long"))
    return _time(c.cast("string"), mode)


def normalised(raw: DataFrame) -> DataFrame:
    """Headers without byte-order mark and spaces, lower-cased."""
    return raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])


def parsed(raw: DataFrame, mode: str = "lenient") -> DataFrame:
    """All rows with typed columns and ``error`` (NULL if valid); a missing required column is a ValueError."""
    raw = normalised(raw) if mode == "strict" else raw
    if missing := sorted(set(REQUIRED) - set(raw.columns)):
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    text = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    blank = lambda c: text(c).isNull() | (text(c) == "")
    numbers = {c: F.when(~blank(c), _number(text(c))) for c in OPTIONAL_NUMBERS}
    rest = {c: F.nullif(F.trim(text(c)) if mode == "lenient" else text(c), F.lit("")) for c in OPTIONAL_TEXT}
    kept = ["_ord"] if "_ord" in raw.columns else []
    out = raw.select(*kept, F.trim(text("mmsi")).alias("mmsi"), _utc(raw, "timestamp", mode).alias("ts"), _number(text("latitude")).alias("lat"), _number(text("longitude")).alias("lon"), *[v.alias(k) for k, v in (numbers | rest).items()], *[(~blank(c) & numbers[c].isNull()).alias(f"bad_{c}") for c in OPTIONAL_NUMBERS])
    error = F.when(F.coalesce(F.col("mmsi"), F.lit("")) == "", "mmsi is blank").when(F.col("ts").isNull(), "timestamp is not readable").when(~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "latitude is not in -90..90").when(~F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), "longitude is not in -180..180").when(F.col("sog") < 0, "sog is negative")
    for c in ("cog", "heading"):
        error = error.when(~F.col(c).between(0, 360), f"{c} is not in 0..360")
    if mode == "strict":
        for c in OPTIONAL_NUMBERS:
            error = error.when(F.col(f"bad_{c}"), f"{c} is not a number")
    return out.withColumn("error", error).drop(*[f"bad_{c}" for c in OPTIONAL_NUMBERS])


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid points, rejects with their error)."""
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def ingested(raw: DataFrame, order: Column | None = None, mode: str = "lenient") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, tracks, rejects) of raw reports in one go.

    Of valid reports with equal vessel, time and position (six places) the first by ``order`` stays, by default the first
    in the table as it is read; tracks are the summaries of vessels with two points or more.
    """
    numbered = raw.withColumn("_ord", F.monotonically_increasing_id() if order is None else order)
    rows = parsed(numbered, mode)
    good, bad = split(rows)
    points = tracks.deduplicate(good.withColumn("us", F.unix_micros("ts")).withColumnRenamed("_ord", "ord"))
    return points, tracks.envelopes(points), bad.drop("_ord")


def read_csv(spark: SparkSession, path: str, mode: str = "lenient") -> DataFrame:
    return parsed(spark.read.option("header", True).option("inferSchema", False).csv(path), mode)


def read_parquet(spark: SparkSession, path: str, mode: str = "lenient") -> DataFrame:
    """NULL optionals stay NULL; only the columns of a report are read."""
    return parsed(spark.read.parquet(path), mode)


def read_observation(spark: SparkSession, path: str) -> DataFrame:
    """Satellite metadata sidecars (JSON): captured_at, sensor, source_uri (default: the path), bbox, and the rest as a map."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "map<string,string>").alias("m"))
    fixed = ["captured_at", "sensor", "source_uri", "bbox"]
    out = raw.select(_time(F.col("m")["captured_at"], "strict").alias("captured_at"), F.col("m")["sensor"].alias("sensor"), F.coalesce(F.col("m")["source_uri"], "path").alias("source_uri"), F.from_json(F.col("m")["bbox"], "array<double>").alias("bbox"), F.map_filter("m", lambda k, v: ~k.isin(fixed)).alias("metadata"))
    return out.withColumn("error", F.when(F.col("captured_at").isNull(), "captured_at is missing or not readable").when(F.col("sensor").isNull(), "sensor is missing"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Product manifests (XML): product type, first start and stop time, last orbit direction, by local tag name."""
    tag = lambda name: F.regexp_extract_all("value", F.lit(rf"<(?:[\w.-]+:)?\w*{name}\w*[^>]*>\s*([^<]*?)\s*<"), F.lit(1))
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.try_element_at(tag("productType"), F.lit(-1)).alias("product_type"), F.try_element_at(tag("startTime"), F.lit(1)).alias("start_time"), F.try_element_at(tag("stopTime"), F.lit(1)).alias("stop_time"), F.try_element_at(tag("orbitDirection"), F.lit(-1)).alias("orbit_direction"))
