"""The driver's tables seen as position reports, pixels, particles and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as reports: a vessel per user, positions and channels by arithmetic on ids."""
    e, c = table(spark, sf_dir, "events"), F.col
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select(
        c("user_id").cast("string").alias("mmsi"),
        c("event_id").alias("ord"),
        us.alias("us"),
        (15 + 0.01 * (c("user_id") % 50) + 0.001 * (k - 50)).alias("lat"),
        (73 + 0.01 * (c("user_id") % 40) + 0.001 * ((c("event_id") * 13) % 100 - 50)).alias("lon"),
        (c("value") / 10).alias("sog"),
        ((c("event_id") * 17) % 360).cast("double").alias("cog"),
        F.when(c("event_type") != "error", ((c("event_id") * 29) % 360).cast("double")).alias("heading"),
    )


AIS_SQL = """ais AS (SELECT CAST(user_id AS VARCHAR) mmsi, event_id ord, epoch_us(ts) us,
    15 + 1e-2 * (user_id % 50) + 1e-3 * (k - 50) lat, 73 + 1e-2 * (user_id % 40) + 1e-3 * ((event_id * 13) % 100 - 50) lon,
    value / 10 sog, CAST((event_id * 17) % 360 AS DOUBLE) cog, CASE WHEN event_type <> 'error' THEN CAST((event_id * 29) % 360 AS DOUBLE) END heading
    FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) k FROM events))"""


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as text, some of them damaged, for the parsers."""
    a, c = ais(spark, sf_dir), F.col
    odd = lambda n, bad, good: F.when(c("ord") % n == 0, bad).otherwise(good)
    return a.select(
        odd(89, F.lit("  "), F.concat(F.lit(" "), c("mmsi"))).alias("mmsi"),
        odd(83, F.lit("yesterday"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        odd(97, F.lit("99"), c("lat").cast("string")).alias("latitude"),
        c("lon").cast("string").alias("longitude"),
        odd(101, F.lit("-1"), odd(103, F.lit("fast"), c("sog").cast("string"))).alias("sog"),
        odd(107, F.lit("361"), c("cog").cast("string")).alias("cog"),
        c("heading").cast("string").alias("heading"),
        "ord",
    )


ERROR_SQL = "CASE WHEN ord % 89 = 0 THEN 'mmsi is blank' WHEN ord % 83 = 0 THEN 'timestamp is not readable' WHEN ord % 97 = 0 THEN 'latitude is not in -90..90' WHEN ord % 101 = 0 THEN 'sog is negative' WHEN ord % 107 = 0 THEN 'cog is not in 0..360'{} END"


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case per region: origins and observations by arithmetic, release times at the table's earliest report and on."""
    t0 = table(spark, sf_dir, "events").agg(F.min(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))).first()[0] or 0
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(F.concat(F.lit("OT-2026-000"), k.cast("string")).alias("case_id"), (15.1 + 0.05 * k).alias("origin_lat"), (73.05 + 0.04 * k).alias("origin_lon"), (15.3 + 0.02 * k).alias("observed_lat"), (73.3 - 0.03 * k).alias("observed_lon"), (F.lit(t0) + k.cast("long") * 86_400_000_000).alias("release_us"))


SCENARIO_SQL = """scn AS (SELECT 'OT-2026-000' || r_regionkey case_id, 15.1::DOUBLE + 5e-2 * r_regionkey olat, 73.05::DOUBLE + 4e-2 * r_regionkey olon,
    15.3::DOUBLE + 2e-2 * r_regionkey vlat, 73.3::DOUBLE - 3e-2 * r_regionkey vlon, (SELECT min(epoch_us(ts)) FROM events) + r_regionkey::BIGINT * 86400000000 rus FROM region)"""


#: Order numbers whose line items make one scene.
SCENE_ORDERS = 1500


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a scene of 64 x 96 per SCENE_ORDERS order numbers, so that scenes are as many as the table is long and
    alike at every size; ``v`` is a linear backscatter, ``on`` a mask."""
    c = F.col
    li = table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / F.lit(SCENE_ORDERS)).cast("long").alias("scene_id"), (c("l_partkey") % 64).alias("y"), ((c("l_orderkey") * 7 + c("l_linenumber") * 13) % 96).alias("x"), c("l_quantity").alias("q"))
    return li.groupBy("scene_id", "y", "x").agg(F.max("q").alias("top")).select("scene_id", "y", "x", (c("top") / 50.0).alias("v"), (c("top") > 30).alias("on"))


PIXEL_SQL = f"""px AS (SELECT CAST(l_orderkey // {SCENE_ORDERS} AS BIGINT) scene_id, l_partkey % 64 y, (l_orderkey * 7 + l_linenumber * 13) % 96 x, max(l_quantity) / 50.0::DOUBLE v, max(l_quantity) > 30 AS "on" FROM lineitem GROUP BY 1, 2, 3)"""
HEIGHT, WIDTH = 64, 96


def evidence_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("excerpt"))
