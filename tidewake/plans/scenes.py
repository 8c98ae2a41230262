"""Registered queries of raster files and of scorers that see a neighbourhood."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import blocks
from tidewake.plans.adapters import HEIGHT, PIXEL_SQL, WIDTH, pixels
from tidewake.plans.registry import query
from tidewake.scratch import fresh
from tidewake.sources import geotiff

SIDE = 32
AFFINE = (100.0, 0.0, 500_000.0, 0.0, -100.0, 1_660_000.0)


def _files(spark: SparkSession, d: str, name: str) -> str:
    """A folder with the scenes of ``lineitem`` as GeoTIFF files, tiled, deflated, on a UTM grid."""
    folder = fresh(spark, "tiff")
    made = blocks.blocks_of(pixels(spark, d), HEIGHT, WIDTH, SIDE)
    geotiff.write(made, folder, HEIGHT, WIDTH, SIDE, AFFINE, 32643, acquired="2026:01:01 00:00:00", name=name).count()
    return folder


def _scene(path: str):
    return F.regexp_extract(path, r"scene_(\d+)\.", 1).cast("long").alias("scene_id")


_V = "round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6)"


@query(f"WITH {PIXEL_SQL} SELECT scene_id, y, x, {_V} AS vv FROM px")
def geotiff_pixels(spark: SparkSession, d: str) -> DataFrame:
    _, chunks = geotiff.read(spark, _files(spark, d, "scene_{}.tif"))
    flat = geotiff.pixels(geotiff.blocks(chunks))
    return flat.select(_scene("path"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round(F.col("v").cast("double"), 6).alias("vv"))


@query(f"WITH {PIXEL_SQL} SELECT DISTINCT scene_id, {WIDTH} AS width, {HEIGHT} AS height, 1 AS bands, 32643 AS epsg, 100.0::DOUBLE AS pixel, 500000.0::DOUBLE AS left_edge, '2026:01:01 00:00:00' AS acquired FROM px")
def geotiff_headers(spark: SparkSession, d: str) -> DataFrame:
    heads, _ = geotiff.read(spark, _files(spark, d, "scene_{}.tif"))
    return heads.select(_scene("path"), "width", "height", "bands", "epsg", F.col("affine.a").alias("pixel"), F.col("affine.c").alias("left_edge"), "acquired")


@query(f"WITH {PIXEL_SQL} SELECT scene_id, y, x, {_V} AS vv FROM px WHERE 500000 + 100 * (x + 0.5) BETWEEN 503300 AND 506000 AND 1660000 - 100 * (y + 0.5) BETWEEN 1658000 AND 1659000")
def geotiff_box(spark: SparkSession, d: str) -> DataFrame:
    """Pixels whose centres lie in a box of metres: of six tiles a file, one is read."""
    _, chunks = geotiff.read(spark, _files(spark, d, "scene_{}.tif"))
    flat = geotiff.pixels(geotiff.blocks(geotiff.in_box(chunks, 503_300, 1_658_000, 506_000, 1_659_000)))
    inside = (500_000 + 100 * (F.col("x") + 0.5)).between(503_300, 506_000) & (1_660_000 - 100 * (F.col("y") + 0.5)).between(1_658_000, 1_659_000)
    return flat.where(inside).select(_scene("path"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round(F.col("v").cast("double"), 6).alias("vv"))


@query(f"WITH {PIXEL_SQL} SELECT scene_id, count(*) AS n, round(sum({_V}), 4) AS vv, min(y) AS min_y, max(x) AS max_x FROM px GROUP BY scene_id")
def safe_products(spark: SparkSession, d: str) -> DataFrame:
    """Products of which each has a vv measurement alone, found below one folder."""
    found = geotiff.products(spark, _files(spark, d, "scene_{}.SAFE/measurement/s1-vv.tiff"))
    flat = geotiff.product_pixels(found).withColumn("vv", F.round(F.col("v").cast("double"), 6))
    return flat.groupBy(_scene("product")).agg(F.count("*").alias("n"), F.round(F.sum("vv"), 4).alias("vv"), F.min(F.col("y").cast("long")).alias("min_y"), F.max(F.col("x").cast("long")).alias("max_x"))


# ---- scorers that see a neighbourhood


def smoothing(reach: int = 2, gain: float = 8.0) -> blocks.Convolutions:
    """One convolution: the mean of a pixel's surroundings by inverse squared distance plus one, made steep around one half."""
    dy, dx = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    w = 1 / (1.0 + dy * dy + dx * dx)
    return blocks.Convolutions((((gain * w / w.sum())[None, None], np.array([-gain / 2])),))


_W = sum(1 / (1.0 + i * i + j * j) for i in range(-2, 3) for j in range(-2, 3))
_P = f"""{PIXEL_SQL}, o AS (SELECT i, j, 8 / (1.0::DOUBLE + i * i + j * j) / {_W!r}::DOUBLE w FROM (SELECT unnest(generate_series(-2, 2)) i), (SELECT unnest(generate_series(-2, 2)) j)),
g AS (SELECT * FROM (SELECT DISTINCT scene_id FROM px), (SELECT unnest(generate_series(0, {HEIGHT - 1})) y), (SELECT unnest(generate_series(0, {WIDTH - 1})) x)),
s AS (SELECT scene_id, y - i y, x - j x, sum(w * v) z FROM px, o GROUP BY ALL),
p AS (SELECT g.*, 1 / (1 + exp(4 - coalesce(z, 0))) p FROM g LEFT JOIN s USING (scene_id, y, x))"""


@query(f"WITH {_P} SELECT scene_id, y, x, round(p, 6) AS p FROM p")
def segment_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Whole scenes, scored tile by tile with 32 pixels of their surroundings."""
    p = blocks.scored(blocks.blocks_of(pixels(spark, d), HEIGHT, WIDTH, SIDE), HEIGHT, WIDTH, smoothing(), SIDE, 0, 32)
    return blocks.pixels_of(p, "scene_id", value="p").select("scene_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("p", 6).alias("p"))


@query(f"WITH {_P}, c AS (SELECT scene_id, coalesce(avg(CASE WHEN p > 0.5 THEN p END), 0) confidence FROM p GROUP BY scene_id) SELECT scene_id, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence > 0.3 THEN 'medium' ELSE 'low' END AS uncertainty FROM c")
def segment_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = blocks.scored(blocks.blocks_of(pixels(spark, d), HEIGHT, WIDTH), HEIGHT, WIDTH, smoothing(), overlap=0)
    return blocks.confidence(blocks.pixels_of(p, "scene_id", value="p")).select("scene_id", F.round("confidence", 6).alias("confidence"), "uncertainty")
