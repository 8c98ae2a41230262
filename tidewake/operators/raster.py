"""Raster operators over pixel tables ``(scene_id, y, x, v)``; tiles, masks and components are rows, too."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import geodesy
from tidewake.operators import blocks
from tidewake.operators.blocks import labelled
from tidewake.scratch import saved

KEYS = ("scene_id", "y", "x")
#: Pixels of a new grid whose table of weights is broadcast at most.
FEW = 1 << 16


def calibrated(v: Column, vector: Column) -> Column:
    return v * F.coalesce(vector, F.lit(1.0))


def to_db(v: Column) -> Column:
    return 10 * F.log10(v + 1e-10)


def normalised(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))


def tiles(pixels: DataFrame, height: int, width: int, tile: int = 512, overlap: int = 32) -> DataFrame:
    """Each pixel with every tile that holds it: ``(.., tile_row, tile_col)``; tiles start every tile - overlap pixels."""
    step = tile - overlap
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - (tile - 1)) / step)).cast("long"), F.least(F.lit(math.ceil(n / step) - 1), F.floor(F.col(c) / step)).cast("long"))
    return pixels.withColumn("tile_row", F.explode(span("y", height))).withColumn("tile_col", F.explode(span("x", width)))


def stitched(predictions: DataFrame, value: str = "v") -> DataFrame:
    """The mean over tiles of each pixel."""
    return predictions.groupBy(*KEYS).agg(F.avg(value).alias(value))


def _around(mask: DataFrame) -> DataFrame:
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return mask.withColumn("s", shift).select("scene_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))


def closed(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Set pixels ``(scene_id, y, x)`` after 3 x 3 dilation and erosion; beyond the edge nothing is set, so edge pixels go."""
    inside = (F.col("y").between(0, height - 1)) & (F.col("x").between(0, width - 1))
    grown = _around(mask.select(*KEYS)).where(inside).distinct()
    return _around(grown).groupBy(*KEYS).agg(F.count("*").alias("n")).where(inside & (F.col("n") == 9)).select(*KEYS)


def component_sizes(mask: DataFrame, width: int) -> DataFrame:
    return labelled(mask, width).groupBy("scene_id", "component").agg(F.count("*").alias("size"))


def postprocessed(pixels: DataFrame, height: int, width: int, min_area: int = 50, max_hole: int = 100) -> DataFrame:
    """Set pixels of a mask ``(scene_id, y, x, on)``: small components go, small holes are filled, then closing.

    Background components below ``max_hole`` are holes even at the edge.
    """
    def of_size(rows, keep):
        lab = labelled(rows, width)
        sized = lab.groupBy("component").agg(F.count("*").alias("n"))
        return lab.join(sized.where(keep), "component", "left_semi").select(*KEYS)

    on = of_size(pixels.where("on"), F.col("n") >= min_area)
    off = pixels.select(*KEYS).join(on, list(KEYS), "left_anti")
    return closed(on.unionByName(of_size(off, F.col("n") < max_hole)), height, width)


def polygons(mask: DataFrame, width: int, affine: tuple[float, float, float, float, float, float], probability: DataFrame | None = None, degrees: bool = False) -> DataFrame:
    """Measured components: pixels, area and perimeter (km), centroid and box, mean probability (0.5 without).

    ``affine`` maps (x, y) to metres: (a x + b y + c, d x + e y + f).  With ``degrees`` it maps them to (lon, lat), north up, and
    areas and lengths are those on the ellipsoid.  The perimeter adds pixel sides on the outline.
    """
    a, b, c, d, e, f = affine
    lab = labelled(mask, width)
    sides = ("side", "top", "bottom")
    near = lambda dy, dx, hit: lab.select("scene_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), *[F.lit(int(s == hit)).alias(s) for s in sides])
    touching = near(0, 1, "side").unionByName(near(0, -1, "side")).unionByName(near(1, 0, "top")).unionByName(near(-1, 0, "bottom")).groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in sides])
    rows = lab.join(touching, list(KEYS), "left").withColumns({s: F.lit(2 if s == "side" else 1) - F.coalesce(s, F.lit(0)) for s in sides})
    rows = rows.withColumns({"px": a * (F.col("x") + 0.5) + b * (F.col("y") + 0.5) + c, "py": d * (F.col("x") + 0.5) + e * (F.col("y") + 0.5) + f})
    rows = rows.join(probability.select(*KEYS, "p"), list(KEYS), "left") if probability is not None else rows.withColumn("p", F.lit(None).cast("double"))
    if degrees:
        zero, high, low = F.lit(0.0), F.col("py") + abs(e) / 2, F.col("py") - abs(e) / 2
        area = geodesy.AUTHALIC_KM**2 * math.radians(abs(a)) * (F.sin(geodesy.authalic(high)) - F.sin(geodesy.authalic(low)))
        along = lambda lat: geodesy.geodesic_km(lat, zero, lat, F.lit(abs(a)))
        outline = F.col("side") * geodesy.geodesic_km(low, zero, high, zero) + F.col("top") * along(high if e < 0 else low) + F.col("bottom") * along(low if e < 0 else high)
    else:
        side = math.sqrt(abs(a * e - b * d))
        area, outline = F.lit(side * side / 1e6), (F.col("side") + F.col("top") + F.col("bottom")) * (side / 1e3)
    return rows.groupBy("scene_id", "component").agg(F.count("*").alias("pixels"), F.sum(area).alias("area_km2"), F.sum(outline).alias("perimeter_km"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.min("px").alias("min_x"), F.max("px").alias("max_x"), F.min("py").alias("min_y"), F.max("py").alias("max_y"), F.coalesce(F.avg("p"), F.lit(0.5)).alias("confidence"))


def outlines(mask: DataFrame, width: int, affine: tuple[float, float, float, float, float, float], side: int = blocks.SIDE) -> DataFrame:
    """``(scene_id, component, rings)`` of set pixels; see :func:`tidewake.operators.blocks.outlines`."""
    return blocks.outlines(labelled(mask, width, side), width, affine, side)


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: the mean of values where the mask is set; 0 if it is nowhere."""
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(0.0))


def valid_scene(scene: Column, crs: str = "EPSG:4326") -> Column:
    """Whether a scene's struct (crs, affine struct a..f) has that reference system and a usable transform: neither identity nor flat."""
    a = scene["affine"]
    identity = (a["a"] == 1) & (a["b"] == 0) & (a["c"] == 0) & (a["d"] == 0) & (a["e"] == 1) & (a["f"] == 0)
    return F.coalesce((scene["crs"] == crs) & ~identity & (F.abs(a["a"]) >= 1e-10) & (F.abs(a["e"]) >= 1e-10), F.lit(False))


def reprojected(pixels: DataFrame, affine: tuple[float, float, float, float, float, float], zone: int | Callable[[Column, Column], tuple[Column, Column]], degrees: tuple[float, float, float, float, float, float], height: int, width: int) -> DataFrame:
    """Pixels ``(scene_id, y, x, v)`` of a map's grid on a grid of degrees, ``height`` x ``width``, by bilinear weights.

    ``zone`` is a UTM zone in the north, or a function of (lat, lon) to the map's coordinates, as :func:`tidewake.functions.geodesy.projection` gives
    by EPSG code.  ``affine`` maps (x, y) to those coordinates and ``degrees`` maps the new (x, y) to (lon, lat).  Each new pixel looks up the four old ones
    around its centre by an equi-join; where some are missing the weights of the others count, and without any it is left out.

    Which old pixels a new one takes, and their weights, are the same for all scenes: that table is made once and met on (y, x).  Up to ``FEW`` new
    pixels it is broadcast, and the pixels that it names are dealt by scene; a larger one is shuffled, whatever size Spark takes it for.
    """
    a, b, c, d, e, f = affine
    lon0, lat0 = degrees[2], degrees[5]
    place = lambda op: F.expr(f"id {op} {width}L")
    grid = pixels.sparkSession.range(height * width).select(place("div").alias("ty"), place("%").alias("tx"))
    u, v = F.col("tx") + 0.5, F.col("ty") + 0.5
    at = grid.withColumns({"lon": degrees[0] * u + degrees[1] * v + lon0, "lat": degrees[3] * u + degrees[4] * v + lat0})
    east, north = zone(F.col("lat"), F.col("lon")) if callable(zone) else geodesy.to_utm(F.col("lat"), F.col("lon"), F.lit(zone))
    det, de, dn = a * e - b * d, F.col("east") - c, F.col("north") - f
    at = at.withColumns({"east": east, "north": north}).select("ty", "tx", ((e * de - b * dn) / det - 0.5).alias("px"), ((a * dn - d * de) / det - 0.5).alias("py"))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    near = at.withColumn("k", corners).select("ty", "tx", "px", "py", (F.floor("px") + F.col("k.i")).alias("x"), (F.floor("py") + F.col("k.j")).alias("y"))
    near = near.select("y", "x", "ty", "tx", ((1 - F.abs(F.col("px") - F.col("x"))) * (1 - F.abs(F.col("py") - F.col("y")))).alias("w"))
    old = pixels.where(F.col("scene_id").isNotNull()).select(*KEYS, "v")
    few = height * width <= FEW
    if few:
        old = old.join(F.broadcast(near.select("y", "x").distinct()), ["y", "x"], "left_semi").repartition("scene_id")
    met = old.join(F.broadcast(near) if few else near.hint("merge"), ["y", "x"])
    return met.groupBy("scene_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def levels(pixels: DataFrame, low: float = -25.0, high: float = 5.0, vector: Column | None = None) -> DataFrame:
    """``(scene_id, y, x, level)``: pixels calibrated, in dB, and normalised to 0 .. 1."""
    return pixels.select(*KEYS, normalised(to_db(calibrated(F.col("v"), F.lit(None).cast("double") if vector is None else vector)), low, high).alias("level"))


def measured(whole: DataFrame, height: int, width: int, affine: tuple[float, float, float, float, float, float], min_area_km2: float = 0.001, min_area: int = 50, max_hole: int = 100, degrees: bool = False) -> DataFrame:
    """Measured slicks of probabilities ``(scene_id, y, x, p)``: set above one half, cleaned, measured."""
    mask = saved(postprocessed(whole.withColumn("on", F.col("p") > 0.5), height, width, min_area, max_hole), "mask")
    return polygons(mask, width, affine, whole, degrees).where(F.col("area_km2") >= min_area_km2)


def segmented(pixels: DataFrame, height: int, width: int, affine: tuple[float, float, float, float, float, float], scorer: Callable[[Column], Column], tile: int = 512, overlap: int = 32, low: float = -25.0, high: float = 5.0, vector: Column | None = None, min_area_km2: float = 0.001, min_area: int = 50, max_hole: int = 100, degrees: bool = False) -> DataFrame:
    """Measured slicks of scenes ``(scene_id, y, x, v)``: calibrated, in dB, normalised, tiled, scored, stitched, cleaned, measured.

    ``scorer`` makes a probability of a pixel's normalised value; :func:`segmented_tiles` takes scorers that see a whole tile.
    """
    scored = tiles(levels(pixels, low, high, vector), height, width, tile, overlap).withColumn("p", scorer(F.col("level")))
    return measured(saved(stitched(scored, "p"), "stitched"), height, width, affine, min_area_km2, min_area, max_hole, degrees)


def segmented_tiles(pixels: DataFrame, height: int, width: int, affine: tuple[float, float, float, float, float, float], scorer: blocks.Scorer, tile: int = 512, overlap: int = 32, halo: int = 0, low: float = -25.0, high: float = 5.0, vector: Column | None = None, min_area_km2: float = 0.001, min_area: int = 50, max_hole: int = 100, degrees: bool = False) -> DataFrame:
    """:func:`segmented` with a scorer of matrices, which sees a tile and its ``halo`` at once (:func:`tidewake.operators.blocks.scored`)."""
    made = blocks.blocks_of(levels(pixels, low, high, vector), height, width, tile, "level")
    p = blocks.scored(made, height, width, scorer, tile, overlap, halo)
    whole = blocks.pixels_of(p, "scene_id", value="p") if overlap == 0 else blocks.stitched(p)
    return measured(saved(whole, "stitched"), height, width, affine, min_area_km2, min_area, max_hole, degrees)


def segmentation_summary(slicks: DataFrame) -> DataFrame:
    """Per scene: slicks, total area, mean confidence, and its level: low up to 0.3, high from 0.8."""
    s = slicks.groupBy("scene_id").agg(F.count("*").alias("slicks"), F.sum("area_km2").alias("area_km2"), F.avg("confidence").alias("confidence"))
    return s.withColumn("level", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") > 0.3, "medium").otherwise("low"))
