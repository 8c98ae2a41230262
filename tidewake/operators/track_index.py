"""A stored index of track legs in Hilbert order, and searches of paths, not envelopes.

A leg is a pair of consecutive reports, a straight line in degrees.  Files hold legs along a Hilbert curve, so each file and row group covers a
small box, and the statistics that Parquet keeps let a search pass over those that can't meet its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators.tracks import with_neighbours

#: Bits of the curve on each axis.
BITS = 16
BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def legs(points: DataFrame, chunk_hours: float | None = None) -> DataFrame:
    """``(mmsi, pos, us0, us1, lat0, lon0, lat1, lon1)`` and the box of each leg; ``pos`` is its first report's.  Reports without a
    position end a leg; tracks with one report have none."""
    rows = with_neighbours(points.select("mmsi", "us", "ord", "lat", "lon"), "us", "lat", "lon", chunk_hours=chunk_hours)
    named = rows.where("lat is not null and lon is not null and next_lat is not null and next_lon is not null")
    named = named.select("mmsi", "pos", F.col("us").alias("us0"), F.col("next_us").alias("us1"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.col("next_lat").alias("lat1"), F.col("next_lon").alias("lon1"))
    return named.withColumns({f"{f}_{c}": getattr(F, g)(f"{c}0", f"{c}1") for f, g in (("min", "least"), ("max", "greatest")) for c in ("lat", "lon")})


def hilbert(x: str, y: str) -> Column:
    """Where on a Hilbert curve through a square of 2**BITS cells a side the cell (x, y) comes, bit by bit from the highest.

    In the lower quadrants the curve's part is mirrored at the diagonal, in the lower right one at the other diagonal.
    """
    q = "shiftleft(1L, b)"
    rx, ry = f"(CASE WHEN (s.x & {q}) <> 0 THEN 1 ELSE 0 END)", f"(CASE WHEN (s.y & {q}) <> 0 THEN 1 ELSE 0 END)"
    low = lambda c: f"(s.{c} & ({q} - 1))"
    flip = lambda c: f"(CASE WHEN {rx} = 1 THEN {q} - 1 - {low(c)} ELSE {low(c)} END)"
    return F.expr(f"aggregate(sequence({BITS - 1}, 0), named_struct('x', cast({x} as long), 'y', cast({y} as long), 'd', 0L), (s, b) -> named_struct('x', CASE WHEN {ry} = 0 THEN {flip('y')} ELSE {low('x')} END, 'y', CASE WHEN {ry} = 0 THEN {flip('x')} ELSE {low('y')} END, 'd', s.d + {q} * {q} * cast((3 * {rx}) ^ {ry} as long)), s -> s.d)")


def write(points: DataFrame, path: str, files: int = 64, chunk_hours: float | None = None) -> None:
    """The legs of ``points`` as an index at ``path``: ``files`` ranges of the curve, in its order within each."""
    cell = lambda c, low, span: F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor((F.col(f"{c}0") + F.col(f"{c}1") - 2 * low) / 2 / span * (1 << BITS))))
    rows = legs(points, chunk_hours).withColumns({"cx": cell("lon", -180.0, 360.0), "cy": cell("lat", -90.0, 180.0)})
    keyed = rows.withColumn("curve", hilbert("cx", "cy")).drop("cx", "cy")
    keyed.repartitionByRange(files, "curve", "mmsi", "pos").sortWithinPartitions("curve", "mmsi", "pos").write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("curve")


def _clipped(box: list[Column]) -> tuple[Column, Column]:
    """The shares of a leg at which its line enters and leaves a closed box; it meets the box if the first is not above the second."""
    x0, y0, x1, y1 = box
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, low, high in (("lon0", "lon1", x0, x1), ("lat0", "lat1", y0, y1)):
        d = F.col(b) - F.col(a)
        first, second = (low - F.col(a)) / d, (high - F.col(a)) / d
        out = (F.col(a) < low) | (F.col(a) > high)  # with d = 0 it never enters
        lows.append(F.when(d == 0, F.when(out, 2.0).otherwise(0.0)).otherwise(F.least(first, second)))
        highs.append(F.when(d == 0, 1.0).otherwise(F.greatest(first, second)))
    return F.greatest(*lows), F.least(*highs)


def _meets(box: list[Column]) -> Column:
    """Boxes that meet, as plain comparisons, so that they reach the files' statistics."""
    return (F.col("max_lon") >= box[0]) & (F.col("max_lat") >= box[1]) & (F.col("min_lon") <= box[2]) & (F.col("min_lat") <= box[3])


def through_box(index: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """``(mmsi, pos, enters_us, leaves_us)`` of legs whose line meets the closed box, in the closed stretch of time if one is given."""
    box = [F.lit(float(v)) for v in (min_lon, min_lat, max_lon, max_lat)]
    near = index.where(_meets(box))
    near = near if start_us is None else near.where(F.col("us1") >= start_us)
    near = near if end_us is None else near.where(F.col("us0") <= end_us)
    enter, leave = _clipped(box)
    at = lambda t: F.col("us0") + F.round(t * (F.col("us1") - F.col("us0"))).cast("long")
    out = near.withColumns({"enter": enter, "leave": leave}).where("enter <= leave").select("mmsi", "pos", at(F.col("enter")).alias("enters_us"), at(F.col("leave")).alias("leaves_us"))
    out = out if start_us is None else out.where(F.col("leaves_us") >= start_us)
    return out if end_us is None else out.where(F.col("enters_us") <= end_us)


def within(index: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """``(mmsi, pos, km)`` of legs that come within ``km`` of a point: the distance of their lines, on the flat at its latitude."""
    dy = km / geo.KM_PER_DEGREE
    scale = F.cos(F.radians(F.lit(float(lat))))
    box = [F.lit(float(lon)) - dy / scale, F.lit(lat - dy), F.lit(float(lon)) + dy / scale, F.lit(lat + dy)]
    x = lambda c: (F.col(c) - lon) * geo.KM_PER_DEGREE * scale
    y = lambda c: (F.col(c) - lat) * geo.KM_PER_DEGREE
    dx, dy_, xx, yy = x("lon1") - x("lon0"), y("lat1") - y("lat0"), x("lon0"), y("lat0")
    size = dx * dx + dy_ * dy_
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(xx * dx + yy * dy_) / size))).otherwise(0.0)
    return index.where(_meets(box)).select("mmsi", "pos", F.hypot(xx + t * dx, yy + t * dy_).alias("km")).where(F.col("km") <= km)


def through_boxes(index: DataFrame, boxes: DataFrame, cell: float = 0.25) -> DataFrame:
    """``(box_id, mmsi, pos)`` of every box ``(box_id, min_lon, min_lat, max_lon, max_lat)`` and leg whose line meets it.

    Both enter the grid cells that their boxes cover and meet by equality of cells; a pair counts in the cell of the lower left corner of what
    the two boxes share, so none comes twice.
    """
    def cells(df: DataFrame, p: str) -> DataFrame:
        c = lambda name: F.floor(F.col(p + name) / cell)
        return df.withColumn("cx", F.explode(F.sequence(c("min_lon"), c("max_lon")))).withColumn("cy", F.explode(F.sequence(c("min_lat"), c("max_lat"))))

    b = boxes.select("box_id", *[F.col(n).alias("b_" + n) for n in BOX])
    met = cells(index, "").join(cells(b, "b_"), ["cx", "cy"])
    own = (F.floor(F.greatest("min_lon", "b_min_lon") / cell) == F.col("cx")) & (F.floor(F.greatest("min_lat", "b_min_lat") / cell) == F.col("cy"))
    box = [F.col("b_" + n) for n in BOX]
    enter, leave = _clipped(box)
    return met.where(own & _meets(box)).where(enter <= leave).select("box_id", "mmsi", "pos")
