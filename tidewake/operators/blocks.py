"""Rasters as blocks ``(scene_id, band, y0, x0, h, w, v)``, rectangles of a scene row by row, for what needs a neighbourhood.

A block is a row, so Spark deals scenes of any size; a task sees one block or tile with its margin at a time.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.components import components
from tidewake.scratch import saved

#: Side of a block.
SIDE = 512


def blocks_of(pixels: DataFrame, height: int, width: int, side: int = SIDE, value: str = "v") -> DataFrame:
    """Pixels ``(scene_id[, band], y, x, v)`` as blocks on a grid of ``side``; v is array<double>, NaN where there is no pixel.

    Blocks without pixels don't appear.  Of a pixel that comes twice the greatest value counts.  One shuffle, by block.
    """
    kind = pixels.schema["scene_id"].dataType.simpleString()
    band = F.col("band").cast("int") if "band" in pixels.columns else F.lit(1)
    rows = pixels.select("scene_id", band.alias("band"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v"), F.floor(F.col("y") / side).cast("int").alias("by"), F.floor(F.col("x") / side).cast("int").alias("bx"))
    rows = rows.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))

    def make(table: pa.Table) -> pa.Table:
        y0, x0 = table["by"][0].as_py() * side, table["bx"][0].as_py() * side
        h, w = min(side, height - y0), min(side, width - x0)
        out = np.full(h * w, np.nan)
        np.fmax.at(out, (table["y"].to_numpy() - y0) * w + table["x"].to_numpy() - x0, table["v"].to_numpy())
        one = {"scene_id": table["scene_id"][:1].combine_chunks(), "band": table["band"][:1].combine_chunks()} | {k: pa.array([v], pa.int32()) for k, v in (("y0", y0), ("x0", x0), ("h", h), ("w", w))}
        return pa.table(one | {"v": pa.array([out], pa.list_(pa.float64()))})

    return rows.groupBy("scene_id", "band", "by", "bx").applyInArrow(make, f"scene_id {kind}, band int, y0 int, x0 int, h int, w int, v array<double>")


def pixels_of(table: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """``(keys, y, x, v)`` of all pixels of blocks that have a value.  No shuffle."""
    each = table.select(*keys, "y0", "x0", "w", F.posexplode(value).alias("i", value)).where(~F.isnan(value))
    return each.select(*keys, (F.col("y0") + F.expr("i div w").cast("int")).alias("y"), (F.col("x0") + F.col("i") % F.col("w")).alias("x"), value)


# ---- scorers that see a neighbourhood

#: (bands, height, width) -> (height, width) of probabilities.
Scorer = Callable[[np.ndarray], np.ndarray]


@dataclasses.dataclass(frozen=True)
class Convolutions:
    """A scorer: convolutions (kernel (out, in, rows, columns) of odd sides, bias (out)) that keep the size, with zeros beyond the edge; what is
    negative becomes 0 between them, and the logistic function of the last one's first band is the probability."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    @property
    def reach(self) -> int:
        """How far from a pixel the ones lie that decide its probability."""
        return sum(max(k.shape[2:]) // 2 for k, _ in self.layers)

    def __call__(self, matrix: np.ndarray) -> np.ndarray:
        x = np.asarray(matrix, float)
        for i, (kernel, bias) in enumerate(self.layers):
            x = np.maximum(x, 0) if i else x
            _, _, rows, columns = kernel.shape
            h, w = x.shape[1:]
            padded = np.pad(x, ((0, 0), (rows // 2,) * 2, (columns // 2,) * 2))
            out = np.broadcast_to(np.asarray(bias, float)[:, None, None], (len(kernel), h, w)).copy()
            for dy in range(rows):
                for dx in range(columns):
                    out += np.tensordot(kernel[:, :, dy, dx], padded[:, dy : dy + h, dx : dx + w], axes=1)
            x = out
        return 1 / (1 + np.exp(-x[0]))


def segmented_array(matrix: np.ndarray, scorer: Scorer, multiple: int = 32) -> np.ndarray:
    """Probabilities of a (bands, height, width) array: divided by its maximum if that is above 1, continued by its mirror image at the bottom
    and the right to a multiple of ``multiple``, scored, and cut back."""
    most = matrix.max(initial=0.0)
    matrix = matrix / (most + 1e-8) if most > 1 else matrix
    h, w = matrix.shape[1:]
    padded = np.pad(matrix, ((0, 0), (0, -h % multiple), (0, -w % multiple)), mode="reflect")
    return scorer(padded)[:h, :w]


def _spans(low: int, high: int, size: int, tile: int, step: int, halo: int) -> Iterator[tuple[int, int, int]]:
    """(tile, begin, end) of the tiles whose stretch, margin included, meets [low, high)."""
    for k in range(max(0, (low - halo - tile) // step + 1), min(math.ceil(size / step), (high + halo - 1) // step + 1)):
        begin, end = max(0, k * step - halo), min(size, k * step + tile + halo)
        if begin < high and end > low:
            yield k, begin, end


def scored(table: DataFrame, height: int, width: int, scorer: Scorer, tile: int = SIDE, overlap: int = 32, halo: int = 0, multiple: int = 32) -> DataFrame:
    """Probabilities of blocks ``(scene_id, band, y0, x0, h, w, v)``: blocks ``(scene_id, y0, x0, h, w, p)``, a tile each.

    Tiles start every tile - overlap pixels and are scored as whole matrices by :func:`segmented_array`; where they overlap, p has several
    values, to be averaged (:func:`stitched`).  With ``halo`` (and no overlap) a tile sees that many pixels of its neighbours on all sides, which are
    cut off again: if the scorer reaches no farther, and tile and halo are multiples of ``multiple``, p is what scoring the whole scene gives.

    Blocks send each tile only the part that it needs; one shuffle, by tile.  Missing pixels and NaN count as 0, missing bands, too.
    """
    if halo and overlap:
        raise ValueError("tiles have either an overlap or a halo")
    kind, step = table.schema["scene_id"].dataType.simpleString(), tile - overlap
    names = ["scene_id", "ty", "tx", "band", "y0", "x0", "h", "w", "v"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band, y0, x0, h, w = (batch.column(c)[i].as_py() for c in ("band", "y0", "x0", "h", "w"))
                v = batch.column("v")[i].values.to_numpy(zero_copy_only=False).reshape(h, w)
                rows = []
                for ty, a, b in _spans(y0, y0 + h, height, tile, step, halo):
                    for tx, c, d in _spans(x0, x0 + w, width, tile, step, halo):
                        y, x = max(a, y0), max(c, x0)
                        part = v[y - y0 : b - y0, x - x0 : d - x0]
                        rows.append((ty, tx, band, y, x, *part.shape, part.ravel()))
                if rows:
                    parts = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("scene_id")[i].as_py()] * len(rows), batch.column("scene_id").type), *(pa.array(p, pa.int32()) for p in parts[:-1]), pa.array(parts[-1], pa.list_(pa.float64()))], names)

    def score(group: pa.Table) -> pa.Table:
        ty, tx = group["ty"][0].as_py(), group["tx"][0].as_py()
        y0, x0 = max(0, ty * step - halo), max(0, tx * step - halo)
        y1, x1 = min(height, ty * step + tile + halo), min(width, tx * step + tile + halo)
        matrix = np.zeros((max(group["band"].to_pylist()), y1 - y0, x1 - x0))
        for band, y, x, h, w, v in zip(*(group[c] for c in ("band", "y0", "x0", "h", "w", "v"))):
            y, x, h, w = y.as_py() - y0, x.as_py() - x0, h.as_py(), w.as_py()
            matrix[band.as_py() - 1, y : y + h, x : x + w] = np.nan_to_num(v.values.to_numpy(zero_copy_only=False).reshape(h, w))
        p = segmented_array(matrix, scorer, multiple)
        own = (ty * step, min(height, ty * step + tile), tx * step, min(width, tx * step + tile))
        p = p[own[0] - y0 : own[1] - y0, own[2] - x0 : own[3] - x0]
        ints = {"y0": own[0], "x0": own[2], "h": p.shape[0], "w": p.shape[1]}
        return pa.table({"scene_id": group["scene_id"][:1].combine_chunks()} | {k: pa.array([n], pa.int32()) for k, n in ints.items()} | {"p": pa.array([p.ravel()], pa.list_(pa.float64()))})

    whole = table.select("scene_id", "band", "y0", "x0", "h", "w", F.col("v").cast("array<double>").alias("v"))
    parts = whole.mapInArrow(cut, f"scene_id {kind}, ty int, tx int, band int, y0 int, x0 int, h int, w int, v array<double>")
    return parts.groupBy("scene_id", "ty", "tx").applyInArrow(score, f"scene_id {kind}, y0 int, x0 int, h int, w int, p array<double>")


def stitched(table: DataFrame) -> DataFrame:
    """``(scene_id, y, x, p)``: the mean over tiles of each pixel."""
    return pixels_of(table, "scene_id", value="p").groupBy("scene_id", "y", "x").agg(F.avg("p").alias("p"))


def confidence(p: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(scene_id, confidence, uncertainty)`` of pixels ``(scene_id, y, x, p)``: the mean p above the threshold, 0 if none is, and its level.

    A p that is above it by no more than what the order of a sum changes (1e-12) is at it, not above.
    """
    mean = F.coalesce(F.avg(F.when(F.col("p") - threshold > 1e-12, F.col("p"))), F.lit(0.0))
    level = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") > 0.3, "medium").otherwise("low")
    return p.groupBy("scene_id").agg(mean.alias("confidence")).withColumn("uncertainty", level)


# ---- components


def _least_reached(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that edges (u, v) lead to: roots are hooked to smaller ones, and paths are halved."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def labelled(mask: DataFrame, width: int, side: int = SIDE) -> DataFrame:
    """``(scene_id, y, x, component)`` of set pixels ``(scene_id, y, x)``, joined by their four neighbours; scenes never join.

    ``scene_id`` is a number; a component is the smallest pixel number, scene_id * 2**40 + y * width + x, in it.  Each block is labelled on its
    own; then only labels that touch across the borders of blocks are joined, a table of borders, not of pixels.
    """
    number = (F.col("scene_id").cast("long") * (1 << 40) + F.col("y") * width + F.col("x")).cast("long")
    kinds = {c: mask.schema[c].dataType.simpleString() for c in ("scene_id", "y", "x")}
    at = mask.select("scene_id", "y", "x", number.alias("id"), F.floor(F.col("y") / side).alias("by"), F.floor(F.col("x") / side).alias("bx"))

    def label(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table["id"].to_numpy(), return_index=True)
        x = table["x"].to_numpy()[first]

        def next_to(far: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            to = np.minimum(np.searchsorted(ids, ids + far), len(ids) - 1)
            hit = np.flatnonzero((ids[to] == ids + far) & inside)
            return hit, to[hit]

        (a, b), (c, d) = next_to(1, (x % side < side - 1) & (x < width - 1)), next_to(width, np.ones(len(ids), bool))
        same = _least_reached(len(ids), np.append(a, c), np.append(b, d))
        out = table.take(pa.array(first)).select(["scene_id", "y", "x"])
        return out.append_column("component", pa.array(ids[same], pa.int64()))

    own = at.groupBy("scene_id", "by", "bx").applyInArrow(label, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", component long")
    own = saved(own, "labels")
    edges = None
    for along in ("x", "y"):
        before = own.where(F.col(along) % side == side - 1).withColumn(along, (F.col(along) + 1).cast(kinds[along])).withColumnRenamed("component", "u")
        behind = own.where((F.col(along) % side == 0) & (F.col(along) > 0)).withColumnRenamed("component", "v")
        met = before.join(behind, ["scene_id", "y", "x"]).select("u", "v").distinct()
        edges = met if edges is None else edges.unionByName(met)
    edges = saved(edges, "borders")
    if edges.isEmpty():
        return own
    joined = components(edges).withColumnRenamed("component", "root")
    return own.join(joined, F.col("component") == F.col("node"), "left").select("scene_id", "y", "x", F.coalesce("root", "component").alias("component"))


# ---- outlines

#: Ways along a pixel's sides with the pixel on the right hand: east on its top, south, west, north; rows grow downwards.
_AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
#: Corner of a pixel, as (down, right), at which each way ends.
_ENDS = ((0, 1), (1, 1), (1, 0), (0, 0))


def _walked(ids: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, int | None]]:
    """Paths along ``after`` as positions in sorted ``ids``, with the id that an open path goes on to; closed ones start at their least."""
    to = np.minimum(np.searchsorted(ids, after), len(ids) - 1)
    here = ids[to] == after
    has_before = np.zeros(len(ids), bool)
    has_before[to[here]] = True
    step, seen = np.where(here, to, -1).tolist(), np.zeros(len(ids), bool)
    for start in [*np.flatnonzero(~has_before).tolist(), *range(len(ids))]:
        if seen[start]:
            continue
        path, at = [], start
        while at >= 0 and not seen[at]:
            seen[at] = True
            path.append(at)
            at = step[at]
        yield np.array(path), None if at >= 0 else int(after[path[-1]])


def outlines(lab: DataFrame, width: int, affine: tuple[float, float, float, float, float, float], side: int = SIDE) -> DataFrame:
    """``(scene_id, component, rings)`` of labelled pixels: closed rings of (lon, lat) structs along pixel sides, the outer one first.

    ``affine`` maps corners (x, y) to coordinates.  Rings have their turns only; pixels that touch in a corner alone are apart.
    Each open side of a pixel knows the side that follows it from its eight neighbours.  A block, with one pixel around it, is walked on its own;
    paths that leave a block are joined to rings as components, and put in order by doubling how far each looks ahead.
    """
    a, b, c, d, e, f = affine
    kind = lab.schema["scene_id"].dataType.simpleString()
    home = lambda dy, dx: F.struct(F.floor((F.col("y") + dy) / side).cast("int").alias("by"), F.floor((F.col("x") + dx) / side).cast("int").alias("bx"))
    near = F.explode(F.array_distinct(F.array(*[home(p, q) for p in (-1, 0, 1) for q in (-1, 0, 1)])))
    rows = lab.select("scene_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "component", near.alias("k")).select("scene_id", "y", "x", "component", "k.*")
    line = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))

    def trace(table: pa.Table) -> pa.Table:
        by, bx = table["by"][0].as_py(), table["bx"][0].as_py()
        y, x, component = table["y"].to_numpy(), table["x"].to_numpy(), table["component"].to_numpy()
        on = np.zeros((side + 4, side + 4), bool)
        ly, lx = y - by * side + 2, x - bx * side + 2
        on[ly, lx] = True
        own = np.flatnonzero((y // side == by) & (x // side == bx))
        scene = table["scene_id"][0].as_py()
        number = (int(scene) << 40) + y[own] * width + x[own]
        has = lambda p, q: on[ly[own] + p, lx[own] + q]
        ids, after, of, corner = [], [], [], []
        for k in range(4):
            (fy, fx), (oy, ox), (ey, ex) = _AHEAD[k], _AHEAD[k - 1], _ENDS[k]
            moved = lambda p, q, way: (number + p * width + q) * 4 + way % 4  # noqa: B023, E731
            then = np.where(~has(fy, fx), moved(0, 0, k + 1), np.where(~has(fy + oy, fx + ox), moved(fy, fx, k), moved(fy + oy, fx + ox, k - 1)))
            open_ = np.flatnonzero(~has(oy, ox))
            ids.append(moved(0, 0, k)[open_])
            after.append(then[open_])
            of.append(own[open_])
            corner.append(np.stack([y[own[open_]] + ey, x[own[open_]] + ex], 1))
        ids, after, of, corner = (np.concatenate(p) for p in (ids, after, of, corner))
        order = np.argsort(ids)
        ids, after, of, corner = ids[order], after[order], of[order], corner[order]
        lon, lat = a * corner[:, 1] + b * corner[:, 0] + c, d * corner[:, 1] + e * corner[:, 0] + f
        turns = ids % 4 != after % 4
        out = []
        for path, to in _walked(ids, after) if len(ids) else ():
            low = int(path.argmin())
            bent = path[turns[path]]
            out.append({"scene_id": scene, "component": int(component[of[path[0]]]), "head": int(ids[path[0]]), "to": to, "low": int(ids[path[low]]), "before": int(turns[path[:low]].sum()), "line": [{"lon": p, "lat": q} for p, q in zip(lon[bent].tolist(), lat[bent].tolist())]})
        return pa.Table.from_pylist(out, pa.schema([("scene_id", table.schema.field("scene_id").type), ("component", pa.int64()), ("head", pa.int64()), ("to", pa.int64()), ("low", pa.int64()), ("before", pa.int32()), ("line", line)]))

    ddl = f"scene_id {kind}, component long, head long, to long, low long, before int, line array<struct<lon:double,lat:double>>"
    paths = saved(rows.groupBy("scene_id", "by", "bx").applyInArrow(trace, ddl), "paths")
    open_ = paths.where("to is not null")
    rings = paths.where("to is null").select("scene_id", "component", F.col("low").alias("ring"), "line")
    if not open_.isEmpty():
        rings = rings.unionByName(_joined_paths(open_))
    closed = F.concat("line", F.slice("line", 1, 1))
    return rings.groupBy("scene_id", "component").agg(F.sort_array(F.collect_list(F.struct("ring", closed.alias("line")))).alias("r")).select("scene_id", "component", F.transform("r", lambda x: x["line"]).alias("rings"))


def _joined_paths(paths: DataFrame) -> DataFrame:
    """Rings of paths that go on in other blocks; each starts at its least side."""
    of = components(paths.select(F.col("head").alias("u"), F.col("to").alias("v"))).withColumnRenamed("component", "group")
    rows = paths.join(of, F.col("head") == F.col("node"), "left").withColumn("group", F.coalesce("group", "head")).drop("node")
    first = rows.groupBy("group").agg(F.min_by("head", "low").alias("start"), F.min("low").alias("ring"))
    rows = saved(rows.join(first, "group"), "rings")
    ahead = saved(rows.select("head", F.when(F.col("to") != F.col("start"), F.col("to")).alias("next"), F.lit(1).cast("long").alias("left")), "ahead")
    while not ahead.where("next is not null").isEmpty():
        far = ahead.select(F.col("head").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        ahead = saved(ahead.join(far, "next", "left").select("head", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "ahead")
    part = F.struct((-F.col("left")).alias("at"), "before", "line")
    whole = rows.join(ahead.select("head", "left"), "head").groupBy("scene_id", "component", "ring").agg(F.sort_array(F.collect_list(part)).alias("p"))
    line, skip = F.flatten(F.transform("p", lambda x: x["line"])), F.col("p")[0]["before"]
    return whole.select("scene_id", "component", "ring", F.concat(F.slice(line, skip + 1, F.size(line)), F.slice(line, F.lit(1), skip)).alias("line"))
