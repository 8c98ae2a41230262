"""Level lines of densities on a grid, with interpolated crossings, and unions of polygons.

A grid has a fixed number of nodes, so one group's lines are bounded; sides are found by DataFrame operations, cell by cell, and only a
group's sides meet in one task to be strung to rings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.operators.blocks import _walked

#: Corners of a cell, counter-clockwise from the lower left, as (up, right).
_CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
#: Sides between a corner and the next: node that numbers it, as (up, right), and its way (0: to the right, 1: up).
_SIDES = ((0, 0, 0), (0, 1, 1), (1, 0, 0), (0, 0, 1))
_RINGS = "array<array<struct<lon:double,lat:double>>>"


def segments(grid: DataFrame, by: str, cells: int, share: float = 0.5) -> DataFrame:
    """``(by, u, v, lat, lon)``: sides of the lines where ``grid(by, gy, gx, lat, lon, density)`` crosses ``share`` of its group's maximum.

    A side goes from crossing ``u``, at (lat, lon), to crossing ``v``; what is denser lies on its left.  A crossing is numbered by the pair of neighbouring
    nodes that it lies between, and placed by linear interpolation.  Where two opposite corners of a cell are denser they are kept apart.  Beyond the
    grid the density counts as 0, so all lines are closed.
    """
    axis = lambda c: [F.min(c).alias(f"{c}0"), ((F.max(c) - F.min(c)) / (cells - 1)).alias(f"{c}1")]
    told = grid.groupBy(by).agg((share * F.max("density")).alias("level"), *axis("lat"), *axis("lon"))
    # each node is a corner of four cells, numbered by their lower left nodes from -1 on
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), F.lit(right).alias("right")) for k, (up, right) in enumerate(_CORNERS)]))
    of = grid.select(by, "gy", "gx", "density", corner.alias("c")).select(by, (F.col("gy") - F.col("c.up")).alias("cy"), (F.col("gx") - F.col("c.right")).alias("cx"), F.col("c.k").alias("k"), "density")
    cell = of.groupBy(by, "cy", "cx").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("density"))), F.lit(0.0)).alias(f"d{k}") for k in range(4)]).join(told, by)
    high = [F.col(f"d{k}") >= F.col("level") for k in range(4)]

    def number(k: int) -> Column:
        up, right, way = _SIDES[k % 4]
        return (((F.col("cy") + up + 1) * (cells + 2) + F.col("cx") + right + 1) * 2 + way).cast("long")

    def side(k: int) -> Column:
        """From where the line leaves denser ground, side k, to where the same stretch of denser corners began."""
        up, right, way = _SIDES[k]
        first, second = (k, (k + 1) % 4) if k in (0, 1) else ((k + 1) % 4, k)  # in the order of node numbers
        part = (F.col("level") - F.col(f"d{first}")) / (F.col(f"d{second}") - F.col(f"d{first}"))
        y, x = F.col("cy") + up + (part if way else 0), F.col("cx") + right + (0 if way else part)
        to = F.when(~high[k - 1], number(k + 3)).when(~high[k - 2], number(k + 2)).otherwise(number(k + 1))
        return F.when(high[k] & ~high[(k + 1) % 4], F.struct(number(k).alias("u"), to.alias("v"), (F.col("lat0") + y * F.col("lat1")).alias("lat"), (F.col("lon0") + x * F.col("lon1")).alias("lon")))

    found = F.filter(F.array(*[side(k) for k in range(4)]), lambda s: s.isNotNull())
    return cell.select(by, F.inline(found))


def _area(ring: np.ndarray) -> float:
    """Of a closed ring of (lon, lat): positive if it runs counter-clockwise."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _windings(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often the sides a -> b go round each point, counter-clockwise."""
    out = np.zeros(len(points), np.int64)
    for at in range(0, len(points), 1024):
        p = points[at : at + 1024, None]
        turn = (b[:, 0] - a[:, 0]) * (p[..., 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[..., 0] - a[:, 0])
        up, down = (a[:, 1] <= p[..., 1]) & (b[:, 1] > p[..., 1]), (a[:, 1] > p[..., 1]) & (b[:, 1] <= p[..., 1])
        out[at : at + 1024] = (up & (turn > 0)).sum(1) - (down & (turn < 0)).sum(1)
    return out


def _parts(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Closed rings that don't cross as polygons: an outer ring, counter-clockwise, and the holes in it, clockwise."""
    outer = sorted((r for r in rings if _area(r) > 0), key=_area)
    parts = [[r] for r in outer]
    for hole in (r for r in rings if _area(r) < 0):
        middle = (hole[:1] + hole[1:2]) / 2
        for k, r in enumerate(outer):  # the smallest that it lies in
            if _area(r) > -_area(hole) and _windings(middle, r[:-1], r[1:])[0]:
                parts[k].append(hole)
                break
    return sorted(parts, key=lambda p: (-_area(p[0]), *p[0].min(0)))


def _as_rows(key: pa.ChunkedArray, by: str, parts: list[list[np.ndarray]]) -> pa.Table:
    line = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
    told = [[[{"lon": x, "lat": y} for x, y in ring.tolist()] for ring in part] for part in parts]
    return pa.table({by: pa.array([key[0].as_py()] * len(parts), key.type), "part": pa.array(range(len(parts)), pa.int32()), "rings": pa.array(told, line)})


def polygons(sides: DataFrame, by: str) -> DataFrame:
    """``(by, part, rings)`` of :func:`segments`: closed rings of (lon, lat) structs, an outer one and its holes; the largest part first."""

    def strung(table: pa.Table) -> pa.Table:
        order = np.argsort(table["u"].to_numpy())
        ids, after = table["u"].to_numpy()[order], table["v"].to_numpy()[order]
        at = np.stack([table["lon"].to_numpy()[order], table["lat"].to_numpy()[order]], 1)
        rings = [at[np.append(path, path[0])] for path, _ in _walked(ids, after)]
        return _as_rows(table[by], by, _parts([r for r in rings if len(r) > 3]))

    kind = sides.schema[by].dataType.simpleString()
    return sides.groupBy(by).applyInArrow(strung, f"{by} {kind}, part int, rings {_RINGS}")


# ---- unions


def _split(a: np.ndarray, b: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Sides a -> b cut where they meet others: at crossings, at ends of others that lie on them, and where they run along others."""
    d = b - a
    length = np.maximum(np.hypot(*d.T), 1e-300)
    cuts: list[list[float]] = [[] for _ in a]
    for i in range(len(a)):
        # ends of other sides on this one
        for ends in (a, b):
            t = ((ends - a[i]) @ d[i]) / length[i] ** 2
            off = np.abs(d[i, 0] * (ends[:, 1] - a[i, 1]) - d[i, 1] * (ends[:, 0] - a[i, 0])) / length[i]
            cuts[i] += t[(off <= near) & (t * length[i] > near) & ((1 - t) * length[i] > near)].tolist()
        det = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        slanted = np.flatnonzero(np.abs(det) > 1e-12 * length[i] * length)
        w = a[slanted] - a[i]
        t = (w[:, 0] * d[slanted, 1] - w[:, 1] * d[slanted, 0]) / det[slanted]
        s = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / det[slanted]
        inside = (t * length[i] > near) & ((1 - t) * length[i] > near) & (s * length[slanted] > -near) & ((1 - s) * length[slanted] > -near)
        cuts[i] += t[inside].tolist()
    first, last = [], []
    for i, ts in enumerate(cuts):
        stops = [0.0]
        for t in sorted(ts):
            if (t - stops[-1]) * length[i] > near:
                stops.append(t)
        points = [a[i] + d[i] * t for t in stops] + [b[i]]
        first += points[:-1]
        last += points[1:]
    return np.array(first).reshape(-1, 2), np.array(last).reshape(-1, 2)


def united(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The union of what closed rings enclose, whichever way they run: polygons as in :func:`polygons`.

    Sides are cut where they meet; a piece stays if nothing lies on its right and something on its left; pieces are strung to rings that take
    the sharpest right turn, so polygons that touch in a point alone stay apart.
    """
    rings = [r if _area(r) > 0 else r[::-1] for r in rings if len(r) > 3 and _area(r)]
    if not rings:
        return []
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    keep = (a != b).any(1)
    a, b = a[keep], b[keep]
    size = np.ptp(a, axis=0).max()
    near = 1e-10 * size
    p, q = _split(a, b, near)
    grid = lambda x: np.round(x / (4 * near)).astype(np.int64)  # noqa: E731  ends that are one but for rounding
    _, first = np.unique(np.concatenate([grid(p), grid(q)], 1), axis=0, return_index=True)
    p, q = p[first], q[first]
    d = q - p
    normal = np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(*d.T)[:, None]
    middle, off = (p + q) / 2, 20 * near
    stays = (_windings(middle + off * normal, a, b) > 0) & (_windings(middle - off * normal, a, b) == 0)
    p, q, d = p[stays], q[stays], d[stays]
    angle = np.arctan2(d[:, 1], d[:, 0])
    starts: dict[tuple, list[int]] = {}
    for i, k in enumerate(map(tuple, grid(p).tolist())):
        starts.setdefault(k, []).append(i)
    left, out, ends = np.ones(len(p), bool), [], list(map(tuple, grid(q).tolist()))
    for i in range(len(p)):
        path, at = [], i
        while left[at]:
            left[at] = False
            path.append(at)
            ways = [j for j in starts.get(ends[at], ()) if left[j]]
            if not ways:
                break
            at = min(ways, key=lambda j: (angle[j] - angle[at] + np.pi) % (2 * np.pi))  # noqa: B023
        if len(path) > 2:
            ring = p[path]
            before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
            bent = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-9 * np.hypot(*before.T) * np.hypot(*after.T)
            ring = ring[bent]
            out.append(np.concatenate([ring, ring[:1]]))
    return _parts([r for r in out if len(r) > 3])


def union(shapes: DataFrame, by: str) -> DataFrame:
    """``(by, part, rings)``: the union of each group's polygons ``(by, rings)``, of which the first ring counts, as a Polygon or several.

    A group's sides are in one task, so a group should be what belongs together, as the contours of one ensemble.  Rings without area
    or with NULLs are passed over; a group without any has no row.
    """
    outer = shapes.select(by, F.col("rings")[0].alias("ring")).where("ring is not null")

    def joined(table: pa.Table) -> pa.Table:
        rings = [np.array([(x["lon"], x["lat"]) for x in r], float) for r in table["ring"].to_pylist()]
        rings = [r for r in rings if len(r) and np.isfinite(r).all()]
        return _as_rows(table[by], by, united([r if (r[0] == r[-1]).all() else np.append(r, r[:1], 0) for r in rings]))

    kind = shapes.schema[by].dataType.simpleString()
    return outer.groupBy(by).applyInArrow(joined, f"{by} {kind}, part int, rings {_RINGS}")
