import math
import random

import numpy as np
import pytest

from tidewake.operators import contours, drift


def grid_of(spark, fields):
    rows = [(g, y, x, 10 + 0.5 * y, 70 + 0.25 * x, float(v)) for g, m in fields.items() for y, row in enumerate(m) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "g long, gy int, gx int, lat double, lon double, density double").repartition(3)


def rings(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.g, {})[r.part] = [np.array([(p.lon, p.lat) for p in ring]) for ring in r.rings]
    return {g: [p[k] for k in sorted(p)] for g, p in out.items()}


def net(parts):
    return sum(contours._area(r) for part in parts for r in part)


def test_half_peak_of_a_gaussian(spark):
    y, x = np.mgrid[0:50, 0:50]
    q = lambda sy, sx: np.exp(-(((y - 24.3) / sy) ** 2 + ((x - 25.1) / sx) ** 2) / 2)
    two = np.exp(-(((y - 12) / 3) ** 2 + ((x - 12) / 3) ** 2) / 2) + np.exp(-(((y - 36) / 3) ** 2 + ((x - 36) / 4) ** 2) / 2)
    got = rings(contours.polygons(contours.segments(grid_of(spark, {1: q(5, 8), 2: two}), "g", 50), "g"))
    assert len(got[1]) == 1 and len(got[1][0]) == 1 and net(got[1]) / 0.125 == pytest.approx(2 * math.pi * math.log(2) * 5 * 8, rel=0.01)
    assert [len(p) for p in got[2]] == [1, 1] and net(got[2]) / 0.125 == pytest.approx(2 * math.pi * math.log(2) * (9 + 12), rel=0.02)


def test_holes_islands_saddles_and_edges(spark):
    y, x = np.mgrid[0:50, 0:50]
    r = np.hypot(y - 25, x - 25)
    ring = np.where((r > 8) & (r < 18), 1.0, 0.0) + (r < 4)
    saddle = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 0]])
    fields = {1: ring, 3: np.ones((50, 50))}
    got = rings(contours.polygons(contours.segments(grid_of(spark, fields), "g", 50), "g"))
    assert [len(p) for p in got[1]] == [2, 1] and all(contours._area(p[0]) > 0 for p in got[1]) and contours._area(got[1][0][1]) < 0
    whole = contours.union(contours.polygons(contours.segments(grid_of(spark, fields), "g", 50), "g"), "g")
    assert [len(p) for p in rings(whole)[1]] == [1] and net(rings(whole)[1]) == pytest.approx(contours._area(got[1][0][0]))
    assert net(got[3]) / 0.125 == pytest.approx(50 * 50 - 0.5)  # half a cell beyond the nodes, corners cut
    sides = contours.segments(grid_of(spark, {1: saddle}), "g", 3).collect()
    apart = rings(contours.polygons(contours.segments(grid_of(spark, {1: saddle}), "g", 3), "g"))
    assert len(sides) == 8 and len(apart[1]) == 2 and {s.u for s in sides} == {s.v for s in sides}
    rng = np.random.default_rng(4)
    noise = {k: rng.random((12, 12)) for k in range(6)}
    for g, parts in rings(contours.polygons(contours.segments(grid_of(spark, noise), "g", 12), "g")).items():
        inside = lambda py, px: sum(contours._windings(np.array([[70 + 0.25 * px, 10 + 0.5 * py]]), r[:-1], r[1:])[0] for p in parts for r in p)  # noqa: B023, E731
        m = noise[g]
        assert all(inside(a, b) == (m[a, b] >= m.max() / 2) for a in range(12) for b in range(12))


def boxes(rng, n, size):
    out = []
    for _ in range(n):
        x, y, w, h = rng.randint(0, size), rng.randint(0, size), rng.randint(1, 9), rng.randint(1, 9)
        out.append(np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float))
    return out


@pytest.mark.parametrize("n,size", [(2, 6), (6, 10), (30, 25), (60, 15)])
def test_unions_of_boxes_that_touch_and_overlap(n, size):
    rng = random.Random(n)
    for _ in range(25):
        rs = [r[:: rng.choice((1, -1))] for r in boxes(rng, n, size)]
        on = np.zeros((size + 20, size + 20), bool)
        for r in rs:
            (x0, y0), (x1, y1) = r.min(0).astype(int), r.max(0).astype(int)
            on[y0:y1, x0:x1] = True
        parts = contours.united(rs)
        assert net(parts) == pytest.approx(on.sum())
        edge = np.pad(on, 1).astype(int)
        assert sum(np.abs(np.diff(r, axis=0)).sum() for p in parts for r in p) == pytest.approx(np.abs(np.diff(edge, axis=0)).sum() + np.abs(np.diff(edge, axis=1)).sum())
        assert all(contours._area(p[0]) > 0 and all(contours._area(h) < 0 for h in p[1:]) for p in parts)


def test_unions_of_slanted_polygons():
    rng = np.random.default_rng(6)
    for _ in range(20):
        shapes = []
        for _ in range(8):
            t = np.sort(rng.random(rng.integers(3, 9))) * 2 * np.pi
            ring = np.stack([np.cos(t), np.sin(t)], 1) * rng.random() * 0.5 + rng.random(2)
            shapes.append(np.append(ring, ring[:1], 0))
        parts = contours.united(shapes)
        at = rng.random((4000, 2)) * 2 - 0.5
        truth = np.any([contours._windings(at, r[:-1], r[1:]) != 0 for r in shapes], axis=0)
        got = sum(contours._windings(at, r[:-1], r[1:]) for p in parts for r in p)
        assert np.array_equal(got, truth.astype(int))
    assert contours.united([]) == [] and contours.united([np.zeros((5, 2))]) == []


def test_unions_as_tables(spark):
    box = lambda x, y: [[{"lon": x + a, "lat": y + b} for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))]]
    rows = [(1, box(0.0, 0.0)), (1, box(1.0, 1.0)), (1, box(5.0, 5.0)), (2, box(0.0, 0.0)), (2, box(0.0, 0.0)), (3, None), (4, [[]]), (None, box(1.0, 1.0))]
    frame = spark.createDataFrame(rows, "g long, rings array<array<struct<lon:double,lat:double>>>")
    got = rings(contours.union(frame, "g"))
    assert {g: [contours._area(p[0]) for p in parts] for g, parts in got.items()} == {1: [7, 4], 2: [4], None: [4]}
    assert contours.union(frame.limit(0), "g").count() == 0


def test_regions_of_particles(spark):
    rng = np.random.default_rng(9)
    rows = [(1, float(a), float(b)) for a, b in rng.normal(size=(4000, 2)) * (0.3, 0.5) + (20, 60)] + [(2, 1.0, 2.0)] + [(3, float(k), float(k)) for k in range(9)]
    p = spark.createDataFrame(rows, "g long, lat double, lon double")
    got = rings(drift.region_contours(p, "g"))
    h2 = 1 + 4000 ** (-1 / 3)  # the kernel's variance comes on top
    assert len(got[1]) == 1 and net(got[1]) == pytest.approx(2 * math.pi * math.log(2) * 0.3 * 0.5 * h2, rel=0.05)
    assert set(got) == {1, 2, 3} and all(len(got[k]) == 1 for k in (2, 3))
