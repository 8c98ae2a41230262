import duckdb
import numpy as np
import pytest

from tidewake.operators import blocks, raster
from tidewake.plans import catalog
from tidewake.plans.scenes import smoothing


def pixel_table(spark, scenes, set_only=False):
    rows = [(s, y, x, float(v)) for s, m in scenes.items() for y, row in enumerate(m) for x, v in enumerate(row) if v == v and (v or not set_only)]
    return spark.createDataFrame(rows, "scene_id long, y long, x long, v double").repartition(5)


def image(rows, key, h, w, value):
    out = {}
    for r in rows:
        out.setdefault(r[key], np.full((h, w), np.nan))[r["y"], r["x"]] = r[value]
    return out


def test_pixels_and_blocks_round_trip(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 70))
    a[rng.random((50, 70)) < 0.3] = np.nan
    a[32:, :32] = np.nan
    frame = pixel_table(spark, {4: a})
    made = blocks.blocks_of(frame.unionByName(frame.limit(5).withColumn("v", F_minus(frame))), 50, 70, 32)
    assert made.count() == 5 and {(r.y0, r.x0, r.h, r.w) for r in made.collect()} == {(0, 0, 32, 32), (0, 32, 32, 32), (0, 64, 32, 6), (32, 32, 18, 32), (32, 64, 18, 6)}
    assert np.array_equal(image(blocks.pixels_of(made, "scene_id").collect(), "scene_id", 50, 70, "v")[4], a, equal_nan=True)


def F_minus(frame):
    return frame["v"] - 1


def two_layers(seed=0):
    rng = np.random.default_rng(seed)
    return blocks.Convolutions(((rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3)), (rng.normal(size=(1, 3, 5, 5)) / 9, np.zeros(1))))


def test_convolutions_equal_loops():
    rng = np.random.default_rng(3)
    m, s = rng.normal(size=(2, 7, 9)), two_layers()
    x = m
    for i, (k, b) in enumerate(s.layers):
        x = np.maximum(x, 0) if i else x
        r = k.shape[2] // 2
        out = np.zeros((len(k), 7, 9))
        for o in range(len(k)):
            for y in range(7):
                for z in range(9):
                    out[o, y, z] = b[o] + sum(k[o, c, dy + r, dx + r] * x[c, y + dy, z + dx] for c in range(len(x)) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if 0 <= y + dy < 7 and 0 <= z + dx < 9)
        x = out
    assert np.allclose(s(m), 1 / (1 + np.exp(-x[0]))) and s.reach == 3


@pytest.mark.parametrize("height,width", [(96, 160), (70, 101), (20, 33)])
def test_tiles_with_a_halo_equal_the_whole_scene(spark, height, width):
    rng, s = np.random.default_rng(height), two_layers()
    scenes = {k: rng.random((2, height, width)) for k in (0, 3)}
    rows = [(k, b + 1, y, x, float(m[b, y, x])) for k, m in scenes.items() for b in range(2) for y in range(height) for x in range(width)]
    frame = spark.createDataFrame(rows, "scene_id long, band int, y int, x int, v double")
    p = blocks.scored(blocks.blocks_of(frame, height, width, 48), height, width, s, tile=64, overlap=0, halo=32)
    got = image(blocks.pixels_of(p, "scene_id", value="p").collect(), "scene_id", height, width, "p")
    for k, m in scenes.items():
        assert np.allclose(got[k], blocks.segmented_array(m, s), atol=1e-12)


def test_overlapping_tiles_are_averaged(spark):
    rng, s, (h, w, tile, overlap) = np.random.default_rng(5), smoothing(), (50, 75, 32, 8)
    m = rng.random((h, w)) * 3
    m[3:6, 4:9] = np.nan
    total, n = np.zeros((h, w)), np.zeros((h, w))
    for y in range(0, h, tile - overlap):
        for x in range(0, w, tile - overlap):
            part = np.nan_to_num(m[y : y + tile, x : x + tile])
            part = part / (part.max() + 1e-8) if part.max() > 1 else part
            ph, pw = part.shape
            padded = np.pad(part, ((0, -ph % 32), (0, -pw % 32)), mode="reflect")
            total[y : y + tile, x : x + tile] += s(padded[None])[:ph, :pw]
            n[y : y + tile, x : x + tile] += 1
    p = blocks.stitched(blocks.scored(blocks.blocks_of(pixel_table(spark, {9: m}), h, w, 20), h, w, s, tile, overlap))
    assert np.allclose(image(p.collect(), "scene_id", h, w, "p")[9], total / n, atol=1e-12)
    told = {r.scene_id: (r.confidence, r.uncertainty) for r in blocks.confidence(p).collect()}
    set_ = (total / n)[total / n > 0.5]
    assert told == {9: (pytest.approx(set_.mean() if len(set_) else 0.0), "medium" if 0.3 < set_.mean() < 0.8 else "high")}
    with pytest.raises(ValueError):
        blocks.scored(p, h, w, s, 32, 8, 4)


def flood(m):
    """Least pixel number of each component of a boolean matrix, by flood fill."""
    h, w = m.shape
    out = np.full((h, w), -1)
    for y in range(h):
        for x in range(w):
            if m[y, x] and out[y, x] < 0:
                out[y, x], todo = y * w + x, [(y, x)]
                while todo:
                    a, b = todo.pop()
                    for p, q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= p < h and 0 <= q < w and m[p, q] and out[p, q] < 0:
                            out[p, q] = y * w + x
                            todo.append((p, q))
    return out


def shapes():
    rng = np.random.default_rng(7)
    spiral = np.zeros((40, 40), bool)
    for k in range(0, 18, 4):
        spiral[k, k : 40 - k] = spiral[k : 40 - k, 39 - k] = spiral[39 - k, k : 40 - k] = spiral[k + 4 : 40 - k, k] = True
        spiral[k + 4, k : k + 5] = True
    ring = np.zeros((40, 40), bool)
    ring[5:35, 5:35], ring[10:30, 10:30], ring[15:20, 15:20] = True, False, True
    return {1: rng.random((40, 40)) < 0.55, 2: spiral, 3: ring, 4: np.ones((40, 40), bool), 5: rng.random((40, 40)) < 0.3, 6: np.eye(40, dtype=bool)}


@pytest.mark.parametrize("side", [7, 40, 512])
def test_labels_and_outlines_of_blocks_of_any_size(spark, side):
    scenes = shapes()
    mask = pixel_table(spark, {k: m.astype(float) for k, m in scenes.items()}, set_only=True)
    lab = blocks.labelled(mask.unionByName(mask.limit(9)), 40, side).collect()
    assert len(lab) == sum(int(m.sum()) for m in scenes.values())
    got = image([r.asDict() for r in lab], "scene_id", 40, 40, "component")
    for k, m in scenes.items():
        assert np.array_equal(np.where(m, got[k] - (k << 40), -1), flood(m))
    rings = {(r.scene_id, r.component): [[(p.lon, p.lat) for p in ring] for ring in r.rings] for r in raster.outlines(mask, 40, (2.0, 0.0, 10.0, 0.0, -1.0, 50.0), side).collect()}
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
    for k, m in scenes.items():
        labels = flood(m)
        for c in np.unique(labels[labels >= 0]):
            mine = rings.pop((k, (k << 40) + int(c)))
            assert all(r[0] == r[-1] and len(r) >= 5 for r in mine) and all((a[0] == b[0]) != (a[1] == b[1]) for r in mine for a, b in zip(r, r[1:]))
            assert all((a[0] == b[0]) != (b[0] == d[0]) for r in mine for a, b, d in zip(r, r[1:], r[2:]))  # turns only
            assert abs(sum(map(area, mine))) == 2 * (labels == c).sum()
            assert abs(area(mine[0])) == max(abs(area(r)) for r in mine)
            y, x = divmod(int(c), 40)
            sides = sum(abs(a[0] - b[0]) / 2 + abs(a[1] - b[1]) for r in mine for a, b in zip(r, r[1:]))
            own = np.pad(labels == c, 1)
            assert sides == np.abs(np.diff(own.astype(int), axis=0)).sum() + np.abs(np.diff(own.astype(int), axis=1)).sum()
    assert not rings
    assert blocks.labelled(mask.limit(0), 40, side).count() == 0 and raster.outlines(mask.limit(0), 40, (1, 0, 0, 0, 1, 0), side).count() == 0


def test_segmentation_by_a_scorer_of_tiles(spark):
    rng = np.random.default_rng(8)
    v = rng.random((64, 80)) * 1e-3
    v[20:45, 10:70] = 10.0
    v[25:28, 30:33] = 1e-3  # a hole that is closed
    frame = pixel_table(spark, {5: v})
    by_tile = raster.segmented_tiles(frame, 64, 80, (100.0, 0, 0, 0, -100.0, 0), smoothing(), 32, 0, 32)
    whole = raster.segmented_tiles(frame, 64, 80, (100.0, 0, 0, 0, -100.0, 0), smoothing())
    a, b = ([tuple(r) for r in f.collect()] for f in (by_tile, whole))
    assert len(a) == 1 and a == [pytest.approx(b[0])] and abs(a[0][2] - 25 * 60) < 40


def test_confidence_does_not_hang_on_the_order_of_a_sum(spark):
    rows = [(1, 0, 0, 0.5000000000000004), (1, 0, 1, 0.75), (1, 0, 2, 0.4), (2, 0, 0, 0.5000000000000003), (3, 0, 0, 0.500001)]
    got = {r.scene_id: (r.confidence, r.uncertainty) for r in blocks.confidence(spark.createDataFrame(rows, "scene_id long, y int, x int, p double")).collect()}
    assert got == {1: (0.75, "medium"), 2: (0.0, "low"), 3: (0.500001, "medium")}


def test_confidence_of_scenes_with_pixels_at_the_threshold_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = {r[0]: (pytest.approx(r[1], abs=1e-6), r[2]) for r in con.execute(catalog.SQL["segment_confidence"]).fetchall()}
    assert {r.scene_id: (r.confidence, r.uncertainty) for r in catalog.QUERIES["segment_confidence"](spark, sf).collect()} == want
