import dataclasses
import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import anomalies, drift, drift_steps, raster, scoring, tracks
from tidewake.plans import catalog
from tidewake.streaming import tracks as streams

US = 1_000_000
T0 = int(datetime.datetime(2026, 8, 20, 10, tzinfo=datetime.timezone.utc).timestamp()) * US


def test_demo_fixture_ranks_as_published(spark):
    legs = {"419001247": [(80, 14.84, 72.90, 12), (210, 14.91, 73.06, 3), (360, 15.01, 73.25, 13)], "419004118": [(75, 14.77, 73.12, 11), (230, 14.88, 73.16, 10), (365, 15.11, 73.19, 11)], "419007640": [(65, 15.18, 72.98, 14), (260, 15.07, 73.01, 15), (355, 14.96, 73.04, 15)]}
    points = spark.createDataFrame([(m, k, T0 + a * 60 * US, b, c, float(s)) for m, ps in legs.items() for k, (a, b, c, s) in enumerate(ps)], "mmsi string, ord long, us long, lat double, lon double, sog double")
    case = spark.createDataFrame([("OT-2026-0001", 14.92, 73.08, 15.04, 73.33, T0 + 220 * 60 * US)], scoring.SCENARIO)
    got = scoring.ranked(scoring.features(points, case)).orderBy("rank").collect()
    assert [(r.mmsi, round(r.total, 2)) for r in got] == [("419001247", 91.29), ("419004118", 65.22), ("419007640", 61.60)]
    assert scoring.report(scoring.claims(scoring.ranked(scoring.features(points, case)), case)).count() == 1


def test_small_components_go_small_holes_fill_and_closing_clears_the_edge(spark):
    def block(y0, x0, h, w, skip=()):
        return {(y, x) for y in range(y0, y0 + h) for x in range(x0, x0 + w)} - set(skip)

    on = block(2, 2, 7, 7) | block(2, 20, 5, 10) | block(15, 2, 14, 14, block(18, 5, 9, 11 - 0) & block(18, 5, 9, 9))
    cells = [(0, y, x, (y, x) in on) for y in range(32) for x in range(40)]
    got = {(r.y, r.x) for r in raster.postprocessed(spark.createDataFrame(cells, "scene_id long, y long, x long, on boolean"), 32, 40).collect()}
    assert not got & block(2, 2, 7, 7)  # 49 pixels
    assert block(2, 20, 5, 10) <= got  # 50 pixels
    assert block(15, 2, 14, 14) <= got  # its hole of 81 is filled


def test_tile_then_stitch_is_identity(spark):
    rng = random.Random(1)
    cells = [(0, y, x, rng.random()) for y in range(40) for x in range(50)]
    px = spark.createDataFrame(cells, "scene_id long, y long, x long, v double")
    back = {(r.y, r.x): r.v for r in raster.stitched(raster.tiles(px, 40, 50, 16, 4)).collect()}
    assert all(back[y, x] == pytest.approx(v) for _, y, x, v in cells)


def test_drift_members_are_reproducible_and_still_water_keeps_particles(spark):
    ring = ((73.0, 15.0), (73.2, 15.0), (73.2, 15.2), (73.0, 15.2), (73.0, 15.0))
    still = drift.Request((ring,), 6, 30, 50, stochastic=False)
    moved = drift.Request((ring,), 6, 30, 50, current=drift_steps.uniform(0.5, 0.0), stochastic=False, backward=False)
    places = lambda r: sorted((x.member, x.particle_id, x.lat, x.lon, x.us) for x in drift.simulate(spark, r, 3, False).collect())
    a, b, c = map(places, (still, still, moved))
    assert a == b and len(a) == 150
    assert all(73.0 <= lon <= 73.2 and 15.0 <= lat <= 15.2 for _, _, lat, lon, _ in a)
    assert all(y[3] > x[3] and y[2] == x[2] for x, y in zip(a, c))
    back = drift.Request((ring,), 6, 30, 50, current=drift_steps.uniform(0.5, 0.0), stochastic=False, backward_mode="physical")
    assert all(y[3] < x[3] for x, y in zip(a, places(back)))


def _eddy(lat, lon):
    dx, dy = (lon - 73.2) * 111_000 * math.cos(math.radians(lat)), (lat - 15.2) * 111_000
    return (-0.5 * dy / 50_000, 0.5 * dx / 50_000) if math.hypot(dx, dy) < 50_000 else (0.0, 0.0)


def test_runge_kutta_in_an_eddy_equals_plain_python(spark):
    lat, lon, h = 15.35, 73.05, 1800.0
    start = spark.createDataFrame([(lat, lon, T0)], "lat double, lon double, us long")
    got = drift_steps.advected(start, drift_steps.eddy(15.2, 73.2), h, 4, path=True).first()
    for _ in range(4):
        scale = 111_000 * math.cos(math.radians(lat))
        at = lambda k, dt: _eddy(lat + k[1] * dt / 111_000, lon + k[0] * dt / scale)  # noqa: E731, B023
        a = _eddy(lat, lon)
        b = at(a, h / 2)
        c = at(b, h / 2)
        d = at(c, h)
        u, v = ((p + 2 * q + 2 * r + s) / 6 for p, q, r, s in zip(a, b, c, d))
        lat, lon = lat + v * h / 111_000, lon + u * h / scale
    assert (got.lat, got.lon) == (pytest.approx(lat, abs=1e-10), pytest.approx(lon, abs=1e-10))
    assert len(got.path) == 5 and got.us == T0 + 4 * 1800 * US


def test_grid_field_is_trilinear_and_zero_outside(spark):
    f = [[[2.0 * t + y + 3 * x for x in range(4)] for y in range(3)] for t in range(2)]
    field = drift_steps.grid((T0, 15.0, 73.0), (3600 * US, 0.1, 0.1), f, f)
    rows = [(15.05, 73.21, T0 + 900 * US), (15.2, 73.3, T0 + 3600 * US), (14.9, 73.1, T0), (15.1, 73.1, T0 - US)]
    p = spark.createDataFrame(rows, "lat double, lon double, us long")
    got = [r.u for r in p.select(field(*map(F.col, ("lat", "lon", "us")))[0].alias("u")).collect()]
    assert got == [pytest.approx(x) for x in (2 * 0.25 + 0.5 + 3 * 2.1, 2 + 2 + 9, 0, 0)]


def test_particles_fill_polygons_by_area_and_diffusion_has_its_variance(spark):
    small, large = (((x, 15.0), (x + w, 15.0), (x + w, 15.0 + w), (x, 15.0 + w), (x, 15.0)) for x, w in ((73.0, 0.1), (74.0, 0.3)))
    r = drift.Request((small, large), 2, 20, 1000, backward=False, seed=5)
    placed = drift.simulate(spark, dataclasses.replace(r, hours=0), 1).collect()
    assert [sum(x.part == k for x in placed) for k in (0, 1)] == [100, 900]
    assert all(73.0 <= x.lon <= 73.1 if x.part == 0 else 74.0 <= x.lon <= 74.3 for x in placed)
    ends = drift.simulate(spark, r, 1, False).collect()
    begin = {(x.part, x.particle_id): x for x in placed}
    north = [(x.lat - begin[x.part, x.particle_id].lat) * 111_000 for x in ends]
    assert sum(north) / 1000 == pytest.approx(0, abs=60) and sum(x * x for x in north) / 1000 == pytest.approx(2 * 10 * 7200, rel=0.15)


def test_hull_holds_all_points(spark):
    rng = random.Random(2)
    pts = [("a", rng.gauss(15, 0.1), rng.gauss(73, 0.1)) for _ in range(500)] + [("b", 1.0, 2.0)]
    got = drift.hulls(spark.createDataFrame(pts, "g string, lat double, lon double"), "g").orderBy("g", "seq").collect()
    ring = [(r.lon, r.lat) for r in got if r.g == "a"]
    assert ring[0] == ring[-1]
    for _, lat, lon in pts[:-1]:
        assert all((x1 - x0) * (lat - y0) - (y1 - y0) * (lon - x0) >= -1e-12 for (x0, y0), (x1, y1) in zip(ring, ring[1:]))
    assert sum(r.g == "b" for r in got) == 5


def test_dedupe_is_idempotent_and_first_wins(spark):
    rows = [("1", 2, 5, 1.0, 2.0), ("1", 1, 5, 1.0000001, 2.0), ("1", 3, 6, 1.0, 2.0)]
    once = tracks.deduplicate(spark.createDataFrame(rows, "mmsi string, ord long, us long, lat double, lon double"))
    assert sorted(r.ord for r in once.collect()) == [1, 3] and tracks.deduplicate(once).count() == 2


def test_streams(spark, tmp_path):
    base = datetime.datetime(2026, 1, 1)
    rows = [("1", base + datetime.timedelta(minutes=m), 1.0, 2.0, float(m % 7)) for m in (0, 10, 20, 500, 510, 2000)]
    spark.createDataFrame(rows, "mmsi string, ts timestamp, lat double, lon double, sog double").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for k, f in enumerate((streams.speed_windows, streams.voyages)):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = f(source).writeStream.outputMode("append").format("memory").queryName(f"out{k}").option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select n, max_sog from out0 order by start").collect()] == [(3, 6.0), (2, 6.0)]
    assert [r.n for r in spark.sql("select n from out1 order by first").collect()] == [3, 2]


def test_loitering_gathers_no_track_and_carries_its_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        # 100 positions at one place, one far off, 30 at that one, and a vessel that only passes
        rows = [("a", k, k * 60 * US, 15.0 if k < 100 else 16.0, 73.0) for k in range(131)] + [("b", k, k * 60 * US, 15.0 + k, 73.0) for k in range(90)]
        rows += [("c", 0, 0, None, 73.0), ("c", 1, 60 * US, 15.0, 73.0), *(("c", k, k * 60 * US, 15.0, 73.0) for k in range(2, 70))]
        points = spark.createDataFrame(rows, "mmsi string, ord long, us long, lat double, lon double")
        got = anomalies.loitering(points)
        assert "collect_list" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect())) == [("a", 1, 99), ("c", 2, 69)]
        assert anomalies.loitering(points.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_registered_ensembles_and_regions_have_the_surveyed_size(spark, monkeypatch):
    assert {r.n for r in catalog.QUERIES["drift_ensemble"](spark, "/root/testdata/sf0.001").select("n").distinct().collect()} == {250 * 10}
    cells, grid = [], drift.kde_grid
    monkeypatch.setattr(drift, "kde_grid", lambda p, by, n, *a: cells.append(n) or grid(p, by, n, *a))
    catalog.QUERIES["drift_region"](spark, "/root/testdata/sf0.001")
    assert cells == [50]


def test_many_cases_meet_points_in_blocks(spark, monkeypatch):
    from tidewake.operators import scoring

    points = spark.createDataFrame([(str(i % 5), i * 1000, i, 10 + i / 100, 20 - i / 90, float(i % 7)) for i in range(60)], "mmsi string, us long, ord long, lat double, lon double, sog double")
    cases = spark.createDataFrame([(f"OT-2026-{i:04d}", 10 + i / 50, 20.0, 10.0, 20.1, i * 500) for i in range(25)], scoring.SCENARIO)
    whole = sorted(map(tuple, scoring.features(points, cases).collect()))
    monkeypatch.setattr(scoring, "CASES", 8)
    assert sorted(map(tuple, scoring.features(points, cases).collect())) == whole and len(whole) == 125


def test_nearest_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from tidewake.operators import retrieval

    rng = np.random.default_rng(1)
    v = rng.normal(size=(80, 6)).round(1)
    v[10:20] = v[30:40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 6), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [1.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {q: sorted(range(80), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:4] for q in range(0, 80, 20)}
    for size in (64_000_000, 100):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        got = retrieval.nearest(frame, frame.where("id % 20 = 0 and id < 100"), 4).collect()
        for q, ids in want.items():
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: -r.score)
            assert len(mine) == 4 and [round(r.score, 9) for r in mine] == [round(float(u[q] @ u[i]), 9) for i in ids]
    assert retrieval.nearest(frame, frame.limit(0), 4).count() == 0


def test_fusion_counts_ranks_beyond_what_is_looked_at(spark):
    from tidewake.operators import retrieval

    a = [(i, float(500 - i)) for i in range(500)]
    b = [(i, float((i * 37) % 500)) for i in range(0, 500, 2)]
    rank = lambda rows: {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    ra, rb = rank(a), rank(b)
    want = sorted(((i, 1 / (60 + ra[i]) + (1 / (60 + rb[i]) if i in rb else 0)) for i in ra), key=lambda r: (-r[1], r[0]))[:7]
    got = retrieval.fused(*(spark.createDataFrame(x, "id long, score double") for x in (a, b)), k=7).collect()
    assert [r.id for r in got] == [i for i, _ in want] and all(abs(r.score - s) < 1e-12 for r, (_, s) in zip(got, want))


def test_newest_first_places(spark):
    import datetime

    from tidewake.plans import investigation

    at = [datetime.datetime(2026, 1, 1 + k % 3, k % 5) for k in range(20)] + [None]
    rows = list(enumerate(at))
    got = {r.id: r.place for r in investigation.newest_first(spark.createDataFrame(rows, "id long, at timestamp"), "at", "id").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1].timestamp() if r[1] else 0), r[0]))
    assert got == {i: k for k, (i, _) in enumerate(order, 1)}


def test_scratch_tables_can_be_cleared(spark):
    import os

    from tidewake import scratch

    rows = scratch.saved(spark.range(3), "x")
    folder = f"{scratch.shared_dir(spark)}/tidewake/{spark.sparkContext.applicationId}"
    assert rows.count() == 3 and os.path.isdir(folder)
    scratch.clear(spark)
    assert not os.path.exists(folder) and scratch.saved(spark.range(2), "x").count() == 2


def test_outlines_have_holes_and_keep_corners_apart(spark):
    from tidewake.operators import raster

    rows = [(0, y, x) for y in range(1, 6) for x in range(1, 6) if not (2 <= y <= 3 and x == 3) and (y, x) != (4, 4)] + [(0, 6, 6), (1, 0, 0)]
    got = {(r.scene_id, r.component): [[(p.lon, p.lat) for p in ring] for ring in r.rings] for r in raster.outlines(spark.createDataFrame(rows, "scene_id long, y long, x long"), 10, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)).collect()}
    assert got[(1, 1 << 40)] == [[(1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (1.0, 0.0)]]
    assert got[(0, 66)] == [[(7.0, 6.0), (7.0, 7.0), (6.0, 7.0), (6.0, 6.0), (7.0, 6.0)]]
    outer, *holes = got[(0, 11)]

    def area(ring):  # positive if the region is on the right hand, rows downwards
        return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:])) / 2

    assert area(outer) == 25.0 and sorted(map(area, holes)) == [-3.0]  # two holes that meet in a corner have one ring
    assert all(r[0] == r[-1] and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(r, r[1:])) for r in [outer, *holes])


def test_region_polygons_fall_back_to_hulls(spark):
    from tidewake.operators import drift

    rows = [(1, 10.0 + i % 7 / 10, 20.0 + i % 5 / 10) for i in range(40)] + [(2, 5.0, 6.0), (3, 1.0, 1.0), (3, 2.0, 2.0), (3, 3.0, 3.0)]
    got = {(r.g, r.part): [[(p.lon, p.lat) for p in ring] for ring in r.rings] for r in drift.region_polygons(spark.createDataFrame(rows, "g long, lat double, lon double"), "g", 20).collect()}
    assert {g for g, _ in got} == {1, 2, 3} and all(ring[0] == ring[-1] for rings in got.values() for ring in rings)
    assert any(min(x for x, _ in rings[0]) < 20.2 < max(x for x, _ in rings[0]) for (g, _), rings in got.items() if g == 1)
    assert len(got[(2, 0)][0]) == 5


def test_random_steps_one_by_one_equal_the_fold_and_all_tasks_drift(spark, monkeypatch):
    """The fold was one interpreted expression, and adaptive execution gave all vessels of a small table to one task."""
    request = drift.Request((), 2, 30, 20, drift_steps.eddy(15.2, 73.2), drift_steps.diurnal(5.0, 2.0), seed=7)
    ring = [(73.0, 15.0), (73.1, 15.0), (73.1, 15.1), (73.0, 15.0)]
    rows = spark.createDataFrame([(str(i % 40), ring, i) for i in range(400)], "mmsi string, ring array<struct<lon:double,lat:double>>, us long")
    regions = rows.groupBy("mmsi").agg(F.array(F.first("ring")).alias("rings"), F.max("us").alias("us"))
    def run():
        out = drift.drifted(regions, "mmsi", request, 3)
        return sorted(map(tuple, out.collect())), out.select(F.spark_partition_id()).distinct().count()

    stepped, tasks = run()
    monkeypatch.setattr(drift_steps, "UNROLLED", 0)
    assert stepped == run()[0] and len(stepped) == 40 * 20 * 3
    assert tasks == 4
