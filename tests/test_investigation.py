import datetime

import pytest
from pyspark.sql import functions as F

from tidewake.operators import raster, scoring
from tidewake.plans import case_store, investigation

T0 = int(datetime.datetime(2026, 8, 20, tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000
CASE = [("OT-2026-0001", 14.92, 73.08, 15.04, 73.33, T0)]


def _fixed(spark):
    return spark.createDataFrame([(i, "fixed", i) for i in ("detection-001", "drift-ensemble-001", "guidance-001")], "id string, source string, title string")


def test_case_without_vessels_gets_a_report_and_six_steps(spark):
    points = spark.createDataFrame([], "mmsi string, ord long, us long, lat double, lon double, sog double")
    got = investigation.investigate(points, spark.createDataFrame(CASE, scoring.SCENARIO), _fixed(spark))
    report = got.report.first()
    assert [c.confidence for c in report.claims] == [0.91, 0.73, 0.0] and "No candidate" in report.claims[2].claim
    assert [(r.step, r.n) for r in got.steps.orderBy("step").collect()] == [(1, None), (2, None), (3, None), (4, 0), (5, 0), (6, None)]


def test_cases_are_stored_and_found(spark, tmp_path):
    points = spark.createDataFrame([("1", 1, T0, 14.9, 73.0, 5.0), ("1", 2, T0 + 60, 15.0, 73.1, None)], "mmsi string, ord long, us long, lat double, lon double, sog double")
    other = [("OT-2026-0002", *CASE[0][1:])]
    store = str(tmp_path / "store")
    assert case_store.cases(spark, store).count() == 0
    report = lambda cases: investigation.investigate(points, spark.createDataFrame(cases, scoring.SCENARIO), _fixed(spark)).report
    for cases in (CASE, other, CASE):
        case_store.save(report(cases), store)
    assert case_store.cases(spark, store).count() == 2
    assert case_store.cases(spark, store, "OT-2026-0002").first().evidence_ids == ["ais-1", "detection-001", "drift-ensemble-001"]
    assert case_store.cases(spark, store, "OT-2026-0003").isEmpty()


def test_saving_again_replaces_and_readers_see_whole_saves(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    rows = lambda n, ids: spark.createDataFrame([(f"c{i}", n, i) for i in ids], "case_id string, version int, v int")
    seen = lambda: {r.case_id: r.version for r in case_store.cases(spark, store).collect()}
    case_store.save(rows(1, range(10)), store)
    case_store.save(rows(2, range(5, 12)), store)
    want = {f"c{i}": 1 if i < 5 else 2 for i in range(12)}
    assert seen() == want
    commit = case_store._commit
    with pytest.raises(RuntimeError):
        monkeypatch.setattr(case_store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        case_store.save(rows(3, range(12)), store)  # its rows are written, but the save isn't
    monkeypatch.setattr(case_store, "_commit", commit)
    assert seen() == want
    before = case_store.cases(spark, store)
    case_store.compact(spark, store)
    assert seen() == want and len(case_store._entries(spark, store)) == 1 and before.count() == 12
    case_store.save(rows(4, [0]).withColumn("more", F.lit("x")), store)
    assert seen() == want | {"c0": 4} and {r.more for r in case_store.cases(spark, store).collect()} == {"x", None}
    twice = spark.createDataFrame([("c1", 5, 1), ("c1", 6, 1)], "case_id string, version int, v int")
    case_store.save(twice, store, F.col("version"))
    assert seen()["c1"] == 6
    names = case_store._entries(spark, store)
    number = int(names[-1].split("-")[0])
    with pytest.raises(RuntimeError):
        case_store._commit(spark, store, "base", "x", number - 1)
    (tmp_path / "store" / "held" / f"{number + 1:08}").touch()  # another writer that has its number, but not its entry yet
    case_store.save(rows(7, [2]), store)
    assert seen() == want | {"c0": 4, "c1": 6, "c2": 7}
    plan = case_store.cases(spark, store, "c2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(__tw_part" in plan and case_store.cases(spark, store, "c2").first().version == 7


def test_request_patterns(spark):
    rows = spark.createDataFrame([("OT-2026-0001", "why"), ("OT-2026-001", "no"), ("xOT-2026-0001", "x" * 501), (None, None)], "a string, b string")
    got = rows.select(investigation.valid_case_number(F.col("a")).alias("a"), investigation.valid_question(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (False, False)]


def test_scenes_need_their_reference_system_and_a_transform(spark):
    t = lambda *v: dict(zip("abcdef", map(float, v)))
    rows = [(("EPSG:4326", t(0.1, 0, 73, 0, -0.1, 15)),), (("EPSG:4326", t(1, 0, 0, 0, 1, 0)),), (("EPSG:3857", t(0.1, 0, 73, 0, -0.1, 15)),), (("EPSG:4326", t(0, 0, 73, 0, -0.1, 15)),), (None,)]
    df = spark.createDataFrame(rows, "s struct<crs:string,affine:struct<a:double,b:double,c:double,d:double,e:double,f:double>>")
    assert [r.ok for r in df.select(raster.valid_scene(F.col("s")).alias("ok")).collect()] == [True, False, False, False, False]


def test_segmentation_finds_the_bright_slick(spark):
    cells = [(0, y, x, 1.0 if 4 <= y < 12 and 5 <= x < 15 else 1e-3) for y in range(20) for x in range(24)]
    px = spark.createDataFrame(cells, "scene_id long, y long, x long, v double")
    slicks = raster.segmented(px, 20, 24, (100.0, 0.0, 0.0, 0.0, -100.0, 0.0), lambda level: F.when(level > 0.5, 0.9).otherwise(0.1), 16, 4, max_hole=5)
    (got,) = slicks.collect()
    assert (got.pixels, round(got.area_km2, 6), round(got.perimeter_km, 6), round(got.confidence, 6)) == (80, 0.8, 3.6, 0.9)
    assert raster.segmentation_summary(slicks).first().level == "high"
