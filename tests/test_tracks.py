import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import anomalies, track_index, tracks

HOUR = tracks.HOUR


def points(spark, seed=1, n=600, jump=0.3):
    """Half of all reports are vessel 1's; NULLs in vessels, positions and channels."""
    rng, rows, at = random.Random(seed), [], {}
    for k in range(n):
        m = "1" if k % 2 else rng.choice(["2", "3", None])
        y, x = at.get(m, (10.0, 20.0))
        y, x = y + rng.uniform(-0.03, 0.03), x + rng.uniform(-0.03, 0.03)
        if rng.random() < jump:
            y, x = 10 + rng.random(), 20 + rng.random()
        at[m] = y, x
        pick = lambda v, p=0.06: None if rng.random() < p else v  # noqa: B023, E731
        rows.append((m, k, rng.randint(0, 200) * HOUR // 4 + k, pick(y), pick(x, 0.0), pick(rng.choice([0.1, 0.2, 9.0, 11.0, 60.0])), pick(rng.uniform(0, 360)), pick(1.0), 7, True))
    return spark.createDataFrame(rows, "mmsi string, ord long, us long, lat double, lon double, sog double, cog double, heading double, _n int, inside_ boolean").repartition(6)


CASES = {
    "gaps": lambda p, h: tracks.gaps(p, 1.0, h),
    "interpolate": lambda p, h: tracks.interpolate(p, 30, h),
    "fill_gaps": lambda p, h: tracks.fill_gaps(p, 60, h),
    "stops": lambda p, h: anomalies.stops(p, 10.0, 10, h),
    "route": lambda p, h: anomalies.route_deviation(p, [(10.2, 20.3), (10.8, 20.7)], 30, h),
    "speed": lambda p, h: anomalies.speed_anomaly(p, 1.5, h),
    "course": lambda p, h: anomalies.course_change(p, 45, h),
    "loitering": lambda p, h: anomalies.loitering(p, 12, 5, h),
}


@pytest.mark.parametrize("name", list(CASES))
def test_stretches_give_the_same_results(spark, name):
    p = points(spark, jump=0.1).cache()
    as_set = lambda f: sorted(map(str, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.collect())))
    want = as_set(CASES[name](p, None))
    assert want and as_set(CASES[name](p, 5.0)) == want
    if name in ("stops", "loitering", "interpolate"):
        assert as_set(CASES[name](p, 0.5)) == want and as_set(CASES[name](p, 1e6)) == want


def test_a_hot_vessel_is_worked_on_by_many_tasks(spark):
    p = points(spark, n=2000)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for h, least in ((None, 1), (2.0, 8)):
            rows = tracks.with_neighbours(p, "us", chunk_hours=h).where("mmsi = '1'")
            tasks = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.max("pos"), F.max("prev_us")).collect()
            assert len(tasks) == 1 if h is None else len(tasks) >= least
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_detectors_keep_a_callers_columns_apart(spark):
    p = points(spark, n=100)
    assert {"_n", "inside_"} <= set(tracks.deduplicate(p).columns) and tracks.at_least(p).select("_n").distinct().collect() == [(7,)]
    assert sorted(tracks.with_neighbours(p, "us", chunk_hours=1.0).columns) == sorted([*p.columns, "pos", "prev_us", "next_us"])


def test_hilbert_is_a_walk_through_all_cells(spark):
    n = 16
    frame = spark.range(n * n).selectExpr(f"cast(id div {n} as int) x", f"cast(id % {n} as int) y")
    at = sorted((r.d, r.x, r.y) for r in frame.select("x", "y", track_index.hilbert("x", "y").alias("d")).collect())
    assert [d for d, *_ in at] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(at, at[1:]))


def crosses(leg, box):
    """By looking at many points of the leg and at crossings of its line with the box's sides."""
    x0, y0, x1, y1 = box
    (ax, ay), (bx, by) = leg
    ts = {0.0, 1.0}
    for a, b, lines in ((ax, bx, (x0, x1)), (ay, by, (y0, y1))):
        ts |= {(v - a) / (b - a) for v in lines if a != b and 0 <= (v - a) / (b - a) <= 1}
    eps = 1e-12
    return any(x0 - eps <= ax + t * (bx - ax) <= x1 + eps and y0 - eps <= ay + t * (by - ay) <= y1 + eps for t in ts)


def test_paths_through_boxes_equal_brute_force_and_files_are_passed_over(spark, tmp_path):
    p = points(spark, seed=5, n=1500, jump=0.2)
    track_index.write(p, f"{tmp_path}/index", 16)
    index = track_index.read(spark, f"{tmp_path}/index")
    rows = index.collect()
    assert sorted(map(str, rows)) == sorted(map(str, track_index.legs(p, 7.0).collect())) and len(rows) > 1000
    rng = random.Random(2)
    boxes = [(k, *(v for v in (x, y, x + rng.random() * 0.1, y + rng.random() * 0.1))) for k in range(25) for x, y in [(20 + rng.random(), 10 + rng.random())]]
    want = {(k, r.mmsi, r.pos) for k, *b in boxes for r in rows if crosses(((r.lon0, r.lat0), (r.lon1, r.lat1)), b)}
    frame = spark.createDataFrame(boxes, "box_id int, min_lon double, min_lat double, max_lon double, max_lat double")
    got = [(r.box_id, r.mmsi, r.pos) for r in track_index.through_boxes(index, frame, 0.05).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    k, *box = boxes[max(range(25), key=lambda i: sum(w[0] == i for w in want))]
    one = track_index.through_box(index, *box).collect()
    assert {(k, r.mmsi, r.pos) for r in one} == {w for w in want if w[0] == k} and all(r.enters_us <= r.leaves_us for r in one)
    middle = sorted(r.enters_us for r in one)[len(one) // 2]
    assert {(r.mmsi, r.pos) for r in track_index.through_box(index, *box, 0, middle).collect()} == {(r.mmsi, r.pos) for r in one if r.enters_us <= middle}
    # a box in a corner that few legs touch: most files are passed over by their statistics
    small = track_index.through_box(index, 20.97, 10.97, 21.5, 11.5)
    small.collect()
    plan = small._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert read < len(rows) / 2


def test_legs_within_a_circle(spark):
    rows = [("a", 0, 0, 10.0, 20.0), ("a", 1, HOUR, 10.0, 20.2), ("b", 0, 0, 10.05, 20.1), ("b", 1, HOUR, 10.05, 20.1), ("c", 0, 0, 10.0, 20.3), ("c", 1, 1, 10.0, 20.4), ("d", 0, 0, 10.0, 20.1)]
    p = spark.createDataFrame(rows, "mmsi string, ord long, us long, lat double, lon double")
    got = {r.mmsi: r.km for r in track_index.within(track_index.legs(p), 10.0, 20.1, 6.0).collect()}
    assert got == {"a": pytest.approx(0, abs=1e-9), "b": pytest.approx(0.05 * 111)}
    assert track_index.legs(p.limit(0)).count() == 0
