import math
import random

import pytest

from tidewake.operators import anomalies, nearest

R = 6371.0


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return R * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_and_near_equal_brute_force_over_poles_and_date_line(spark):
    rng = random.Random(3)
    places = [(rng.uniform(60, 62), rng.uniform(-1, 1)) for _ in range(300)] + [(89.9, 10.0), (89.9, 10.0), (-89.9, 0.0), (0.0, 179.99), (0.0, -179.9), (None, 1.0)]
    points = [(k, *p) for k, p in enumerate([*((rng.uniform(59, 63), rng.uniform(-2, 2)) for _ in range(150)), *((math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(60)), (0.0, 180.0), (90.0, 0.0), (-90.0, 99.0), (61.0, None), places[0]])]
    p, v = spark.createDataFrame(points, "k int, lat double, lon double"), spark.createDataFrame(places, "lat double, lon double")
    fine = [q for q in places if q[0] is not None]
    got = {r.k: r.near_km for r in nearest.nearest(p, v).collect()}
    want = {k: None if b is None else min(hav(a, b, *q) for q in fine) for k, a, b in points}
    assert set(got) == set(want) and all(got[k] == (None if w is None else pytest.approx(w, abs=1e-6)) for k, w in want.items())
    for km in (0.5, 30.0, 5000.0, 30000.0):
        assert {r.k for r in nearest.near_any(p.where("lon is not null"), v, km).collect()} == {k for k, w in want.items() if w is not None and w <= km}
    assert all(r.near_km is None for r in nearest.nearest(p, v.limit(0)).collect())


def test_deviation_from_a_table_equals_that_from_a_list(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), k, rng.randint(0, 300) * 1_000_000 + k, None if rng.random() < 0.05 else 10 + rng.random(), 20 + rng.random()) for k in range(500)]
    points = spark.createDataFrame(rows, "mmsi string, ord long, us long, lat double, lon double")
    route = [(10 + rng.random(), 20 + rng.random()) for _ in range(12)]
    table = spark.createDataFrame(route, "lat double, lon double")
    as_set = lambda f: sorted(map(str, (tuple(r) for r in f.collect())))
    want = as_set(anomalies.route_deviation(points, route, 15))
    assert want and as_set(nearest.route_deviation(points, table, 15)) == want
    assert as_set(nearest.route_deviation(points, table.limit(1), 15)) == []
