import random

import pytest
from pyspark.sql import functions as F

from tidewake.functions import geo, sql
from tidewake.operators import drift


def brute(axes, values, point):
    weights, at = [], []
    for a, p in zip(axes, point):
        if p is None or not a[0] <= p <= a[-1]:
            return 0.0
        i = max(k for k, v in enumerate(a) if v <= p)
        j = min(i + 1, len(a) - 1)
        f = (p - a[i]) / (a[j] - a[i]) if j > i else 0.0
        weights.append((1 - f, f))
        at.append((i, j))
    total = 0.0
    for c in range(8):
        bits = [c >> k & 1 for k in range(3)]
        w = 1.0
        for k in range(3):
            w *= weights[k][bits[k]]
        if w > 0:
            v = values.get(tuple(at[k][bits[k]] for k in range(3)))
            if v is None:
                return 0.0
            total += w * v
    return total


@pytest.mark.parametrize("seed,sizes", [(1, (4, 7, 5)), (2, (1, 3, 9)), (3, (6, 2, 2))])
def test_uneven_axes_equal_brute_force(spark, seed, sizes):
    rng = random.Random(seed)
    axes = [sorted({round(10 * rng.random() ** 3, 3) for _ in range(n)}) for n in sizes]
    values = {(i, j, k): rng.uniform(-5, 5) for i in range(len(axes[0])) for j in range(len(axes[1])) for k in range(len(axes[2])) if rng.random() < 0.97}
    field = spark.createDataFrame([(axes[0][i], axes[1][j], axes[2][k], v, -v) for (i, j, k), v in values.items()], "t double, y double, x double, u double, v double")
    pick = lambda a: rng.choice([rng.choice(a), rng.uniform(a[0], a[-1]), rng.uniform(-1, 11)])
    points = [(n, *(pick(a) for a in axes)) for n in range(300)] + [(900, axes[0][0], None, 1.0)]
    got = {r.n: (r.u, r.v) for r in drift.gridded_uneven(spark.createDataFrame(points, "n int, t double, lat double, lon double"), field).collect()}
    want = {n: brute(axes, values, p) for n, *p in points}
    assert len(got) == 301 and all(got[n][0] == pytest.approx(w, abs=1e-9) and got[n][1] == pytest.approx(-w, abs=1e-9) for n, w in want.items()) and sum(map(bool, want.values())) > 20
    empty = drift.gridded_uneven(spark.createDataFrame(points[:3], "n int, t double, lat double, lon double"), field.limit(0)).collect()
    assert [(r.u, r.v) for r in empty] == [(0, 0)] * 3


def test_functions_in_sql_are_put_into_the_plan(spark):
    names = sql.register(spark)
    rows = spark.createDataFrame([(15.0, 73.0, 15.2, 73.3), (-80.0, 179.0, 10.0, -179.0), (None, 1.0, 2.0, 3.0)], "lat1 double, lon1 double, lat2 double, lon2 double")
    rows.createOrReplaceTempView("legs_for_sql")
    here = rows.select(geo.haversine_km(*map(F.col, rows.columns)).alias("km"))
    there = spark.sql("SELECT tw_haversine_km(lat1, lon1, lat2, lon2) AS km FROM legs_for_sql")
    assert [r.km for r in there.collect()] == [r.km for r in here.collect()]
    plan = there._jdf.queryExecution().optimizedPlan().toString()
    assert "tw_haversine" not in plan and "ATAN2" in plan.upper() and not {"PythonUDF", "BatchEvalPython"} & set(plan.split())
    for name in names:
        arguments = sql.FUNCTIONS[name][0]
        assert spark.sql(f"SELECT {name}({', '.join('0.5D' for _ in arguments)}) AS r").first().r is not None
