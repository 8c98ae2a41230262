"""Every registered query of the engine against its DuckDB twin on the driver's tables."""

import datetime
import math
import pathlib

import duckdb
import pytest

from tidewake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_equals_sql(spark, db, name):
    frame = catalog.QUERIES[name](spark, SF)
    got = [tuple(map(plain, (r[c] for c in sorted(frame.columns)))) for r in frame.collect()]
    if name not in catalog.SQL:
        assert got
        return
    rel = db.execute(catalog.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4) for x, y in zip(a, b)), (a, b)
    assert want or name in ("stops", "speed_anomaly")
