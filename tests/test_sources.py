import datetime
import json

import pytest

from tidewake.sources import ais


def write(tmp_path, text):
    path = tmp_path / "a.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_and_lenient_csv(spark, tmp_path):
    rows = "﻿ MMSI , Timestamp,LATITUDE,longitude,sog,cog\n 123456789 ,2026-01-02T03:04:05Z,10,20,1,2\n1,2026-01-02 03:04:05,99,20,1,2\n2,2026-01-02 03:04:05,10,20,fast,2\n3,2026-01-02 03:04:05,10,20,-1,2\n4,2026-01-02 03:04:05,10,20,1,361\n,2026-01-02,10,20,,\n5,2026-01-02T05:04:05+02:00,10,20,,\n"
    got = ais.read_csv(spark, write(tmp_path, rows), "strict").collect()
    assert [r.error and r.error.split()[0] for r in got] == [None, "latitude", "sog", "sog", "cog", "mmsi", None]
    assert got[0].mmsi == "123456789" and got[6].ts == got[0].ts == datetime.datetime(2026, 1, 2, 3, 4, 5)
    plain = rows.replace("﻿ MMSI , Timestamp,LATITUDE", "mmsi,timestamp,latitude")
    got = ais.read_csv(spark, write(tmp_path, plain), "lenient").collect()
    assert [r.error and r.error.split()[0] for r in got] == ["timestamp", "latitude", None, "sog", "cog", "mmsi", "timestamp"]
    assert got[2].sog is None
    with pytest.raises(ValueError, match="latitude, longitude"):
        ais.read_csv(spark, write(tmp_path, "mmsi,timestamp\n1,2\n"), "strict")


def test_times_of_any_type_and_session_zone(spark, tmp_path):
    frame = spark.sql("SELECT '1' mmsi, TIMESTAMP'2026-01-02 03:04:05.5Z' a, TIMESTAMP_NTZ'2026-01-02 03:04:05.5' b, 1767323045.5D c, 1767323045L d, DATE'2026-01-02' e, '2026-01-02T03:04:05.5' f, 10D latitude, 20D longitude")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            us = {c: ais.parsed(frame.withColumnRenamed(c, "timestamp")).selectExpr("unix_micros(ts) us").first().us for c in "abcdef"}
            assert us == {"a": 1767323045500000, "b": 1767323045500000, "c": 1767323045500000, "d": 1767323045000000, "e": 1767312000000000, "f": 1767323045500000}, z
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ingestion_keeps_first_of_equal_reports_and_tracks_of_two(spark, tmp_path):
    rows = "mmsi,timestamp,latitude,longitude,sog\n1,2026-01-02 03:04:05,10,20,5\n1,2026-01-02 03:04:05,10.0000001,20,6\n1,2026-01-02 03:05:05,10,20,7\n2,2026-01-02 03:04:05,10,20,8\n2,2026-01-02 03:04:05,10,20,9\n3,never,10,20,1\n"
    points, found, bad = ais.ingested(spark.read.option("header", True).csv(write(tmp_path, rows)))
    assert sorted((r.mmsi, r.sog) for r in points.collect()) == [("1", 5.0), ("1", 7.0), ("2", 8.0)]
    assert [(r.mmsi, r.n) for r in found.collect()] == [("1", 2)] and [r.mmsi for r in bad.collect()] == ["3"]
    nothing = ais.ingested(spark.createDataFrame([], "mmsi string, timestamp string, latitude string, longitude string"))
    assert [f.count() for f in nothing] == [0, 0, 0]


def test_observation_sidecar(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"captured_at": "2026-08-20T16:10:00Z", "sensor": "S1", "bbox": [72.8, 14.7, 73.5, 15.2], "orbit": "x"}))
    row = ais.read_observation(spark, str(tmp_path / "o.json")).first()
    assert row.sensor == "S1" and row.bbox == [72.8, 14.7, 73.5, 15.2] and row.metadata == {"orbit": "x"} and row.source_uri.endswith("o.json") and row.error is None


def test_manifest(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<a><s1:productType>GRD</s1:productType><t:startTime>T0</t:startTime><t:startTime>T1</t:startTime><t:stopTime>T2</t:stopTime><o:orbitDirection>UP</o:orbitDirection><o:orbitDirection>DOWN</o:orbitDirection></a>")
    row = ais.read_manifest(spark, str(tmp_path / "m.xml")).first()
    assert (row.product_type, row.start_time, row.stop_time, row.orbit_direction) == ("GRD", "T0", "T2", "DOWN")
