import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import anomalies, tracks
from tidewake.streaming import stateful

BASE = datetime.datetime(2026, 1, 1)
SCHEMA = "mmsi string, ts timestamp, sog double"


def reports(rng):
    """Reports of some days in order of arrival: out of order by under ten minutes."""
    rows = []
    for m in ("1", "2", None):
        at, slow = 0.0, False
        for _ in range(120):
            at += rng.choice([1, 2, 5, 9, 500]) + rng.random()
            slow = not slow if rng.random() < 0.2 else slow
            rows.append((m, BASE + datetime.timedelta(minutes=at), rng.choice([0.1, None]) if slow else 8.0 + rng.random()))
    return sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.random() * 9))


@pytest.mark.parametrize("name", ["stops", "gaps"])
def test_a_stream_that_stops_and_starts_again_equals_the_batch(spark, tmp_path, name):
    rows = reports(random.Random(4))
    end = max(r[1] for r in rows) + datetime.timedelta(hours=2)
    rows += [(m, end, 99.0) for m in ("1", "2", None)]
    flush = [("9", end + datetime.timedelta(days=k + 1), 99.0) for k in range(2)]  # moves the watermark past all others
    parts = [rows[:150], rows[150:260], rows[260:], flush[:1], flush[1:]]
    stream = {"stops": lambda s: stateful.stops(s, 0.5, 3), "gaps": lambda s: stateful.gaps(s, 1.0)}[name]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (0, 2, 3, 4):  # the query ends and starts again from its checkpoint
            source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            q = stream(source).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    got = sorted(str(tuple(r)) for r in spark.read.parquet(str(tmp_path / "out")).where("mmsi is null or mmsi <> '9'").select("mmsi", "us0", "us1").collect())
    batch = spark.createDataFrame([(*r, k, 1.0, 2.0) for k, r in enumerate(rows)], SCHEMA + ", ord long, lat double, lon double").withColumn("us", F.unix_micros("ts"))
    if name == "stops":
        want = anomalies.stops(batch, 0.5, 3).select("mmsi", "us0", "us1")
    else:
        want = tracks.with_neighbours(batch, "us").where((F.col("us") - F.col("prev_us")) / tracks.HOUR > 1.0).select("mmsi", F.col("prev_us").alias("us0"), F.col("us").alias("us1"))
    want = sorted(str(tuple(r)) for r in want.collect())
    assert got == want and len(want) > 5
