import gzip
import hashlib
import pathlib
import random

import duckdb
import pytest

from tidewake.llm import warc

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, record_type string"


def brute(pages):
    best = {}
    for i, _, h, _ in pages:
        d = hashlib.sha1((h or "").encode()).hexdigest()
        if len((h or "").encode()) >= 1000 and i is not None:
            best[d] = max(best.get(d, i), i)
    out = []
    for i, _, h, _ in pages:
        raw = (h or "").encode()
        d = hashlib.sha1(raw).hexdigest()
        to = best.get(d) if best.get(d, i) != i else None
        out.append((i, len(raw), d, "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip_with_segments(spark, tmp_path):
    rng = random.Random(8)
    body = lambda n: "".join(rng.choice(["a", "é", "漢", "\r\n\r\n", "WARC/1.1\r\n", "😀"]) for _ in range(n))
    twice, long = body(900), body(9000)
    pages = [(i, f"http://h/{i} x\r\ny", body(rng.randint(0, 900)), "") for i in range(30)]
    pages += [(100, None, None, ""), (101, "u", "", ""), (102, "u", twice, ""), (103, "u", twice, ""), (104, "u", twice, ""), (105, "u", long, ""), (106, "u", long, ""), (107, "u", body(20000), "")]
    pages += [(108, "u", "s" * 999, ""), (109, "u", "s" * 999, ""), (110, "u", "t" * 1000, ""), (111, "u", "t" * 1000, ""), (111, "u", "t" * 1000, ""), (None, "u", "t" * 1000, ""), (None, "u", "alone" * 300, "")]
    frame = spark.createDataFrame(pages, SCHEMA).repartition(3)
    got = warc.round_trip(frame, str(tmp_path / "w"), segment=4096).collect()
    assert sorted(map(tuple, got), key=str) == brute(pages)
    files = [p.read_bytes() for p in pathlib.Path(tmp_path / "w").glob("part-*")]
    raw = b"".join(map(gzip.decompress, files))
    assert sum(f.count(b"\x1f\x8b\x08") for f in files) >= raw.count(b"WARC-Record-ID") > len(pages)
    assert b"WARC-Type: continuation" in raw and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    chunks = warc.chunk_table(spark, str(tmp_path / "w")).where("chunk is not null").selectExpr("max(length(chunk))").first()[0]
    assert 4000 < chunks <= 4096


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).count() == 0


def test_whole_table_equals_sql(spark):
    got = warc.round_trip(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(warc.ORACLE).fetchall())


def one(n, **changes):
    return warc.record(*({"page_id": 1, "url": b"u", "digest": hashlib.sha1(b"x" * n).hexdigest(), "size": n, "refers_to": None, "row": 0, "part": 0, "chunk": b"x" * n} | changes).values())


def test_damage_is_an_error(spark, tmp_path):
    record = one(10)
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(record[:-20])))
    assert list(warc.parse(gzip.compress(record) + gzip.compress(record)))[1]["payload_bytes"] == 10
    response, revisit = one(2000), one(2000, page_id=2, refers_to=1)
    for name, records, well in (("a", [response, revisit], True), ("b", [revisit], False), ("c", [one(1999, row=5), revisit], False), ("d", [response.replace(b"xxx", b"xyx", 1), revisit], False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(b"".join(map(gzip.compress, records)))
        if well:
            assert {r.page_id: r.record_type for r in warc.read(spark, str(tmp_path / name)).collect()} == {1: "response", 2: "revisit"}
        else:
            with pytest.raises(Exception):
                warc.read(spark, str(tmp_path / name)).collect()


def test_bytes_that_are_no_utf8_come_back(spark, tmp_path):
    pages = spark.sql("SELECT 1L page_id, cast(x'68ff2f' AS string) url, cast(x'ff00fec3' AS string) html UNION ALL SELECT 2L, 'v', repeat(cast(x'80c3' AS string), 700)")
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(pages, str(tmp_path / "w"), segment=256).collect()}
    assert got == {i: (len(b), hashlib.sha1(b).hexdigest()) for i, b in ((1, b"\xff\x00\xfe\xc3"), (2, b"\x80\xc3" * 700))}


def test_a_payload_of_300_mb_is_never_whole_in_a_worker(spark, tmp_path):
    import resource

    pages = spark.sql("SELECT id AS page_id, 'u' url, repeat('0123456789', 30000000) html FROM range(1)")
    got = warc.round_trip(pages, str(tmp_path / "w")).first()
    whole = hashlib.sha1()
    for _ in range(300):
        whole.update(b"0123456789" * 100_000)
    assert (got.payload_bytes, got.payload_digest, got.record_type) == (300_000_000, whole.hexdigest(), "response")

    def peak(it):
        for _ in it:
            pass
        yield warc.pa.RecordBatch.from_arrays([warc.pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], ["kb"])

    most = spark.range(0, 4, 1, 4).mapInArrow(peak, "kb long").agg({"kb": "max"}).first()[0]
    assert most < 450_000
