import re
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_classes, brute_fp
from tidewake.scratch import saved

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10_001, None, None, "src0", 0), (10_002, " 12 -- 7 ", "en", "src0", 9), (10_003, "слова на другом языке", None, "src1", 21)], docs.schema)
    table, after = docs.unionByName(junk), []
    for name, stage in corpus_pipeline.STAGES:
        table = saved(stage(spark, table, SF), "stage")
        after.append(table)
    assert all(t.columns == docs.columns for t in after[:-1])
    identified, deduped, mixed, encoded = ([tuple(r) for r in t.collect()] for t in after)
    assert {r[0] for r in identified} == {r.doc_id for r in docs.select("doc_id").collect()}
    fps = {r[0]: brute_fp(r[1]) for r in identified}
    ids = sorted(fps)
    linked = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert sorted(r[0] for r in deduped) == sorted(i for i, c in brute_classes(ids, linked).items() if i == c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in deduped:
        size[r[3]] += words(r[1])
    for r in mixed:
        taken[r[3]] += words(r[1])
        times[r[0]] += 1
    assert max(times.values()) <= 2 and set(times) <= {r[0] for r in deduped}
    most = max(words(r[1]) for r in deduped)
    assert all(abs(taken[s] - t) <= most for s, t in brute_targets(size).items())
    assert sorted(r[0] for r in encoded) == sorted(r[0] for r in mixed)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, copies long, `row` int, key binary"
    rows = [(i, t, "en", "s", 0, "f", 7, 1, b"k") for i, t in enumerate(["the cat sat on the mat again", "the cat sat on the mat again", "a dog ran over the hill today", None, ""])] * 2
    for at, table in (("none", []), ("some", rows)):
        spark.createDataFrame(table, schema).write.parquet(str(tmp_path / at / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / at))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert {r.doc_id for r in out.collect()} <= {0, 2}


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_columns_with_dots_and_of_kinds_without_an_order(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c d` int, m map<string,int>, `__x.y` array<map<string,int>>"
    rows = [(i, t, "en", "s", 0, "f", 7, {"k": i}, [{"z": i}]) for i, t in enumerate(["the cat sat on the mat again", "the cat sat on the mat again", "a dog ran over the hill today", None])] * 3
    rows += [(0, "quite another text under the same number", "en", "s", 0, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = saved(stage(spark, frame, ""), "stage")
        assert out.columns == frame.columns and {r.doc_id for r in out.collect()} <= {0, 1, 2, 3}
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 0, 2, 3]
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
