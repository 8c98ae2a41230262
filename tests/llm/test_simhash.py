import random

import xxhash
from pyspark.sql import functions as F

from tidewake.llm import simhash
from tidewake.operators.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum((sum(h >> k & 1 for h in hs) * 2 > len(hs)) << k for k in range(64))


def brute_classes(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_close_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        g = f
        for _ in range(rng.randint(1, 4)):
            g ^= 1 << rng.randrange(64)
            fps.append(g)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in [*fps, 0, 1, 3, 7]})
    got = {(r.a, r.b) for r in simhash.close_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        docs.append((i * 3, text))
        if i % 4 == 0:
            docs.append((i * 3 + 1, text.upper() + "\n"))
            docs.append((i * 3 + 2, text + " tail"))
    docs += [(1000, None), (1001, ""), (1002, " \t"), (1003, "x" * 20000), (1004, "one two"), (1004, "one two")]
    rows = [(i, t, "en", "s", 0) for i, t in docs] + [(None, "", "en", "s", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fp = {i: brute_fp(t) for i, t in docs}
    ids = sorted(fp)
    want = brute_classes(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted((i, f"{fp[i]:016x}", want[i]) for i, _ in docs)
    assert [(r.fingerprint, r.component_id) for r in got if r.doc_id is None] == [("0" * 16, None)]


def test_keep_first_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(2, "a b c d", "x"), (1, "a b c d", "y"), (5, "other words stand here", "z"), (5, "other words stand here", "z"), (None, "a b c d", "n")]
    rows += [(7, "quite another text is this", "b"), (7, "quite another text is this", "a"), (7, "the second text of seven stands here", "c"), (8, "the second text of seven stands here", "c"), (1, "one more of the first id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, simhash.keep_first(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[6], rows[7], rows[9]], key=str)
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {300: 300, 301: 300}
    assert got == want


def test_cells_of_a_small_table_are_not_broadcast(spark):
    fps = spark.range(5000).select((F.col("id") * 7919).alias("fp"))
    pairs = simhash.close_pairs(fps)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
