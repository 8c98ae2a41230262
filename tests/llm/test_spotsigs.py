import hashlib
import random

import regex
import xxhash

from tidewake.llm import queries, spotsigs

SCHEMA = "doc_id long, text string, sigs string"


def brute_edits(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, t) in enumerate(order):
        nxt, t = order[(k + 1) % len(order)][1] or "", t or ""
        third = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - third] + nxt[:third]).encode()).hexdigest())
    return out


def text(rng, n):
    return " ".join(rng.choice(["the", "of", "und", "cat", "dog", "sat", "élan", "mat", "😀x", "house", "tree"]) for _ in range(n))


def test_edits_and_likeness_equal_brute_force(spark):
    rng = random.Random(3)
    ids = rng.sample(range(0, 60_000), 80) + [1 << 40, (1 << 40) + 1]
    docs = [(i, text(rng, rng.randint(0, 60))) for i in ids] + [(70_001, None), (70_002, ""), (70_003, "z" * 9001)]
    got = {r.doc_id: r for r in spotsigs.fingerprint(spark.createDataFrame([(*d, "x") for d in docs], SCHEMA)).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute_edits(docs)
    order = sorted(got, reverse=True)
    sets = {i: set(r.fingerprint.split(",")) for i, r in got.items()}
    for i, nxt in zip(order, order[1:] + order[:1]):
        edited = set(got[i].edited_fingerprint.split(","))
        assert abs(got[i].near_edited - len(sets[i] & edited) / len(sets[i] | edited)) < 1e-12
        assert abs(got[i].near_next - len(sets[i] & sets[nxt]) / len(sets[i] | sets[nxt])) < 1e-12


def test_signatures_by_hand(spark):
    row = spark.createDataFrame([("The cat, sat on the BIG mat of",), ("the cat sat on the big mat",), ("nothing anchors here maybe",), ("",)], "t string").select(spotsigs.signatures(spotsigs.F.col("t")).alias("s")).collect()
    assert row[0].s == row[1].s and len(row[0].s) == 2
    assert len(row[2].s) == 2 and len(row[3].s) == 1 and not set(row[2].s) & set(row[3].s)


def brute_signatures(text):
    """Signatures word by word, with the hash that Spark chains over its arguments."""

    def chained(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64(p.encode(), seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    out, run, open_ = set(), [], []
    for w in words:
        if w in spotsigs.ANCHORS:
            run.append(w)
            continue
        if open_:
            out.add(chained(open_[0], w))
        open_ = [" ".join([*run, w])] if run else []
        run = []
    if out:
        return sorted(out)
    return sorted({chained(*words[i : i + 3]) for i in range(len(words) - 2)}) if len(words) > 2 else [chained(" ".join(words))]


def test_signatures_equal_brute_force_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").dropna().unionByName(spark.createDataFrame([("The",), ("the of cat",), ("cat the dog the",), ("x y z w",), ("x y",), ("",), ("a cat b",), ("The  cat--the, the dog; cow",)], "text string"))
    for r in docs.select("text", spotsigs.signatures(spotsigs.F.col("text")).alias("s")).collect():
        assert r.s == brute_signatures(r.text), r.text[:200]


def test_texts_without_anchors_are_like_their_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    a, b = " ".join(words), " ".join([*words[:50], "other", *words[51:]])
    one = spark.createDataFrame([(a, b)], "a string, b string").select(spotsigs.likeness(spotsigs.signatures(spotsigs.F.col("a")), spotsigs.signatures(spotsigs.F.col("b"))).alias("j")).first().j
    assert abs(one - 95 / 101) < 1e-9


def test_edges(spark):
    one = spotsigs.fingerprint(spark.createDataFrame([(5, "abcdef", "")], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    rows = [(2, "abcdef", ""), (2, "ghijkl", ""), (None, "mnopqr", ""), (1, "stuvwx", "")]
    got = {(r.doc_id, r.fingerprint): r.edited_sha256 for r in spotsigs.fingerprint(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {hashlib.sha256(x.encode()).hexdigest() for x in ("abcdst", "ghijst", "mnopgh", "stuvmn")}
    assert len(got) == 4 and set(got.values()) == want
    assert spotsigs.fingerprint(spark.createDataFrame([], SCHEMA)).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for i in range(40):
        t = text(rng, rng.randint(5, 80))
        docs += [(10 * i, t), (10 * i + 1, t), (10 * i + 2, t + " of the cat sat"), (10 * i + 3, "the dog sat. " + t)]
    frame = spark.createDataFrame([(*d, "") for d in docs], SCHEMA)
    sets = {r.doc_id: frozenset(r.s) for r in frame.select("doc_id", spotsigs.signatures(spotsigs.F.col("text")).alias("s")).collect()}
    pairs, members = spotsigs.similar_pairs(frame)
    rep = {r.doc_id: r.class_id for r in members.collect()}
    assert all(rep[i] == min(j for j in sets if sets[j] == sets[i]) for i in sets)
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_any_doc_id_may_occur(spark):
    rows = [(-(1 << 62), "abcdef", ""), (-(1 << 63), "ghijkl", ""), ((1 << 63) - 1, "mnopqr", ""), (None, "stuvwx", "")]
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.fingerprint(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(1 << 63) - 1: "mnopab", -(1 << 62): "abcdgh", -(1 << 63): "ghijst", None: "stuvmn"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_classes_of_a_whole_table_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", spotsigs.signatures(spotsigs.F.coalesce("text", spotsigs.F.lit(""))).alias("s")).collect()}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-12
    links = {d: sum(s != t and like(s, t) for t in first) for s, d in first.items()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op7_spotsigs_classes(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (first[s], links[first[s]]) for d, s in sets.items()} and any(links.values())


def test_a_text_is_split_once(spark):
    """Inside of lambdas Spark shares nothing: each mention of the words was another pass over the text."""
    plan = spark.createDataFrame([("the cat sat",)], "text string").select(spotsigs.signatures(spotsigs.F.col("text")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1 and plan.count("split(array_join(") == 1
