import collections
import math
import zlib

import pytest

from tidewake.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == docs.count()
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    other = spark.createDataFrame([(90_950, "язык которого никто не знает", None, None, None), (90_951, "漢字ばかりの文章です", "de", None, None), (90_953, "слово", None, None, None)], docs.schema)
    assert {r.doc_id for r in langid.keep_identified(docs.unionByName(other)).select("doc_id").collect()} == set(got)


def test_edges_and_independence_of_neighbours(spark):
    base = [(i, f"the cat and the dog {i}" if i % 2 else f"der hund und die katze {i}", "en" if i % 2 else "de", 1) for i in range(60)]
    odd = [(900, None, "en", 1), (901, "", None, 1), (902, "1234 --", "de", 1), (None, "the dog", "en", 1), (903, "die katze und der hund " * 5000, None, 1), (903, "the", None, 1)]
    docs = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, score int")
    model = langid.train(docs.where("doc_id < 60"))
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert sorted(got[-6:], key=str) == sorted([(900, "und"), (901, "und"), (902, "und"), (None, "en"), (903, "de"), (903, "en")], key=str)
    alone = [langid._classify([t], model["langs"], model["prior"], model["logp"]) for _, t, _, _ in base + odd]
    together = langid._classify([t for _, t, _, _ in base + odd], model["langs"], model["prior"], model["logp"])
    assert [x[0][0] for x in alone] == together[0]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([*range(60), -1, 903, 903])
    assert langid.identify(docs.limit(0)).count() == 0 and langid.keep_identified(docs.limit(0)).count() == 0


def buckets(text):
    """Every n-gram's bucket, one by one in whole numbers."""
    points, top = [ord(c) for c in text.lower()], 1 << 32
    out = []
    for i in range(len(points)):
        h = 0
        for n in range(3):
            h = (h * 0x01000193 + ((points[i + n] if i + n < len(points) else 32) + 1) * 0x9E3779B1) % top
            out.append(((h ^ (h >> 15)) * 0x85EBCA6B % top >> 16) & (langid.BUCKETS - 1))
    return out


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(9001, "язык", "en"), (9002, None, "en"), (9003, "a", None), (9004, "12", "de"), (9004, "12 x", "de")], "doc_id long, text string, lang string"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts, prior = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, lang in rows:
        if not held(i) and t is not None and lang is not None:
            counts[lang].update(buckets(t))
            prior[lang] += 1
    langs, want = sorted(counts), []
    logp = {x: {b: math.log((c + 0.1) / (sum(counts[x].values()) + 0.1 * langid.BUCKETS)) for b, c in counts[x].items()} for x in langs}
    none = {x: math.log(0.1 / (sum(counts[x].values()) + 0.1 * langid.BUCKETS)) for x in langs}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            want.append((i, held(i), "und", 0.0))
            continue
        grams = buckets(t)
        like = {x: sum(logp[x].get(b, none[x]) for b in grams) for x in langs}
        best = max(langs, key=lambda x: like[x] + math.log(prior[x] / sum(prior.values())))
        weight = min(len(grams), langid.EVIDENCE) / len(grams)
        each = [like[x] * weight for x in langs] + [-math.log(langid.BUCKETS) * len(grams) * weight]
        want.append((i, held(i), best, 1 / sum(math.exp(e - like[best] * weight) for e in each)))
    got = sorted(map(tuple, langid.identify(docs).collect()), key=str)
    want.sort(key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-4)
