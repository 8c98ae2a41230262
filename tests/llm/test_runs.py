import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidewake.llm import queries, runs

SF = "/root/testdata/sf0.01"


def brute(ids):
    """All runs by looking at every distance, smallest first."""
    n, out, seen = len(ids), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            b = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i + q - b >= max(6, 4 * q) and (b, i + q) not in seen:
                seen.add((b, i + q))
                out.append((b, i + q, q))
    return sorted(out)


def brute_np(ids):
    n, out, seen = len(ids), [], set()
    for q in range(1, n // 4 + 1):
        same = np.flatnonzero(np.diff(np.concatenate(([0], (ids[:-q] == ids[q:]).astype(np.int8), [0]))))
        for b, e in zip(same[::2].tolist(), same[1::2].tolist()):
            if e + q - b >= max(6, 4 * q) and (b, e + q) not in seen:
                seen.add((b, e + q))
                out.append((b, e + q, q))
    return sorted(out)


def periodic(rng, letters, pieces):
    out = []
    for _ in range(pieces):
        word = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 24, 31, 32, 33, 40, 64, 100]))]
        if rng.random() < 0.4:
            word = word * rng.randint(2, 5) + [rng.randrange(letters)]
        times = rng.choice([1, 2, 3, 4, 4, 5, 9])
        out += (word * (times + 1))[: len(word) * times + rng.randint(0, len(word))]
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for k in range(150):
        ids = periodic(rng, letters, rng.randint(1, 8)) if k % 3 else [rng.randrange(letters) for _ in range(rng.randint(0, 200))]
        got, want = runs.find_runs(np.array(ids, np.int64)), brute_np(np.array(ids, np.int64))
        assert got == want, ids
        if k < 20:
            assert want == brute(ids)


def test_nested_and_self_similar_words():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(2000)]
    inner = [1, 2, 3] * 6 + [9]
    nested = (inner * 5 + [8]) * 4 + inner * 2
    for ids in (fib[-1], thue, nested, nested * 4, [0] * 5, [0] * 6, [0, 1] * 4, [0, 1] * 3 + [0], (list(range(100)) * 5)[:399], (list(range(100)) * 5)[:400], (list(range(129)) * 5)[:-1]):
        assert runs.find_runs(np.array(ids, np.int64)) == brute_np(np.array(ids, np.int64))


def test_synchronising_sets_are_locally_consistent_and_dense():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50, 500), np.tile(rng.integers(0, 50, 20), 10), rng.integers(0, 50, 100)])
    ids = np.concatenate([ids, ids])
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for scale in (1, 2, 4, 8):
        h = runs._doubled(h, scale)
    members = runs.synchronising(h, 16, np.zeros(len(h), bool))
    half = len(ids) // 2
    assert np.max(np.diff(members)) <= 16 and len(members) < len(ids) / 4
    assert set(members[members < half - 40].tolist()) == {m - half for m in members.tolist() if half <= m < 2 * half - 40}


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def want_row(words):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = brute_np(ids)
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    drop = {i for b, e, q in found for i in range(b + q, e)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    top = (best[0], best[1] - best[0], best[2], (best[1] - best[0]) * 1000 // best[2]) if best else (None,) * 4
    return (len(found), *top, sha("".join(f"{b},{e - b},{q}\n" for b, e, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_whole_table_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op13_periodic_runs(spark, SF).collect()}
    want = {d: want_row(planted(d, t)) for d, t in texts.items()}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 50


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a a"), (5, "a a a a a"), (None, "x y " * 9), (None, "x y " * 9), (6, "é\x0bé\x0cé é\ré\né"), (7, "a\xa0a a\x1ca a\x85a"), (8, "w " * 300_000), (9, " ".join(f"w{i % 5000}" for i in range(19_999)))]
    frame = spark.createDataFrame([(*d, "n", 2) for d in docs], "doc_id long, text string, runs string, `b.est` int").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in runs.find(frame).collect())
    want = []
    for d, t in docs:
        words = (t or "").encode().split()
        found = [(0, len(words), {6: 1, 18: 2, 300_000: 1}[len(words)])] if len(words) >= 6 and d != 9 else []
        want.append((d or 0, len(words), found, found[0] if found else None, b" ".join(words[: found[0][2]] if found else words).decode()))
    assert got == sorted(want)
    assert runs.find(frame.limit(0)).count() == 0
    planted_text = {r.doc_id: r.text for r in runs.with_planted(spark.createDataFrame([(i, f"a b c d e f g{i} h" * 3) for i in range(300)] + [(None, "a b")], "doc_id long, text string")).collect()}
    assert all((t or "").encode().split() == planted(d, f"a b c d e f g{d} h" * 3) for d, t in planted_text.items() if d is not None)
