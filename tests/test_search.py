import math
import random
import tracemalloc

import numpy as np
import pytest

from tidewake.operators import retrieval


def brute(vectors, queries, k):
    out = {}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    ok = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)
    for q, w in queries:
        hits = [(-round(cos(v, w), 9), i) for i, v in vectors if ok(v) and ok(w) and len(v) == len(w)]
        out[q] = [i for _, i in sorted(hits)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_queries_of_any_length_and_ids_of_any_type(spark, monkeypatch, kind):
    rng = random.Random(3)
    name = (lambda i: f"v{i:04}") if kind == "string" else (lambda i: i)
    vectors = [(name(i), [float(rng.randint(-3, 3)) for _ in range(rng.choice([2, 3, 5]))]) for i in range(400)]
    vectors += [(name(900), None), (name(901), []), (name(902), [0.0, 0.0]), (name(903), [1.0, None]), (name(904), [math.inf, 1.0]), (name(905), [math.nan, 1.0, 2.0])]
    queries = [v for i, v in enumerate(vectors) if i % 7 == 0 or i >= 400]
    frame = lambda rows: spark.createDataFrame(rows, f"id {kind}, v array<double>").repartition(5)
    for sizes in ((64_000_000, 64_000_000, 1024), (200, 64_000_000, 16)):
        for n, v in zip(("QUERY_BYTES", "SCORE_BYTES", "SLICE"), sizes):
            monkeypatch.setattr(retrieval, n, v)
        got = {}
        for r in sorted(retrieval.nearest(frame(vectors), frame(queries), 4).collect(), key=lambda r: (-round(r.score, 9), r.id)):
            got.setdefault(r.query_id, []).append(r.id)
        assert got == brute(vectors, queries, 4)


def test_many_queries_take_bounded_memory():
    """What a task holds of the largest block of queries that nearest() makes, with 100,000 queries of 64 numbers asking for ten."""
    most = min(retrieval.QUERY_BYTES // (8 * 64), retrieval.SCORE_BYTES // (8 * (10 + retrieval.SLICE)))
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda x: x / np.sqrt((x * x).sum(1))[:, None])(rng.normal(size=(n, 64)))
    tracemalloc.start()
    best = retrieval._Best(unit(min(100_000, most)), 10)
    for part in range(4):
        best.add(unit(retrieval.SLICE), np.arange(part * 1024, part * 1024 + 1024).astype(object))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600_000_000 and np.isfinite(best.score).all()
