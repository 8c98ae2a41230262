import random

import numpy as np

from tidewake.llm import neardup

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [v / np.abs(v).max() for _, v in good]
    unit = [v / np.linalg.norm(v) for v in unit]
    label, links = {i: i for i, _ in good}, [0] * len(good)
    pairs = [(a, b) for a in range(len(good)) for b in range(a) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    edges, changed = [(good[a][0], good[b][0]) for a, b in pairs], True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    out = [(i, n, label[i], i == label[i]) for (i, _), n in zip(good, links)]
    bad = [i for i, v in rows if not any(i == g and v is w for (g, _), w in zip(good, [v])) and not (i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    return sorted(out + [(i, 0, i, i is not None) for i in bad], key=str)


def near(rng, v, cosine):
    w = rng.normal(size=len(v))
    w -= (w @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + (1 - cosine**2) ** 0.5 * w / np.linalg.norm(w)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 18))
    rows = [(i * 7, v.tolist()) for i, v in enumerate(base)]
    for i in range(0, 300, 3):
        rows.append((3000 + i, near(rng, base[i], [0.899, 0.901, 0.95, 0.9999][i % 4]).tolist()))
        rows.append((6000 + i, (base[i] * 3).tolist()))
    hot = [near(rng, base[5], 0.99).tolist() for _ in range(150)] + [base[6].tolist()] * 100
    rows += [(9000 + i, v) for i, v in enumerate(hot)]
    rows += [(1, None), (2, []), (3, [0.0] * 18), (4, [float("nan")] * 18), (5, [float("inf")] + [1.0] * 17), (8, [None] + [1.0] * 17), (None, base[5].tolist()), (9, [1.0, 2.0]), (10, [2.0, 4.1]), (11, [1e-200] * 18), (12, [1e200] * 18)]
    random.Random(1).shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string"))
    want = brute(rows)
    want = [(i, n, c, k) for i, n, c, k in want]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_repeated_ids_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 1, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_whole_table_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    assert sorted(map(tuple, neardup.near_duplicates(table).collect()), key=str) == brute(rows)
