import math
import pathlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tidewake.llm import audit, queries

SF = "/root/testdata/sf0.01"
PARTS = ["the", "The", "Ü", "é", "漢字", "😀", "%", "&", "#", "x" * 70, "x" * 71, "y" * 300, "abcdefgh", "abcdefghi", "\x00", "\x1c", " ", " ", " ", "\n", "\t", "\x0b", " "]
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return text.encode().split()


def odd(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def plain(text):
    w = words(text)
    return len(w), len(set(w)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)


@pytest.mark.parametrize("step", [7, 64, 1 << 20])
def test_counts_of_any_texts_in_any_steps(monkeypatch, step):
    monkeypatch.setattr(audit, "STEP", step)
    rng = random.Random(step)
    texts = ["", *(odd(rng, rng.randint(0, 80)) for _ in range(120)), "", "ab " * 3000, "a" * 4000, ""]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    got = audit.counted(data, np.cumsum([len(r) for r in raw]))
    assert list(zip(*(got[k].tolist() for k in audit.COUNTS))) == [plain(t) for t in texts]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(audit.Spans, "_hashed", lambda self, text, at, n: np.zeros(len(at), np.uint64))
    text = b"ab cd ab abcdefghij abcdefghik ab cd " + b"z" * 80 + b" " + b"z" * 79 + b"y " + b"z" * 80
    data = np.frombuffer(text + bytes(8), np.uint8)
    assert audit.counted(data, np.array([len(text)]))["n_distinct"][0] == len(set(text.split()))


def brute(docs, labels):
    """Every order, document by document."""
    marks = defaultdict(lambda: [0, 0])
    for d, q, t in labels:
        marks[d] = [marks[d][0] or q == 1, marks[d][1] or t == 1]
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w, u, cap, n, sym = plain(t)
        fails = {f for f, on in zip("ABCDE", (w < 200, 100 * u < 50 * w, 100 * cap > 3 * n, sym > 0, d is not None and d > least[t])) if on}
        rows.append((lang or "", fails, marks[d] if d is not None else [0, 0]))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            here = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone = [r for r in here if f in r[1]]
                redundant = sum(f in r[1] and bool(r[1] & set(order[:k])) for r in rows if r[0] == part)
                here = [r for r in here if f not in r[1]]
                out[part, order, k + 1] = [len(here), len(gone), redundant, sum(r[1] == {f} for r in rows if r[0] == part), sum(bool(r[2][0]) for r in gone), sum(bool(r[2][1]) for r in gone)]
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def test_whole_table_equals_brute_force_and_sql(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = as_dict(queries.op12_filter_audit(spark, SF))
    assert got == brute(docs, labels) and any(v[2] for v in got.values())
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql = con.execute(audit.ORACLE).fetchall()
    assert {tuple(r[:3]): tuple(r[3:]) for r in sql} == got


def test_edges(spark):
    rng = random.Random(4)
    long = "Word " * 150 + " ".join(f"w{i}" for i in range(300))
    docs = [(5, long, "en"), (3, long, "de"), (3, long, "de"), (3, long, "en"), (9, long, None), (None, long, "en"), (None, None, ""), (7, None, "en"), (8, "", "de"), (8, "# x", "de"), (10, "A%", "fr"), (11, long + "&", "fr"), (-4, "é" * 50_000, "fr")]
    docs += [(100 + i, odd(rng, rng.randint(0, 500)), rng.choice(["en", "de"])) for i in range(40)]
    labels = [(5, 1, 0), (5, 0, 1), (8, None, 1), (None, 1, 1), (9, 1, 1), (10, 0, 0), (11, 2, 3), (1234, 1, 1)]
    frame = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, lang string, n string, `part.x` int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert as_dict(audit.interactions(audit.judged(frame), marks)) == brute(docs, labels)
    assert as_dict(audit.interactions(audit.judged(frame), marks.limit(0))) == brute(docs, [])
    assert audit.interactions(audit.judged(frame.limit(0)), marks).count() == 0
    assert math.factorial(5) == 120
