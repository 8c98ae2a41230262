import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewake.llm import lm

SF = "/root/testdata/sf0.01"


def brute_base(docs):
    words = [(i, (t or "").encode().lower().split()) for i, t in docs]
    fold = [None if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in docs]
    c = collections.Counter(w for (_, ws), f in zip(words, fold) if f is not None and f != 2 for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    return [(i, f == 2, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None])) for (i, ws), f in zip(words, fold)]


def same(got, docs):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=lambda r: (str(r[0]), r[2]))
    want = sorted(brute_base(docs), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-12)


def coded(texts):
    block = lm.Block(pa.array(texts, pa.string()))
    return lm.sequences(block.at, block.sizes, *block.subwords(lm.RANKS))


def toy(texts, rng, frequent=None):
    flat, n = coded(texts)
    counts = np.bincount(flat, minlength=len(lm._starts(lm.RANKS))).astype(float)
    shape = lm.Shape(rng.integers(0, lm.CLASSES - 1, len(counts)), counts, len(texts))
    return shape, shape.weights(rng), flat, n


def naive(w, shape, seq):
    """log P of each subword and of the end, and the whole distribution at each step, position by position in double precision."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    rows = [shape.begin, *shape.row[seq]]
    x = [w["E"][rows[t]] + w["B"][rows[t - 1] if t else shape.begin] for t in range(len(rows))]
    out, every = [], []
    wq, wk, wv = np.split(w["QKV"], 3, axis=1)
    for t, target in enumerate([*seq, None]):
        first = max(0, (t // lm.STRIDE - 1) * lm.STRIDE)  # for a text that begins at a stride's begin
        s = np.array([(x[t] @ wq) @ (x[j] @ wk) / lm.WIDTH**0.5 + w["R"][t - j] for j in range(first, t + 1)])
        a = np.exp(s) / np.exp(s).sum()
        h = x[t] + sum(p * (x[j] @ wv) for p, j in zip(a, range(first, t + 1))) @ w["O"]
        h = h + np.maximum(h @ w["H"] + w["h"], 0) @ w["D"]
        e = np.exp(h @ w["C"] + w["c"])
        p_class = e / e.sum()
        members = [np.exp(h @ w[f"M{k}"] + w[f"m{k}"]) for k in range(lm.CLASSES - 1)]
        p = np.array([p_class[shape.cls[i]] * members[shape.cls[i]][shape.member[i]] / members[shape.cls[i]].sum() for i in range(0, len(shape.cls), 1)]) * np.exp(shape.within.astype(np.float64))
        every.append(p.sum() + p_class[-1])
        out.append(math.log(p_class[-1] if target is None else p[target]))
    return out, every


def test_whole_table_base_equals_brute_force_and_model_beats_it_on_held_out_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm.score(table, how=lm.Settings(block=200_000)).collect()
    same(got, [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    for held in (True, False):
        score, base = (sum(r[k] for r in got if r.held_out == held) for k in ("score", "base_score"))
        assert score > base
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_beats_base_on_more_rows(spark):
    held = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > 0.96 * held["sum(base_score)"]


def test_scores_equal_those_step_by_step_and_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    texts = ["the cat sat on the mat " * 9, "la casa", "", "unknownword " * 3]
    shape, w, flat, n = toy(texts[:2], rng)
    for text in texts:
        seq, length = coded([text])
        want, every = naive(w, shape, seq)
        # classes without any seen member keep a share for what is rare, so all subwords and the end sum to one
        assert every == pytest.approx([1.0] * len(every), abs=1e-4)
        assert lm.scores(w, shape, seq, length)[0] == pytest.approx(sum(want), rel=1e-4)


def test_batched_scores_equal_one_by_one(monkeypatch):
    """Texts are laid end to end, so that windows cut them elsewhere; a text in its first two strides sees all that is before."""
    rng = np.random.default_rng(3)
    shape, w, flat, n = toy(["one two three four five " * 2, "red green", "", "blue " * 5, "la casa de la"], rng)
    ends = np.cumsum(n)
    together = lm.scores(w, shape, flat, n)
    alone = [lm.scores(w, shape, flat[e - k : e], np.array([k]))[0] for e, k in zip(ends, n)]
    assert together == pytest.approx(alone, rel=1e-4)
    monkeypatch.setattr(lm, "_WINDOWS", 1)
    assert lm.scores(w, shape, flat, n) == pytest.approx(together, rel=1e-5)


def test_each_step_is_scored_once_and_later_ones_are_not_seen():
    rng = np.random.default_rng(4)
    shape, w, flat, n = toy(["alpha beta gamma delta " * 40, "a b"], rng)
    s = lm.Stream(shape, flat, n)
    assert s.n == len(flat) + len(n) and (s.target != -2).sum() == s.n and (s.target == -1).sum() == 2
    # a text's score doesn't change with what follows it
    longer = np.concatenate([flat[: n[0]], flat[n[0] :], flat[:50]])
    assert lm.scores(w, shape, longer, np.array([n[0], n[1], 50]))[:2] == pytest.approx(lm.scores(w, shape, flat, n), rel=1e-5)
    # the same words, one step more: all earlier log probabilities stay
    a, b = naive(w, shape, flat[:40])[0], naive(w, shape, flat[:41])[0]
    assert a[:40] == pytest.approx(b[:40])


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    shape, w, flat, n = toy(["alpha beta gamma delta " * 20, "a b", "", "red red green"], rng)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    s = lm.Stream(shape, flat, n)
    every = np.arange(s.windows)
    _, g = lm.gradients(w, shape, s, every)
    for k in g:
        for _ in range(2):
            at = np.unravel_index(np.argmax(np.abs(g[k])) if _ else rng.integers(g[k].size), g[k].shape)
            up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            slope = (lm.gradients(up, shape, s, every)[0] - lm.gradients(down, shape, s, every)[0]) / 2e-4
            assert g[k][at] == pytest.approx(slope, rel=2e-2, abs=2e-4), k


def test_ends_of_short_empty_and_long_texts_are_learned():
    texts = ["one two three"] * 300 + [""] * 300 + ["red green blue " * 40 + "red " * (i % 12) for i in range(60)]
    flat, n = coded(texts)
    counts = np.bincount(flat, minlength=len(lm._starts(lm.RANKS))).astype(float)
    shape = lm.Shape(np.where(lm._starts(lm.RANKS), lm.CLASSES - 2, lm.CLASSES - 3), counts, len(texts))
    w, _, losses = lm.fit(shape, flat, n, steps=300)
    assert losses[-1] < losses[0]
    got = lm.scores(w, shape, *coded(["one two three", "", "one two"]))
    assert got[0] > -2 and got[1] > -2 and got[2] < got[0] - 2


def test_all_blocks_train_and_their_copies_are_averaged(spark):
    how = lm.Settings(start=500, steps=5, share=1, block=2000)
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", f"word{i}"]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    blocks = lm._packed(table, lm.RANKS, 7, 2, how.block)
    rows = [lm._Row(r.asDict()) for r in blocks.collect()]
    flat, n = coded([t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2])
    counts = lm._subword_counts(blocks, len(lm._starts(lm.RANKS)))
    assert (np.bincount(flat, minlength=len(counts)) == counts).all()
    assert sorted(k for r in rows for k in r.taught()[1].tolist()) == sorted(n.tolist())
    shape, w, square = lm._started(blocks, counts, len(n), lm.RANKS, how)
    got = lm._trained(blocks, shape, w, square, how)
    moved, windows = {k: np.zeros(v.shape) for k, v in w.items()}, 0
    by_task = collections.defaultdict(list)
    for batch in blocks.rdd.mapPartitionsWithIndex(lambda i, it: [(i, r.block) for r in it]).collect():
        by_task[batch[0]].append(batch[1])
    at = {r.row["block"]: r for r in rows}
    for task in by_task.values():
        copy, state, k = {n: v.copy() for n, v in w.items()}, {}, 0
        for b in task:
            k += lm.further(copy, square, shape, *at[b].taught(), b, 1, state)
        windows += k
        for name in w:
            moved[name] += (copy[name] - w[name]).astype(np.float64) * k
    assert windows > 50
    for name in w:
        assert got[name] == pytest.approx(w[name] + moved[name] / windows, abs=1e-5)


def test_edges(spark):
    few = lm.Settings(steps=5)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "The", "cat", "ÉLAN", "élan", f"u{i}"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 30_000), (103, "w " * 20_000), (5, docs[5][1]), (None, "the cat alone"), (104, "a b \x1c c"), (105, "  \t a\x0b\x0cb\x85c d \n")]
    schema = "doc_id long, text string, block string, score int"
    same(lm.score(spark.createDataFrame([(*d, "x", 1) for d in docs], schema), how=few).collect(), docs)
    assert lm.score(spark.createDataFrame([], schema), how=few).count() == 0
    only = [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")]
    same(lm.score(spark.createDataFrame([(*d, "x", 1) for d in only], schema), how=few).collect(), only)


def test_by_default_every_window_of_the_corpus_trains():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], rng.integers(0, 90))) for _ in range(300)]
    shape, w, flat, n = toy(texts, rng)
    square = {k: np.ones_like(v) for k, v in w.items()}
    s, seen = lm.Stream(shape, flat, n), []
    count = lm.further({k: v.copy() for k, v in w.items()}, square, shape, flat, n, 5, state={})
    assert count == s.windows > 100
    # what changes in any one window changes the weights
    for at in (0, len(flat) // 3, len(flat) - 1):
        changed, copies = flat.copy(), [{k: v.copy() for k, v in w.items()} for _ in range(2)]
        changed[at] = coded(["alpha"])[0][0] if flat[at] != coded(["alpha"])[0][0] else coded(["beta"])[0][0]
        for copy, ids in zip(copies, (flat, changed)):
            lm.further(copy, square, shape, ids, n, 5, state={})
        seen.append(max(np.abs(copies[0][k] - copies[1][k]).max() for k in w))
    assert min(seen) > 0


def test_gradients_of_consecutive_windows_are_the_sum_of_each_ones():
    rng = np.random.default_rng(9)
    shape, w, flat, n = toy(["alpha beta gamma delta " * 200, "a b", "", "red red green " * 60, "blue"], rng)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    s = lm.Stream(shape, flat, n)
    every = np.arange(s.windows)
    steps = [int((s.target[(i + 1) * lm.STRIDE : (i + 2) * lm.STRIDE] != -2).sum()) for i in every]
    loss, g = lm.gradients(w, shape, s, every)
    alone = [lm.gradients(w, shape, s, every[i : i + 1]) for i in every]
    assert loss == pytest.approx(np.average([a[0] for a in alone], weights=steps), rel=1e-5)
    apart = lm.gradients(w, shape, s, every[::2])
    for k in g:
        want = sum(a[1].get(k, 0) * c for a, c in zip(alone, steps)) / sum(steps)
        assert g[k] == pytest.approx(want, rel=1e-3, abs=1e-5), k
        if k in apart[1]:
            want = sum(alone[i][1].get(k, 0) * steps[i] for i in every[::2]) / sum(steps[::2])
            assert apart[1][k] == pytest.approx(want, rel=1e-3, abs=1e-5), k


@pytest.mark.parametrize("rows", [0, 1, lm.STRIDE, 128, 300])
def test_products_by_pieces_equal_whole_ones(rows):
    rng = np.random.default_rng(10)
    x, w, d = rng.normal(size=(rows, 20)), rng.normal(size=(17, 5)), rng.normal(size=(rows, 6))
    assert lm._times(x[:, :17], w) == pytest.approx(x[:, :17] @ w)
    assert lm._across(x[:, 3:], d) == pytest.approx(x[:, 3:].T @ d)


@pytest.mark.parametrize("apart", [1, 2])
def test_windows_computed_some_at_a_time_have_the_same_gradients_and_scores(monkeypatch, apart):
    """Neighbours that fall into different groups share a stride, whose gradients come from both."""
    rng = np.random.default_rng(11)
    shape, w, flat, n = toy(["alpha beta gamma delta " * 200, "a b", "", "red red green " * 60, "blue"], rng)
    s, found = lm.Stream(shape, flat, n), []
    for together, dtype in ((1000, np.float64), (7, np.float64), (1, np.float64), (7, np.float32)):
        monkeypatch.setattr(lm, "_TOGETHER", together)
        typed = {k: v.astype(dtype) for k, v in w.items()}
        found.append((*lm.gradients(typed, shape, s, np.arange(0, s.windows, apart)), lm.scores(w, shape, flat, n)))
        assert {k: (v.shape, np.float64 if k == "R" else dtype) for k, v in w.items() if k in found[-1][1]} == {k: (v.shape, v.dtype) for k, v in found[-1][1].items()}
    assert s.windows > 20
    for loss, g, scored in found[1:]:
        assert loss == pytest.approx(found[0][0], rel=1e-5) and scored == pytest.approx(found[0][2], rel=1e-5)
        assert g.keys() == found[0][1].keys()
        for k in g:
            assert g[k] == pytest.approx(found[0][1][k], rel=1e-3, abs=1e-6), k


def test_blocks_hold_the_bytes_of_words_of_slices_and_nulls():
    texts = pa.array(["zzz", " The café ÉLAN\tthe \x1c", None, "", "a\x0bb the"], pa.string())
    block = lm.Block(texts.slice(1))
    assert [[block.words[i] for i in part] for part in np.split(block.at, np.cumsum(block.sizes)[:-1])] == [(t or "").encode().lower().split() for t in texts.slice(1).to_pylist()]
    assert lm.Block(pa.array([None, ""], pa.string())).words == []
