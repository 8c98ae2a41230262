import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewake.llm import packing, queries

SF = "/root/testdata/sf0.01"
PARTS = ["the ", " Über", "élan ", "é", " ́", "x", " ", "  ", "\x1c", " \x1c ", "\n\n", "\t", "it's ", "12,5% ", "<|endoftext|>", " <|endoftext|> ", "\x00", "😀", " 漢字", "'ll", " ", " ", "…", "'s "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.TOKENIZER)


def plain_fit(lengths, limit, most):
    """Best fit by looking at every open bin."""
    open_, out, made = [], [], 0
    for n in lengths:
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            if len(open_) >= most:
                open_.remove(min(open_, key=lambda b: b[0]))
            b = [limit, made]
            made += 1
            open_.append(b)
        out.append((b[1], limit - b[0]))
        b[0] -= n
        if not b[0]:
            open_.remove(b)
    return out


@pytest.mark.parametrize("limit,most", [(50, 4), (50, 1000), (2048, 16)])
def test_bins_are_those_of_a_search_of_all_open_bins(limit, most):
    rng = random.Random(limit + most)
    lengths = [rng.randint(1, limit) for _ in range(3000)]
    got, want = packing.placed(lengths, limit, most), plain_fit(lengths, limit, most)
    spaces = lambda places: [limit - o - n for (_, o), n in zip(places, lengths)]  # noqa: E731  bins of one free space are alike
    assert spaces(got) == spaces(want) and len({b for b, _ in got}) == len({b for b, _ in want})


def test_open_bins_are_bounded_and_the_fullest_closes_first():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the bin of 7 was closed
    assert bins.open == 2 and bins.place(3) == (0, 6) and bins.place(2) == (2, 8) and bins.open == 1


def test_ids_are_those_of_the_library(library):
    rng, tool = random.Random(3), packing.encoder(packing.TOKENIZER)
    for _ in range(600):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        assert tool.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, texts, library, limit=2048):
    """Pieces make up each document, and places don't overlap, leave no gaps and stay within the limit."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and len(mine) == -(-len(ids) // limit)
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (r is mine[0] or r["length"] == limit)
            at += r["length"]
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    return len(by_sequence), sum(r["length"] for r in rows)


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made, tokens = check([r.asDict() for r in queries.op11_packing(spark, SF).collect()], texts, library)
    assert made <= 1.002 * -(-tokens // 2048) + 1


def test_edges_and_blocks(spark, library):
    rng = random.Random(8)
    texts = {i: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))) for i in range(200)} | {900: None, 901: "", 902: "word " * 9000, 903: "x" * 20_000, 904: " "}
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, ids string, `row` int").repartition(3)
    packed = packing.pack(frame, limit=256, block=8, open_bins=16).cache()
    made, tokens = check([r.asDict() for r in packed.collect()], texts, library, 256)
    assert made <= 1.1 * -(-tokens // 256)
    whole = packing.sequences(packed).collect()
    assert len(whole) == made and sum(len(r.ids) for r in whole) == tokens and max(len(r.ids) for r in whole) <= 256
    for r in whole[:50]:
        for d, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)]):
            ids = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 0]
            assert any(r.ids[a:b] == ids[i : i + b - a] for i in (0, *range(len(ids) % 256, len(ids), 256)))
    assert packing.pack(frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack(twice, ids=False).collect()) == [(0, 3), (0, 3), (1, 2), (1, 2)]
