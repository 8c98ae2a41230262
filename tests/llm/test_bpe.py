import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewake.llm import bpe

SF = "/root/testdata/sf0.01"
PARTS = ["the ", "Über ", "élan ", "é", " ́", "x", " ", " ", "\x1c", "\n\n", "\t", "it's ", "12,5% ", "<|startoftext|>", "<|endoftext|> ", "\x00", " \x00 ", "😀", "İ", "ΣΑΣ ", "漢字", "'ll", "ing ", "​", "ſ", "... "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


def odd_text(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_any_cuts_join_to_the_same_ids(library):
    rng, tool = random.Random(5), bpe.codec(bpe.TOKENIZER)
    for _ in range(300):
        text = odd_text(rng, rng.randint(0, 40))
        joiner, at = bpe.Joiner(tool), 0
        for cut in sorted({rng.randint(0, len(text)) for _ in range(5)} | {len(text)}):
            if cut > at:
                joiner.add(bpe.stretch(text[at:cut].encode(), tool))
            at = cut
        ids = joiner.done()
        assert ids.tolist() == want(library, text)[0], repr(text)
        assert tool.decode(ids) == want(library, text)[1]


def test_chunks_are_whole_bounded_and_content_defined():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdé漢 ") for _ in range(40_000)).encode()
    parts = bpe.chunks(text)
    assert b"".join(parts) == text and max(map(len, parts)) <= bpe.MOST and all(p.decode() for p in parts)
    shifted = set(bpe.chunks(b"some other beginning " + text))
    assert len(shifted & set(parts)) > 0.7 * len(parts)
    assert bpe.chunks(b"") == [] and all(len(p) == bpe.MOST for p in bpe.chunks(b"a" * 3 * bpe.MOST))


def test_whole_table_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode(docs, result="digests").collect()}
    for i, text in ((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        ids, decoded = want(library, text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_shared_passages_and_edges(spark, library):
    rng = random.Random(7)
    passage = odd_text(rng, 1500)
    docs = [(i, odd_text(rng, 5) + passage[: 3000 + 100 * i] + odd_text(rng, rng.randint(0, 200)) + passage) for i in range(12)]
    docs += [(100, None), (101, ""), (102, " \n "), (103, "x" * 30_000), (104, "x" * 30_000 + " y"), (0, docs[0][1]), (0, docs[0][1]), (None, passage), (105, "é" * 20_000)]
    rows = [(*d, "ids") for d in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).sortWithinPartitions("doc_id")
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode(frame).collect()), key=str)
    assert got == sorted(((i, *want(library, t)) for i, t in docs), key=str)
    assert bpe.encode(frame.limit(0)).count() == 0
