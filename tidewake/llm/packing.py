"""Best-fit packing of documents into sequences of bounded length: bounded-space online best-fit, block by block."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.scratch import saved

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens of a sequence, and the id that ends each document.
LIMIT, END = 2048, 0
#: Sequences' worth of tokens that one block has, and open bins that it may keep.
BLOCK, OPEN_BINS = 4096, 8192
# ---- ids


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file, by the tiktoken library, which takes a quarter of
    the time.  The file's vocabulary becomes its ranks; that needs ids in the order of merges, as such files have them."""

    def __init__(self, path: str):
        import tiktoken

        said = json.load(open(path, encoding="utf-8"))
        model, cut = said["model"], said["pre_tokenizer"] or {}
        if said["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocabulary[x + y] for x, y in pairs]
        if order != sorted(order):
            raise ValueError(f"{path} has ids that are not in the order of its merges")
        # bytes that print stand for themselves, the others for the characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self.special = set(special)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, self.special), "<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---- bins


class Bins:
    """At most ``most`` open bins of ``limit`` tokens.  A bit per free space tells whether an open bin has it."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most = limit, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(limit + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item: the fullest open bin that has room for it, else a new one.  Where no more may be open,
        the fullest is closed first."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, at = self.limit, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.limit - free


def placed(lengths: Iterable[int], limit: int = LIMIT, most: int = OPEN_BINS) -> list[tuple[int, int]]:
    bins = Bins(limit, most)
    return [bins.place(n) for n in lengths]


# ---- the operator


def pieces(docs: DataFrame, path: str = TOKENIZER, limit: int = LIMIT, end: int = END, ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and ``end``, in pieces of ``limit`` at most.

    Only documents that are longer are cut; all their pieces but the first are full.  ``ids`` is array<int>.
    """
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if ids else {})
    schema = pa.schema(list(kinds.items()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.append(tool.encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                at, to = 0, len(got) % limit or limit
                for k in range(-(-len(got) // limit)):
                    part = got[at:to]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if ids else [])))
                    at, to = to, to + limit
                held += len(got) * ids + 1
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, ddl)


def pack(docs: DataFrame, path: str = TOKENIZER, limit: int = LIMIT, end: int = END, ids: bool = True, block: int = BLOCK, open_bins: int = OPEN_BINS) -> DataFrame:
    """Every piece of :func:`pieces` with its place: ``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``.

    Pieces are written once.  Full ones are sequences of their own.  The others are dealt by a hash of their row to blocks of
    about ``block`` sequences each, whatever the size of the table, so blocks are alike and none is hot; within a block they come
    by falling length and stream past ``open_bins`` open bins, best fit first.  A task's memory is that of the open bins.  Each block
    may leave one bin that is not full, one in ``block``.  Lost tasks place the same rows again in the same way.

    * NULL or empty text: one piece, ``end`` alone.  NULL or repeated doc_id: pieces for each row.
    * Very long text: one document's ids at a time are in memory.  Empty table: no rows.  Other columns are ignored.
    * Equal lengths in a block: by row number, so ties don't depend on the cluster.
    """
    cut = saved(pieces(docs, path, limit, end, ids), "pieces").withColumn("row", F.monotonically_increasing_id())
    full, rest = cut.where(F.col("length") == limit), cut.where(F.col("length") < limit)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, -(-tokens // (limit * block)))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    dealt = rest.select(*keep, "row", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields if f.name in keep} | {"sequence_id": "bigint", "offset": "bigint"}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bins = None, Bins(limit, open_bins)
        for batch in batches:
            seq, off = [], []
            for b, n in zip(batch.column("block").to_pylist(), batch.column("length").to_pylist()):
                if b != at:
                    at, bins = b, Bins(limit, open_bins)
                s, o = bins.place(n)
                seq.append(b << 32 | s)
                off.append(o)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*keep, "sequence_id", "offset"])

    ordered = dealt.repartition(min(blocks, 4096), "block").sortWithinPartitions("block", F.col("length").desc(), "row")
    filled = ordered.mapInArrow(fill, ", ".join(f"{c} {t}" for c, t in kinds.items()))
    alone = full.select(*keep, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return filled.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids, starts)`` of what :func:`pack` gives with ids; a group has ``limit`` tokens at most."""
    part = F.struct("offset", "doc_id", "ids")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return whole.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
