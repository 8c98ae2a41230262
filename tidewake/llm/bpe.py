"""BPE encoding and decoding with content-defined chunks that are encoded once and joined by repair."""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.scratch import saved

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Chunk sizes in bytes: least, mean beyond the least, most.
LEAST, MEAN_BITS, MOST = 256, 10, 8192
#: Pieces that a Python worker remembers the ids of.
CACHE = 400_000
#: Bounds of the broadcast bitmap of shared chunks, in bits.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


# ---- chunks


@functools.cache
def _gear() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 ``data``: a cut depends on the 16 bytes before it and the cut before.

    Cuts fall anywhere but inside a character.
    """
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _gear()[raw]
    for back, mult in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (4, 0xC2B2AE35), (8, 0x27D4EB2F)):  # windows of 2, 4, 8, 16
        h[back:] += h[:-back] * np.uint32(mult)
    fits = np.flatnonzero((h[:-1] >> np.uint32(32 - MEAN_BITS) == 0) & (raw[1:] & 0xC0 != 0x80)) + 1
    ends, at = [], 0
    for cut in fits.tolist():
        while cut - at > MOST:
            at = _whole(raw, at + MOST)
            ends.append(at)
        if cut - at >= LEAST:
            at = cut
            ends.append(at)
    while n - at > MOST:
        at = _whole(raw, at + MOST)
        ends.append(at)
    return [*ends, n] if at < n else ends


def _whole(raw: np.ndarray, cut: int) -> int:
    while raw[cut] & 0xC0 == 0x80:
        cut -= 1
    return cut


def chunks(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in chunk_ends(data):
        out.append(data[at:end])
        at = end
    return out


def key_of(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


# ---- encoding


class Codec:
    """Ids of texts, by a tokenizer that drops white space, so that pieces between spaces are independent."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_padding()
        self.tool.no_truncation()
        size = self.tool.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.tokens = [self.tool.id_to_token(i) or "" for i in range(size)]
        self.seen: dict[bytes, bytes] = {}
        one, two, both = (self._ids(x) for x in ("ab", "cd", " ab \n cd "))
        if one + two != both:
            raise ValueError(f"{path} keeps white space; its pieces are not independent")
        mark = self._ids("\x00")
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, text: str) -> list[int]:
        return self.tool.encode(text, add_special_tokens=False).ids

    def learn(self, pieces: set[bytes]) -> None:
        """Encodes pieces that are not known yet, many at a time between marks."""
        new = [p for p in pieces if p not in self.seen]
        if len(self.seen) + len(new) > CACHE:
            self.seen.clear()
            new = list(pieces)
        odd = [p for p in new if self.mark is None or b"\0" in p]
        for p in odd:
            self.seen[p] = np.array(self._ids(p.decode("utf-8", "surrogatepass")), self.dtype).tobytes()
        plain = [p for p in new if p not in self.seen] if odd else new
        lots = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        lines = [" \0 ".join([p.decode("utf-8", "surrogatepass") for p in lot]) for lot in lots]
        width = self.dtype.itemsize
        for lot, found in zip(lots, self.tool.encode_batch_fast(lines, add_special_tokens=False) if lines else ()):
            ids = np.array(found.ids, self.dtype)
            cuts = (np.flatnonzero(ids == self.mark) * width).tolist()
            raw, at = ids.tobytes(), 0
            for p, cut in zip(lot, [*cuts, len(raw)]):
                self.seen[p] = raw[at:cut]
                at = cut + width

    def encode(self, data: bytes) -> bytes:
        pieces = data.split()
        seen = self.seen
        try:
            return b"".join([seen[p] for p in pieces])
        except KeyError:
            self.learn(set(pieces))
            return b"".join([self.seen[p] for p in pieces])

    def decode(self, ids: np.ndarray) -> str:
        if self.tool.decoder is not None:
            return self.tool.decode(ids.tolist(), skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


#: An encoded stretch of text: (open, head, ids, tail).  ``ids`` are those of the words that lie wholly inside; ``head`` and
#: ``tail`` are the cut words at its ends; ``open`` means that it has no space at all, and ``head`` is all of it.
Stretch = tuple[bool, bytes, bytes, bytes]


def stretch(text: bytes, tool: Codec) -> Stretch:
    head = b"" if text[:1].isspace() else (text.split(None, 1) or [b""])[0]
    if len(head) == len(text):
        return True, text, b"", b""
    rest = text[len(head) :]
    tail = b"" if rest[-1:].isspace() else rest.rsplit(None, 1)[-1]
    return False, head, tool.encode(rest[: len(rest) - len(tail)]), tail


class Joiner:
    """Joins stretches in order.  At each join the cut words on both sides are encoded as one; the window grows over
    stretches without a space until it ends at one on both sides, where both encodings agree whatever stands beyond."""

    def __init__(self, tool: Codec):
        self.tool, self.ids, self.cut, self.repairs = tool, [], b"", 0

    def add(self, part: Stretch) -> None:
        is_open, head, ids, tail = part
        if is_open:
            self.cut += head
            return
        self._mend(head)
        self.ids.append(ids)
        self.cut = tail

    def _mend(self, head: bytes) -> None:
        if self.cut or head:
            self.repairs += bool(self.cut and head)
            self.ids.append(self.tool.encode(self.cut + head))

    def done(self) -> np.ndarray:
        self._mend(b"")
        self.cut = b""
        return np.frombuffer(b"".join(self.ids), self.tool.dtype)


# ---- what becomes of the ids


def whole(ids: np.ndarray, tool: Codec) -> dict:
    """ids and the decoded text."""
    return {"ids": ids.astype(np.int32), "decoded": tool.decode(ids)}


def digests(ids: np.ndarray, tool: Codec) -> dict:
    """Lengths and digests instead of ids and text, where only those are asked for."""
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(tool.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()}


RESULTS = {"whole": (whole, "ids array<int>, decoded string", {"ids": pa.list_(pa.int32()), "decoded": pa.string()}), "digests": (digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})}


# ---- the operator


def _texts(batch: pa.RecordBatch):
    """(index, UTF-8 bytes) of each row; NULL is empty."""
    column = batch.column("text")
    for i in range(batch.num_rows):
        buffer = column[i].as_buffer() if column[i].is_valid else None
        yield i, buffer.to_pybytes() if buffer is not None else b""


def _shared_chunks(docs: DataFrame) -> DataFrame:
    """``(key, slot)`` of the chunks that occur in two documents or more."""

    def keys(it):
        for batch in it:
            found = [k for _, text in _texts(batch) for k in {key_of(c) for c in chunks(text)}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["key"])

    return docs.select("text").mapInArrow(keys, "key binary").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def _bitmap(shared: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap with the slots of all shared chunks, of at most MOST_BITS; slots that collide only add work, not errors."""
    n = shared.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    slot = F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(bits))
    words = shared.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("b")).toPandas()
    out = np.zeros(bits >> 5, np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return out, bits


def _in(bitmap: np.ndarray, bits: int, key: bytes) -> bool:
    slot = int.from_bytes(key[:4], "big") % bits
    return bool(int(bitmap[slot >> 5]) >> (slot & 31) & 1)


def encode(docs: DataFrame, path: str = TOKENIZER, result: str = "whole") -> DataFrame:
    """Ids of every whole text, as the tokenizers library gives them without special tokens added, and their decoding.

    ``doc_id`` and the columns of ``result``: ``whole`` (ids, decoded) or ``digests`` (n_tokens, ids_sha256,
    decoded_sha256).  ``docs`` should be a table that is read, so that tasks that run again see the same rows.

    1. Texts are cut into chunks by a rolling hash; keys of chunks are counted (only keys are shuffled).
    2. Chunks of two documents or more are encoded once each into a table.  A bitmap of bounded size tells every task which
       chunks those are; what it wrongly takes for shared goes the same way.
    3. Each document encodes its own stretches; references to shared chunks are joined with the table, and its joins
       are mended by re-encoding the cut words.  Documents without shared chunks are finished where they are read.

    * NULL or blank text: no tokens, empty decoding.
    * NULL or repeated doc_id: a row each.  Empty table: no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    finish, ddl, types = RESULTS[result]
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = saved(_shared_chunks(table), "keys")
    bitmap, bits = _bitmap(shared)
    known = spark.sparkContext.broadcast(bitmap)  # MOST_BITS at most
    part = {"open": pa.bool_(), "head": pa.binary(), "mid": pa.binary(), "tail": pa.binary()}
    part_ddl = "open boolean, head binary, mid binary, tail binary"

    def bodies(it):
        for batch in it:
            seen = {}
            for _, text in _texts(batch):
                for c in chunks(text):
                    if (k := key_of(c)) not in seen and _in(known.value, bits, k):
                        seen[k] = c
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["key", "body"])

    def encoded(it):
        tool = codec(path)
        for batch in it:
            rows = list(zip(*[stretch(b.as_py(), tool) for b in batch.column(1)])) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(rows, part.values()))], ["key", *part])

    once = table.select("text").mapInArrow(bodies, "key binary, body binary").groupBy("key").agg(F.first("body").alias("body"))
    once = saved(once.mapInArrow(encoded, f"key binary, {part_ddl}"), "chunks")

    own_types = {"doc_id": pa.int64(), "row": pa.int64(), "seq": pa.int64(), "key": pa.binary()} | part | types
    own_schema = pa.schema(list(own_types.items()))

    def read(it):
        tool = codec(path)
        for batch in it:
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            out, held = [], 0
            for i, text in _texts(batch):
                runs: list[bytes | bytearray] = []  # keys (bytes) of shared chunks, and stretches between them (bytearray)
                for c in chunks(text):
                    k = key_of(c)
                    if _in(known.value, bits, k):
                        runs.append(k)
                    elif runs and isinstance(runs[-1], bytearray):
                        runs[-1] += c
                    else:
                        runs.append(bytearray(c))
                me = {"doc_id": ids[i], "row": rows[i]}
                if not any(isinstance(r, bytes) for r in runs):
                    out.append(me | {"seq": -1} | finish(np.frombuffer(tool.encode(text), tool.dtype), tool))
                else:
                    for seq, r in enumerate(runs):
                        out.append(me | {"seq": seq} | ({"key": r} if isinstance(r, bytes) else dict(zip(part, stretch(bytes(r), tool)))))
                held += len(text)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_pylist(out, own_schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, own_schema)

    rows = table.withColumn("row", F.monotonically_increasing_id())
    cut = saved(rows.mapInArrow(read, f"doc_id long, row long, seq long, key binary, {part_ddl}, {ddl}"), "stretches")
    refs = cut.where("seq >= 0 and key is not null").select("doc_id", "row", "seq", "key").join(once, "key").drop("key")
    mine = cut.where("seq >= 0 and key is null").select("doc_id", "row", "seq", *part)
    done_schema = pa.schema([("doc_id", pa.int64()), *types.items()])

    def joined(it):
        tool, at, joiner, doc = codec(path), None, None, None
        for batch in it:
            out = []
            for doc_id, row, _, *p in zip(*[c.to_pylist() for c in batch.columns]):
                if row != at:
                    if joiner:
                        out.append({"doc_id": doc} | finish(joiner.done(), tool))
                    at, joiner, doc = row, Joiner(tool), doc_id
                joiner.add(p)
            yield pa.RecordBatch.from_pylist(out, done_schema)
        if joiner:
            yield pa.RecordBatch.from_pylist([{"doc_id": doc} | finish(joiner.done(), tool)], done_schema)

    parts = refs.select("doc_id", "row", "seq", *part).unionByName(mine)
    mended = parts.repartition("row").sortWithinPartitions("row", "seq").mapInArrow(joined, f"doc_id long, {ddl}")
    return cut.where("seq = -1").select("doc_id", *types).unionByName(mended)
