"""SimHash near-duplicates: fingerprints, a segment-popcount grid join, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tidewake.llm.common import OWN, mapped, quoted
from tidewake.scratch import saved
from tidewake.operators.components import components

#: A fingerprint is cut into so many segments of 4 bits.  A segment's popcount (0..4) takes 3 bits of the cell number.
SEGMENTS = 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles (repeats count): a bit is 1 if it is set in more than half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of each row's whole text as a long; NULL text counts as empty (fingerprint 0)."""

    def batches(it):
        for batch in it:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, "doc_id long, fp long")


def close_pairs(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct longs in column ``fp`` that differ in at most ``max_bits`` (0 to 2) bits.

    Each fingerprint is a point of popcounts, one per segment; Manhattan distance between points never exceeds the
    Hamming distance.  On the integer grid two points at distance 2 or less share a cell within distance 1 of both, so
    each fingerprint enters its own cell and the 2 x 16 next to it, equal cells meet, and xor-popcount decides exactly.
    Both sides are always shuffled: Spark sizes them as before the explode, 33 times too low, and would broadcast one.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid finds pairs at 2 bits or fewer")
    cell = sum(((F.bit_count(F.shiftrightunsigned("fp", 4 * k).bitwiseAND(F.lit(15))) + 1).cast("long") * (1 << (3 * k)) for k in range(SEGMENTS)), F.lit(0).cast("long"))
    steps = F.array(*[F.lit(d).cast("long") for d in [0, *(s << (3 * k) for k in range(SEGMENTS) for s in (1, -1))]])
    at = fps.select("fp", cell.alias("own")).select("fp", "own", F.explode(steps).alias("step")).select("fp", "own", (F.col("own") + F.col("step")).alias("cell"))
    a, b = at.alias("a"), at.alias("b")
    meet = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
    once = (F.col("a.own") != F.col("b.own")) | (F.col("a.cell") == F.col("a.own"))  # equal points share 33 cells
    return a.join(b.hint("merge"), meet & once).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def _by_fingerprint(known: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, least, class, component_id)`` of ``known(doc_id, fp)``: least doc_id of each fingerprint; a number of all
    fingerprints that it reaches, and the least doc_id of those."""
    distinct = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = saved(close_pairs(distinct, max_bits), "pairs")
    classes = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    fp_class = distinct.join(classes, distinct.fp == classes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    lowest = fp_class.groupBy("class").agg(F.min("least").alias("class_least"))
    return saved(fp_class.join(lowest, "class").select("fp", "least", "class", F.col("class_least").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row: links at ``max_bits`` or fewer differing bits, closed transitively.

    * NULL text is empty text; empty texts have fingerprint zero and link like any other.
    * NULL doc_id: the row gets its fingerprint, links with nothing, and its component_id is NULL.
    * Rows that repeat a doc_id each give a row; their links are all links of that doc_id.
    * Empty table: no rows.  Other columns are ignored.  Very long texts are hashed whole, 65,536 shingles at a time.

    Equal fingerprints collapse first (partial aggregation), so the grid join and the component rounds see distinct
    fingerprints only, however large a group of copies is.
    """
    rows = saved(fingerprints(docs, key, text), "fingerprints")
    known = rows.where(F.col("doc_id").isNotNull())
    spread = known.join(_by_fingerprint(known, max_bits).select("fp", "component_id"), "fp")
    # an id that has several fingerprints (repeated rows) joins their classes
    repeats = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1 and lo <> hi").select("doc_id")
    if not repeats.isEmpty():
        edges = spread.join(repeats, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
        merged = components(edges)
        spread = spread.join(merged, spread.component_id == merged.node, "left").select("doc_id", "fp", F.coalesce("component", "component_id").alias("component_id"))
    alone = rows.where(F.col("doc_id").isNull()).select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return spread.select("doc_id", "fp", "component_id").unionByName(alone).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each row's text as a further column."""
    at = docs.columns.index("text")

    def batches(it):
        for batch in it:
            fps = np.array([fingerprint(x) for x in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, name])

    return mapped(docs, batches, [StructField(name, LongType())])


def keep_first(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicate texts, that with the smallest doc_id; all columns stay.

    * Groups are of texts: rows that repeat a doc_id with texts that are no near-duplicates each stay in their own group.
    * Of rows that tie in doc_id the smallest fingerprint stays, of those the first by the JSON text of all columns.
    * Rows without a doc_id stay.  Empty table: no rows.

    The text table is matched by semi joins on doc_id, which Spark broadcasts only if the ids turn out small; only texts of
    repeated doc_ids are fingerprinted again, and the choice among them is an aggregation with partial minima.
    """
    known = saved(fingerprints(docs), "fingerprints").where(F.col("doc_id").isNotNull())
    mark, fp, id_ = OWN + "keep", OWN + "fp", OWN + "id"
    groups = _by_fingerprint(known, max_bits)
    first = groups.groupBy("class").agg(F.min(F.struct("least", "fp")).alias("w")).select(F.col("w.least").alias(mark), F.col("w.fp").alias(fp))
    repeats = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(id_))
    numbered, same = docs.where(F.col("doc_id").isNotNull()), docs.doc_id.cast("long")
    out = numbered.join(first.join(repeats, F.col(mark) == F.col(id_), "left_anti"), same == F.col(mark), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    if repeats.isEmpty():
        return out
    twice = _with_fingerprint(numbered.join(repeats, same == F.col(id_), "left_semi"), fp).withColumn(mark, F.col("doc_id").cast("long"))
    whole = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    chosen = twice.join(first, [mark, fp], "left_semi").groupBy(mark, fp).agg(F.min_by(whole, F.to_json(whole)).alias(OWN + "row"))
    return out.unionByName(chosen.select(*[F.col(f"{OWN}row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
