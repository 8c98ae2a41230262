"""Periodic runs of words: all maximal stretches with four periods or more, by string synchronising sets."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many periods, and this many words, at least.
TIMES, LEAST = 4, 6
#: The smallest scale of synchronising sets; smaller periods are looked for directly.
SCALE = 8
#: Words that are searched at a time; a longer document is searched alone.
STEP = 1 << 18

Found = list[tuple[int, int, int]]  # (begin, end, period)

# ---- runs of a sequence of numbers


def _stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches where ``on`` is set."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _fits(begin: int, end: int, period: int) -> bool:
    return end - begin >= max(LEAST, TIMES * period)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice the width from those of ``width`` words at each position."""
    out = h[:-width] * _A + (h[width:] ^ (h[width:] >> np.uint64(31))) * _B
    return out ^ (out >> np.uint64(29))


def synchronising(h: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Positions whose hash, or that ``scale`` further on, is least of the ``scale`` + 1 between them.

    ``h`` are hashes of ``scale`` words from each position, so membership depends on the next 2 x scale words only, wherever they
    stand.  ``periodic`` positions don't take part.
    """
    kept = np.where(periodic, np.uint64(2**64 - 1), h)
    least = _window_min(kept, scale + 1)
    n = len(least)
    return np.flatnonzero(((kept[:n] == least) & ~periodic[:n]) | ((kept[scale : scale + n] == least) & ~periodic[scale : scale + n]))


def _common(ids: np.ndarray, at: int, period: int, way: int) -> int:
    """How far from ``at`` the words go on being those ``period`` before (way 1) or after (way -1); stretches double."""
    far, width = 0, 16
    while True:
        if way > 0:
            a, b = ids[at + far : at + far + width], ids[at + far - period : at + far - period + width]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
        else:
            k = min(width, at - far)
            differ = np.flatnonzero((ids[at - far - k : at - far] != ids[at - far - k + period : at - far + period])[::-1])
        if len(differ):
            return far + int(differ[0])
        far += k
        if k < width:
            return far
        width *= 2


def find_runs(ids: np.ndarray, longest: int | None = None) -> Found:
    """All runs of ``ids``, as (begin, end, smallest period), by begin and period.  ``longest`` bounds a run's length, if known.

    Periods under SCALE: neighbours at that distance are compared everywhere.  Periods from s to 2 s, for each s = SCALE, 2 SCALE, ..:
    the synchronising set of scale s, without positions whose next s words lie in a run of period s / 4 or less, which are known by then.  In a
    run of period q, s <= q <= 2 s, any s positions hold a member, since 2 s positions in a row without one that takes part would have a
    period of s / 4 over 3 s words, and then the run had it, too.  A member in the first s words is a member again q words on, with equal
    2 s words behind it, and not before, as 2 s >= q words differ from their rotations.  So neighbouring members with equal contexts propose
    every such period; each proposal is compared word by word and extended both ways, so nothing but runs is found.
    """
    n = len(ids)
    longest = min(n, longest or n)
    found: set[tuple[int, int, int]] = set()
    spans: set[tuple[int, int]] = set()

    def add(b: int, e: int, q: int) -> None:
        if (b, e) not in spans:  # else it has a smaller period
            spans.add((b, e))
            found.add((b, e, q))

    for q in range(1, min(SCALE, longest // TIMES + 1)):
        begins, ends = _stretches(ids[:-q] == ids[q:])
        long = ends - begins >= max(LEAST, TIMES * q) - q
        for b, e in zip(begins[long].tolist(), ends[long].tolist()):
            add(b, e + q, q)
    scale, h = 1, ids.astype(np.uint64) * _B + _A
    h ^= h >> np.uint64(32)
    while TIMES * scale <= longest:
        if scale >= SCALE:
            step = np.zeros(n + 1, np.int32)
            for b, e, q in found:
                if TIMES * q <= scale <= e - b:
                    step[b] += 1
                    step[e - scale + 1] -= 1
            periodic = np.cumsum(step[: len(h)]) > 0
            members = synchronising(h, scale, periodic)
            context = _doubled(h, scale)
            members = members[members < len(context)]
            order = np.lexsort((members, context[members]))
            at, of = members[order], context[members][order]
            near = np.flatnonzero((of[1:] == of[:-1]) & (at[1:] - at[:-1] >= scale) & (at[1:] - at[:-1] <= 2 * scale))
            proposals = defaultdict(list)
            for s, d in sorted(zip(at[near].tolist(), (at[near + 1] - at[near]).tolist())):
                proposals[d].append(s)
            for d, starts in proposals.items():
                done = -1
                for s in starts:
                    if s + d < done or not np.array_equal(ids[s : s + 2 * scale], ids[s + d : s + d + 2 * scale]):
                        continue  # in a stretch that was extended already
                    b = s - _common(ids, s, d, -1)
                    done = e = s + d + _common(ids, s + d, d, 1)
                    if _fits(b, e, d):
                        add(b, e, d)
        h = _doubled(h, scale)
        scale *= 2
    return sorted(found)


# ---- runs of texts


def _words(text: bytes) -> list[bytes]:
    return text.split()  # of bytes: at 0x20 and 0x09-0x0D


def runs_of(texts: list[list[bytes]]) -> list[Found]:
    """Runs of each of the texts, given as words; they are searched as one sequence with a number of its own between any two."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    parts, begins, at = [], [], 0
    for k, words in enumerate(texts):
        begins.append(at)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([-1 - k], np.int64))
        at += len(words) + 1
    out: list[Found] = [[] for _ in texts]
    if not texts:
        return out
    for b, e, q in find_runs(np.concatenate(parts), max(map(len, texts))):
        k = int(np.searchsorted(begins, b, "right")) - 1
        out[k].append((b - begins[k], e - begins[k], q))
    return out


def best_of(found: Found) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones that with the smallest begin, then period."""
    if not found:
        return None
    top = max((e - b) / q for b, e, q in found)
    close = [r for r in found if (r[1] - r[0]) / r[2] >= top * (1 - 1e-12)]
    return min(close, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))


def collapsed_words(words: list[bytes], found: Found) -> list[bytes]:
    """The words without those that some run contains after its first period."""
    if not found:
        return words
    step = np.zeros(len(words) + 1, np.int32)
    for b, e, q in found:
        step[b + q] += 1
        step[e] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, best, collapsed)`` of every document: all its runs as an array of (start, length, period), by start and
    period; that with most repetitions (NULL without runs); and the text's words without repetitions, joined by one space.

    A run is a stretch of words with smallest period q, of 4 q words and 6 at least, that no neighbouring word extends keeping q.  No
    shuffle; texts are searched some 260,000 words at a time, a longer one alone, in n log n steps, so a task needs memory
    in proportion to one text.

    * NULL, empty or blank text: no words, no runs, empty ``collapsed``.  NULL or repeated doc_id: a row each.
    * Empty table: no rows.  Other columns are ignored.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("best", run), ("collapsed", pa.string())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, lot, held = batch.column(0).to_pylist(), batch.column(1), [], 0
            for i in range(batch.num_rows):
                lot.append((ids[i], _words(column[i].as_buffer().to_pybytes() if column[i].is_valid else b"")))
                held += len(lot[-1][1])
                if held > STEP:
                    yield told(lot)
                    lot, held = [], 0
            yield told(lot)

    def told(lot: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        as_run = lambda r: {"start": r[0], "length": r[1] - r[0], "period": r[2]}
        rows = []
        for (doc_id, words), found in zip(lot, runs_of([w for _, w in lot])):
            best = best_of(found)
            rows.append({"doc_id": doc_id, "n_words": len(words), "runs": [as_run(r) for r in found], "best": as_run(best) if best else None, "collapsed": b" ".join(collapsed_words(words, found)).decode("utf-8", "surrogatepass")})
        return pa.RecordBatch.from_pylist(rows, schema)

    kind = "struct<start:long,length:long,period:long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, f"doc_id long, n_words long, runs array<{kind}>, best {kind}, collapsed string")


# ---- the query's planted periods and digests


def with_planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic end in one document in ten, by crc32 of its id: from word a on, words repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    a = lambda w: F.pmod(g, F.size(w).cast("long"))
    period = lambda w, at: 1 + F.floor((F.size(w) - at) / (3 + g % 8))
    told = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), a(w).alias("a"), period(w, a(w)).alias("p")))[0]
    again = F.transform(F.array(told), lambda t: F.array_join(F.transform(t["w"], lambda _, i: F.when(i < t["a"], t["w"][i]).otherwise(F.get(t["w"], (t["a"] + (i - t["a"]) % t["p"]).cast("int")))), " "))[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0), again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query: lengths and digests instead of lists and texts."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = {k: F.col(f"best.{k}") for k in ("start", "length", "period")}
    milli = F.expr("best.length * 1000 div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[v.alias(k) for k, v in best.items()], milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
