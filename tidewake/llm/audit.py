"""How corpus filters interact: word and character counts by a byte transducer, failures, and every order of the filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.scratch import saved

# ---- the transducer

#: What a byte is: white space, a capital, a symbol, any other byte that begins a character, or one that goes on with it.
SPACE, CAPITAL, SYMBOL, OTHER, GOES_ON = range(5)
#: What a step puts out.
BEGINS, ENDS, IS_CAPITAL, IS_SYMBOL, IS_CHARACTER = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[0x80:0xC0] = GOES_ON
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[0x41:0x5B] = CAPITAL
    out[list(SYMBOLS)] = SYMBOL
    return out


#: Class of each byte, and what comes out for (state, class); states are: outside of a word, inside.
CLASS = _classes()
OUT = np.array([[0, BEGINS | IS_CAPITAL, BEGINS | IS_SYMBOL, BEGINS, BEGINS], [ENDS, IS_CAPITAL, IS_SYMBOL, 0, 0]], np.uint8)
OUT[:, :GOES_ON] |= IS_CHARACTER


def transduced(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """What each byte of concatenated texts puts out; ``begins`` are the positions where one begins, or goes on behind white space.

    The state is whether the byte before was in a word, so that byte's class gives it.
    """
    kind = CLASS[data]
    state = np.empty(len(data), np.uint8)
    state[1:] = kind[:-1] != SPACE
    state[begins] = 0
    return OUT[state, kind]


# ---- the hash table

#: Multipliers of the hash; words of up to LONG bytes are hashed and compared 8 bytes at a time, longer ones on their own.
_ODD, _MIX, LONG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Spans:
    """A hash table of spans of ``data`` by open addressing; a span is found only if text and bytes agree, not by hash alone.

    ``data`` must have 8 spare bytes behind it.  Spans are inserted many at a time: those that meet in a slot are
    compared with whom it holds, and those that differ go on to the next slot.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.eights = np.ndarray(max(0, len(data) - 7), "<u8", data, 0, (1,))
        self._reset(1 << 10)

    def _reset(self, size: int) -> None:
        self.slots = np.full(size, -1, np.int64)
        self.text, self.at, self.n, self.hash = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))

    def forget(self) -> None:
        self._reset(len(self.slots))

    def _chunk(self, at: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
        return self.eights[at + 8 * k] & _MASK[np.minimum(n - 8 * k, 8)]

    def _hashed(self, text: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = (text.astype(np.uint64) * _MIX) ^ n.astype(np.uint64)
        on, k = np.flatnonzero(n <= LONG), 0
        while len(on):
            h[on] = (h[on] ^ self._chunk(at[on], n[on], k)) * _ODD
            h[on] ^= h[on] >> np.uint64(29)
            k += 1
            on = on[n[on] > 8 * k]
        for i in np.flatnonzero(n > LONG).tolist():
            h[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(self.data[at[i] : at[i] + n[i]], digest_size=8).digest(), "little"))
        return h * _ODD

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans numbered ``a`` and ``b`` are equal, by their bytes."""
        same = (self.text[a] == self.text[b]) & (self.n[a] == self.n[b]) & (self.hash[a] == self.hash[b])
        on, k = np.flatnonzero(same & (self.n[a] <= LONG)), 0
        while len(on):
            equal = self._chunk(self.at[a[on]], self.n[a[on]], k) == self._chunk(self.at[b[on]], self.n[b[on]], k)
            same[on[~equal]] = False
            k += 1
            on = on[equal]
            on = on[self.n[a[on]] > 8 * k]
        for i in np.flatnonzero(same & (self.n[a] > LONG)).tolist():
            p, q, n = self.at[a[i]], self.at[b[i]], self.n[a[i]]
            same[i] = np.array_equal(self.data[p : p + n], self.data[q : q + n])
        return same

    def insert(self, text: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each span, whether it is the first of its text with these bytes (one of those inserted now counts as first)."""
        old = len(self.at)
        self.text, self.at, self.n = np.append(self.text, text), np.append(self.at, at), np.append(self.n, n)
        self.hash = np.append(self.hash, self._hashed(text, at, n))
        if 2 * len(self.at) > len(self.slots):  # what is held goes into larger slots
            self.slots = np.full(1 << (3 * len(self.at)).bit_length(), -1, np.int64)
            self._probe(np.arange(old))
        new = self._probe(np.arange(old, len(self.at)))
        keep = np.append(np.arange(old), old + np.flatnonzero(new))  # spans that were there already go
        number = np.full(len(self.at), -1, np.int64)
        number[keep] = np.arange(len(keep))
        held = self.slots >= 0
        self.slots[held] = number[self.slots[held]]
        self.text, self.at, self.n, self.hash = (x[keep] for x in (self.text, self.at, self.n, self.hash))
        return new

    def _probe(self, items: np.ndarray) -> np.ndarray:
        new, size = np.zeros(len(items), bool), np.uint64(len(self.slots) - 1)
        left, slot = np.arange(len(items)), ((self.hash[items] >> np.uint64(20)) & size).astype(np.int64)
        while len(left):
            mine = items[left]
            free = self.slots[slot] < 0
            self.slots[slot[free]] = mine[free]  # where several come to one slot, one of them stays
            holder = self.slots[slot]
            won = holder == mine
            new[left[won]] = True
            on = ~won
            on[on] = ~self._same(mine[on], holder[on])
            left, slot = left[on], (slot[on] + 1) & np.int64(size)
        return new


# ---- counts of documents

#: Bytes that one step works on; a document that is longer goes on in the next with its table.
STEP = 1 << 20
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_characters", "n_symbols")


def _cuts(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about STEP bytes that end where a text ends or after white space."""
    at, n = 0, int(ends[-1]) if len(ends) else 0
    while at < n:
        to = min(at + STEP, n)
        if to < n:
            last = int(ends[np.searchsorted(ends, to, "right") - 1]) if ends[0] <= to else 0
            if last > at:
                to = last
            else:  # inside of one text
                end = int(ends[np.searchsorted(ends, at, "right")])
                while to < end and CLASS[data[to - 1]] != SPACE:
                    to += 1
        yield at, to
        at = to


def counted(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each of the texts that end at ``ends`` of ``data``, which has 8 spare bytes behind the last."""
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    out = {k: np.zeros(len(ends), np.int64) for k in COUNTS}
    table, owner = Spans(data), -1
    for a, b in _cuts(data, ends):
        mine = np.flatnonzero(np.minimum(ends, b) > np.maximum(starts, a))
        lo = np.maximum(starts[mine], a) - a
        put = transduced(data[a:b], lo)
        each = lambda bit: np.add.reduceat((put & bit) != 0, lo, dtype=np.int64)
        n = each(BEGINS)
        for name, found in (("n_words", n), ("n_capitals", each(IS_CAPITAL)), ("n_characters", each(IS_CHARACTER)), ("n_symbols", each(IS_SYMBOL))):
            out[name][mine] += found
        at, text = np.flatnonzero(put & BEGINS), np.repeat(mine, n)
        stops = np.append(np.flatnonzero(put & ENDS), b - a)
        to = np.minimum(stops[np.searchsorted(stops, at, "right")], ends[text] - a)  # the next white space, or the text's end
        if owner != mine[0]:
            table.forget()
        new = table.insert(text, at + a, to - at)
        out["n_distinct"] += np.bincount(text[new], minlength=len(ends))
        owner = mine[-1]
    return out


# ---- the operator

#: Filters, in order of their bits in ``fails``.
FILTERS = "ABCDE"
REPEATED = FILTERS.index("E")


def judged(docs: DataFrame, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3) -> DataFrame:
    """``(doc_id, part, n_words, n_distinct, n_capitals, n_characters, n_symbols, digest, fails)`` of every document.

    ``part`` is lang, empty if NULL; ``digest`` is the text's SHA-256; ``fails`` has a bit for each of the filters A (under ``least_words``
    words), B (distinct words under ``least_distinct`` per cent), C (capitals over ``most_capitals`` per cent of characters) and D (a symbol).
    E, a repeated text, needs the whole table and is left to :func:`interactions`.

    No shuffle.  A batch's texts are worked on about STEP bytes at a time, and a longer text goes on with its own hash table.
    NULL text is empty; empty text has no words, fails A only, and equals other empty texts.
    """
    kinds = {"doc_id": pa.int64(), "part": pa.string()} | {k: pa.int64() for k in COUNTS} | {"digest": pa.binary()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.large_string()).fill_null("")
            _, at, raw = text.buffers()
            at = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            data = np.zeros(int(at[-1] - at[0]) + 8, np.uint8)
            if len(data) > 8:
                data[:-8] = np.frombuffer(raw, np.uint8)[at[0] : at[-1]]
            ends = (at[1:] - at[0]).astype(np.int64)
            got = counted(data, ends)
            digest = [hashlib.sha256(data[a:b]).digest() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[k]) for k in COUNTS), pa.array(digest, pa.binary())], list(kinds))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(count, "doc_id long, part string, " + ", ".join(f"{k} long" for k in COUNTS) + ", digest binary")
    c = F.col
    failed = (c("n_words") < least_words, 100 * c("n_distinct") < least_distinct * c("n_words"), 100 * c("n_capitals") > most_capitals * c("n_characters"), c("n_symbols") > 0)
    return rows.withColumn("fails", sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)))


def _cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, fails, good, toxic, n)``: documents by what they fail, E with the others; a few dozen rows a part."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    numbered = rows.where("doc_id is not null").groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    marked = numbered.join(known, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    # of copies only the smallest doc_id passes E; copies meet as counts, and per text and part a handful of rows are left
    copies = marked.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("fails"), passing.alias("n")), F.struct(F.col("fails").bitwiseOR(F.lit(1 << REPEATED)).alias("fails"), (F.col("n") - passing).alias("n")))
    told = copies.withColumn("least", least).select("part", "good", "toxic", F.inline(split))
    nameless = rows.where("doc_id is null").groupBy("part", "fails").agg(F.count("*").alias("n")).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return told.unionByName(nameless).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n")).where("n > 0")


def _steps(filters: str) -> Column:
    """An array of (filter_order, step, own, earlier) for all orders of the filters; the last two are bits."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    each = [f"struct('{''.join(o)}', {k + 1}, {bit[f]}, {sum(bit[x] for x in o[:k])})" for o in permutations(filters) for k, f in enumerate(o)]
    return F.expr(f"cast(array({', '.join(each)}) as array<struct<filter_order:string,step:int,own:int,earlier:int>>)")


def interactions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of all 120 orders: ``(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley)``, for every part of :func:`judged` rows.

    ``labels`` has doc_id, quality, toxic; of repeated rows any 1 counts.  Documents shrink to counts by (part, failures, labels) before
    orders multiply them, so the work of the orders doesn't grow with the table.

    * A document without doc_id has no label, and neither fails E nor makes others fail it.  Rows with the same doc_id and text don't
      make each other fail E.
    * A part without failures has its rows, with zeros.  Empty table: no rows.
    """
    c, whole = F.col, math.factorial(len(FILTERS))
    every = _cells(saved(rows, "judged"), labels).select("part", "fails", "good", "toxic", "n", F.inline(_steps(FILTERS)))
    own, earlier = c("fails").bitwiseAND(c("own")) != 0, c("fails").bitwiseAND(c("earlier")) != 0
    n = lambda when: F.sum(F.when(when, c("n")).otherwise(0)).cast("long")
    share = F.when(own, c("n") * F.floor(whole / F.bit_count("fails"))).otherwise(0)
    return every.groupBy("part", "filter_order", "step").agg(n(~own & ~earlier).alias("kept"), n(own & ~earlier).alias("removed"), n(own & earlier).alias("redundant"), n(c("fails") == c("own")).alias("unique_fails"), n(own & ~earlier & c("good")).alias("good_lost"), n(own & ~earlier & c("toxic")).alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))


ORACLE = """WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, min(doc_id) OVER (PARTITION BY t) least FROM d),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) fails FROM w LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, good, toxic, fails, count(*) n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) own, substr(filter_order, 1, step - 1) earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) step)),
r AS (SELECT c.*, s.*, contains(fails, own) hit, length(translate(fails, earlier, '')) < length(fails) gone FROM c, s),
p AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT unique_fails, sum(CASE WHEN hit AND NOT gone AND good = 1 THEN n ELSE 0 END)::BIGINT good_lost,
    sum(CASE WHEN hit AND NOT gone AND toxic = 1 THEN n ELSE 0 END)::BIGINT toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT shapley FROM p"""
