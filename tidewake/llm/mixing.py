"""Mixing sources to target weights by pivotal (dependent) rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import OWN, quoted, salted_left_join
from tidewake.scratch import saved

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents that one task folds at a time, and residuals that meet in a node of the reduction tree.
FAN_BITS = 6
#: Documents with this part of their source's words or more are rounded first, against all the rest; so many at most.
HEAD = 512
#: Tasks over which one source's documents are dealt when they meet the source table.
SALTS = 64


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, m)``: words per document; ``m`` rows share the three."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))


def targets(sized: DataFrame, total_share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: ``(source, s, n, source_size, target)``.

    Targets are min(cap x size, level x weight) with the level at which they sum to ``total_share`` of all words: the
    end state of resharing every excess by weight.  Sources are ranked by code point, NULL last.  Two windows run over
    the source table, which has one row per source.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum(F.when((F.col("size") > 0), 1).otherwise(0)).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", weight)
    room = ranked.withColumn("ratio", cap * F.col("source_size") / F.col("w"))
    all_rows, below = Window.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
    level = (total_share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap * F.col("source_size")).over(below), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    # capped sources come first by ratio; the first whose own level is below its ratio sets the level for the rest
    free = room.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    settled = free.withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct("ratio", "s"))).over(all_rows))
    return settled.select("source", "s", "n", "source_size", F.least(cap * F.col("source_size"), F.coalesce("level", F.lit(float("inf"))) * F.col("w")).alias("target"))


#: What travels with a document, but for its probability; ``lead`` (minus the mass) puts large documents first in a fold.
_FIELDS = {"lead": "double", "u": "double", "doc_id": "bigint", "source": "string", "size": "bigint", "m": "bigint", "source_size": "bigint", "target": "double", "mass": "double"}
_ITEM = f"struct<{','.join(f'{c}:{t}' for c, t in _FIELDS.items())},p:double>"

# One fold of the pivotal method.  Each document is paired with the pool of those behind it, whose probabilities move together:
# p becomes a * p + b, s0 is the pool's mass (words) and s1 what of it is expected to be taken.  The document can rise by ``up``
# at most and fall by ``down``; it rises with probability down / (up + down), so its expectation stays, and the pool gives or
# takes the same mass, in proportion to what each has.  Then the document or all of the pool is integral.
_LOOK = "transform(array(least(1D, greatest(0D, s.a * x.p + s.b))), p -> named_struct('p', p, 'r0', greatest(0D, s.s0 - x.mass), 'r1', greatest(0D, s.s1 - p * x.mass)))[0]"
_ROOM = f"transform(array({_LOOK}), v -> named_struct('p', v.p, 'r1', v.r1, 'r0', v.r0, 'up', least(1 - v.p, v.r1 / x.mass), 'down', least(v.p, greatest(0D, v.r0 - v.r1) / x.mass)))[0]"
_MOVE = f"transform(array({_ROOM}), v -> named_struct('p', v.p, 'r1', v.r1, 'r0', v.r0, 'by', CASE WHEN x.u * (v.up + v.down) < v.down THEN v.up ELSE -v.down END))[0]"
_SHRINK = f"transform(array({_MOVE}), v -> named_struct('p', v.p + v.by, 'r1', v.r1 - v.by * x.mass, 'r0', v.r0, 'falls', v.by < 0, 'f', CASE WHEN v.by > 0 THEN greatest(0D, 1 - v.by * x.mass / v.r1) WHEN v.by < 0 THEN greatest(0D, 1 + v.by * x.mass / (v.r0 - v.r1)) ELSE 1D END))[0]"
_DONE = f"named_struct({', '.join(f"'{c}', x.{c}" for c in _FIELDS)}, 'p', CASE WHEN v.p < 1e-9D THEN 0D WHEN v.p > 1 - 1e-9D THEN 1D ELSE v.p END)"
_FOLD = f"""aggregate(items, named_struct('a', 1D, 'b', 0D, 's0', s0, 's1', s1, 'done', cast(array() as array<{_ITEM}>)), (s, x) -> transform(array({_SHRINK}),
    v -> named_struct('a', v.f * s.a, 'b', v.f * s.b + CASE WHEN v.falls THEN 1 - v.f ELSE 0D END, 's0', v.r0, 's1', v.r1, 'done', array_append(s.done, {_DONE})))[0], s -> s.done)"""


def _uniform(*salt) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "source", "size", *[F.lit(x) for x in salt]), F.lit(1 << 52)) / float(1 << 52)


def copies(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``(doc_id, source, size, m, source_size, target, copies)``: how often the mix takes each document.

    A source's rate is target / size; each document gets its integer part, and the fraction is rounded by the pivotal
    method, large documents first, each paired with the pool of smaller ones.  A source's documents that hold 1 / HEAD of its
    words or more, HEAD at most, are folded in one group, with all the rest as one partner.  The rest, at the
    probability that this leaves, is folded in hashed groups of about 64, each group leaves at most one fractional residual,
    and residuals meet 64 at a time in the next level of the tree.  The last one is rounded by its own probability, so a
    source misses its target by less than one document that is among its smallest or below 1 / HEAD of it, unless a
    document outweighs all that is smaller.  All randomness is a hash of the row and ``seed``: reruns agree on any cluster.

    NULL or wordless text has size 0 and is rounded alone.  ``m`` rows that repeat doc_id, source and size share one
    decision.  NULL source is a source of its own.  Empty table: no rows.
    """
    sized = saved(sizes(docs), "sizes")
    source = saved(targets(sized), "sources")
    most = source.agg(F.max("n")).first()[0] or 1
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("named")  # NULL is a source, too
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = salted_left_join(sized.select("*", named), source.select(named, "s", "n", "source_size", "target"), ["named"], F.struct("doc_id", "size"), SALTS)
    rows = saved(rows.drop("named").withColumns({"base": F.floor(rate), "p": rate - F.floor(rate), "mass": (F.col("size") * F.col("m")).cast("double")}), "rates")
    keep = ["doc_id", "source", "size", "m", "source_size", "target"]
    split = (F.col("size") > 0) & F.col("p").between(1e-12, 1 - 1e-12)
    alone = lambda *salt: F.when(_uniform(seed, *salt) < F.col("p"), 1.0).otherwise(0.0).alias("p")
    fields = lambda *salt: F.struct("lead", _uniform(seed, *salt).alias("u"), *keep, "mass", "p")
    fractional = rows.where(split).withColumn("lead", -F.col("mass"))
    large = F.col("mass") * HEAD >= F.col("source_size")
    heads = fractional.groupBy("s").agg(F.collect_list(F.when(large, fields("head"))).alias("items"), F.coalesce(F.sum(F.when(~large, F.col("mass"))), F.lit(0.0)).alias("rest"), F.sum("mass").alias("s0"), F.sum(F.col("mass") * F.col("p")).alias("s1"), F.max("p").alias("p"))
    pool = F.expr(f"array(named_struct({', '.join(f"'{c}', cast({dict(lead='1', u='0', mass='rest').get(c, 'null')} as {t})" for c, t in _FIELDS.items())}, 'p', p))")
    heads = heads.withColumn("items", F.sort_array(F.when(F.col("rest") > 0, F.concat("items", pool)).otherwise(F.col("items"))))
    headed = saved(heads.select("s", F.expr(_FOLD).alias("f")).select("s", F.inline("f")), "heads")
    taken = rows.where(~split).select(*keep, alone("lone")).unionByName(headed.where("lead <= 0 and p in (0, 1)").select(*keep, "p"))
    lone = headed.where("lead <= 0 and p not in (0, 1)").select(*keep, alone("first"))  # nothing smaller was left to pair with
    # bits of the hash that number a source's first groups, so that about 2**FAN_BITS documents share one
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / float(1 << FAN_BITS)))).cast("int")
    tail = fractional.where(~large).drop("p").select("*", bits.alias("bits"))
    tail = salted_left_join(tail, headed.where("lead > 0").select("s", "p"), ["s"], F.struct("doc_id", "size"), SALTS)
    level, left = tail.select("s", "bits", "lead", *keep, "mass", "p"), max(0, (most - 1).bit_length() - FAN_BITS)
    for t in range(left // FAN_BITS + 2):
        group = F.expr(f"shiftright(pmod(xxhash64(doc_id, source, size, {seed}), shiftleft(1L, bits)), {t * FAN_BITS})")
        grouped = level.groupBy("s", "bits", group.alias("at")).agg(F.sort_array(F.collect_list(fields(t))).alias("items"), F.sum("mass").alias("s0"), F.sum(F.col("mass") * F.col("p")).alias("s1"))
        folded = saved(grouped.select("s", "bits", F.expr(_FOLD).alias("f")).select("s", "bits", F.inline("f")), f"level{t}")
        taken, level = taken.unionByName(folded.where("p in (0, 1)").select(*keep, "p")), folded.where("p not in (0, 1)").drop("u")
        if t * FAN_BITS >= left:
            break
    taken = taken.unionByName(lone).unionByName(level.select(*keep, alone("last")))
    return taken.select(*keep, (F.floor(rate) + F.col("p")).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0 to 2 times); all columns stay."""
    took = copies(docs, seed).where("copies > 0").select(F.col("doc_id").alias(OWN + "id"), F.col("source").alias(OWN + "source"), F.col("size").alias(OWN + "size"), F.col("copies").alias(OWN + "copies"))
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(OWN + "id")) & docs["source"].eqNullSafe(F.col(OWN + "source")) & (words == F.col(OWN + "size"))
    return docs.join(took, same).withColumn(OWN + "copy", F.explode(F.expr(f"sequence(1L, {OWN}copies)"))).select(*[docs[quoted(c)] for c in docs.columns])
