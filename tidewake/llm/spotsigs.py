"""SpotSigs fingerprints: chains of content words after common-word anchors, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import OWN
from tidewake.scratch import saved

# Common words of English, German, French and Spanish that anchor a chain.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you "
    "auch auf aus bei das dem den der des die ein eine einer es für hat ich im ist mit nach nicht sich sie sind und von war wie zu zum "
    "au aux ce ces dans du elle en est et il la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une "
    "al como con del el ella esta este fue ha las lo los más no para pero por sin su sus una y ya"
).split()
#: Names of the integer range that one window orders, when documents are linked to their successors.
SPAN = 4096


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text as array<bigint>.

    Words are runs of letters and digits, lower-cased.  Each run of anchors followed by two content words (anchors
    between them are passed over) gives one signature, a 64-bit hash of the three.  In a text without any, every word is an
    anchor: it has a signature for each three words in a row, so that its near copies are still like it; one of under
    three words has one of all its words.
    """
    # Spark evaluates whatever stands inside of lambdas as often as it is named: what is used again is bound first
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return _let(words, lambda w: _let(_spotted(w), lambda x: F.when(F.size(x) > 0, x).otherwise(_let(F.filter(w, lambda y: y != ""), _threes))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _spotted(words: Column) -> Column:
    """Signatures behind anchors."""
    # "on the cat sat " -> "on the cat", "sat": each content word behind the anchors before it
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(ANCHORS), F.concat(w, F.lit(" "))).otherwise(F.concat(w, F.lit("|")))), "")

    def chained(spots: Column) -> Column:
        later = F.slice(F.transform(spots, lambda s: F.substring_index(s, " ", -1)), F.lit(2), F.size(spots))
        chain = F.zip_with(spots, later, lambda s, c: F.when((F.instr(s, " ") > 0) & (F.substring_index(s, " ", -1) != "") & (c != ""), F.xxhash64(s, c)))
        return F.sort_array(F.array_distinct(F.filter(chain, lambda x: x.isNotNull())))

    return _let(F.split(marked, r"\|"), chained)


def _threes(own: Column) -> Column:
    """Signatures of a text without any anchors' chain."""
    threes = F.transform(F.sequence(F.lit(1), F.size(own) - 2), lambda i: F.xxhash64(F.get(own, i - 1), F.get(own, i), F.get(own, i + 1)))
    return F.when(F.size(own) < 3, F.array(F.xxhash64(F.array_join(own, " ")))).otherwise(F.sort_array(F.array_distinct(threes)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets, 0 to 1."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, F.lit(1.0)).when(F.arrays_overlap(a, b), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def within_length(an: Column, bn: Column, threshold: float) -> Column:
    """Whether sets of these sizes can be as like as ``threshold`` at all: no Jaccard is above the shorter by the longer."""
    return F.least(an, bn) >= F.greatest(an, bn) * threshold - 1e-9


def as_text(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), ",")


def _next_lower(ids: DataFrame) -> DataFrame:
    """``ids(k)``, distinct longs → ``(k, next)``, the largest k below (NULL for the least).

    Windows run over ranges of SPAN consecutive numbers, so at most SPAN rows each; the ends of ranges are linked by the
    same step on range numbers, until one range is left.
    """
    low, high = ids.agg(F.min("k"), F.max("k")).first()
    if low is None or high - low < SPAN:  # ranges of numbers around 0 would stay two for ever
        return ids.select("k", F.lead("k").over(Window.partitionBy(F.lit(0)).orderBy(F.col("k").desc())).alias("next"))
    ranged = ids.withColumn("r", F.floor(F.col("k") / F.lit(float(SPAN))) if max(abs(low), abs(high)) < 1 << 52 else F.shiftright("k", int(math.log2(SPAN))))
    within = ranged.select("k", "r", F.lead("k").over(Window.partitionBy("r").orderBy(F.col("k").desc())).alias("next"))
    heads = saved(ranged.groupBy("r").agg(F.max("k").alias("head")), "heads")
    below = _next_lower(heads.select(F.col("r").alias("k"))).withColumnRenamed("k", "r")
    after = below.join(heads.select(F.col("r").alias("next"), "head"), "next").select("r", "head")
    return within.join(after, "r", "left").select("k", F.coalesce("next", "head").alias("next"))


def _unused(ids: DataFrame) -> int:
    """A number that is no doc_id, to stand for NULL where rows meet: below all, or above all, or the first gap."""
    low, high = ids.agg(F.min("k"), F.max("k")).first()
    if low is None or low > -(1 << 63):
        return (low or 0) - 1
    if high < (1 << 63) - 1:
        return high + 1
    return ids.where(F.col("k") < high).select((F.col("k") + 1).alias("k")).join(ids.where("k is not null"), "k", "left_anti").agg(F.min("k")).first()[0]


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.  The edited text has
    its last floor(n_chars/3) code points replaced by the first as many (or all) of the next document's, in descending
    doc_id order, the first after the last.

    * NULL text is empty.  A table of one document is its own next.
    * NULL doc_id comes after all others; the rows without one are taken as one document.
    * Rows that repeat a doc_id each give a row; the next document is then the row whose text sorts last.
    * Empty table: no rows.  Other columns are ignored.  Very long texts are fingerprinted whole.

    Only doc_ids are ordered.  Texts move once, to their doc_id's task; what a document gives to the one before it is
    its signatures and the third that is pasted.
    """
    key, nothing = OWN + "key", _unused(docs.select(F.col("doc_id").cast("long").alias("k")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(nothing)))
    ids = saved(rows.groupBy("k").agg(F.count("*").alias("n"), F.max(F.floor(F.char_length("text") / F.lit(3))).alias("need")), "ids")
    real = ids.where(F.col("k") != nothing).select("k")
    order = _next_lower(real)
    low, high, gaps, repeats = ids.agg(F.min(F.when(F.col("k") != nothing, F.col("k"))), F.max(F.when(F.col("k") != nothing, F.col("k"))), F.max(F.col("k") == nothing), F.max("n")).first()
    first, last = (nothing if high is None else high), (nothing if gaps else low)
    links = order.select("k", F.coalesce("next", F.lit(last if gaps else first)).alias("next"))
    if gaps:
        links = links.unionByName(links.sparkSession.createDataFrame([(nothing, first)], "k long, next long"))
    wants = saved(links.join(ids.select("k", "need"), "k").select(F.col("next").alias("k"), F.col("k").alias(key), "need"), "wants")
    # own rows and givers need the same three columns, so that Spark moves them once and reads them twice
    at = rows.select("k", "text", signatures(F.col("text")).alias("sigs")).repartition("k")
    givers = at if (repeats or 1) == 1 else at.groupBy("k").agg(F.max(F.struct("text", "sigs")).alias("t")).select("k", "t.*")
    given = givers.join(wants, "k").select(F.col(key).alias("k"), F.expr("left(text, need)").alias("head"), F.col("sigs").alias("next_sigs"))
    n = F.char_length("text")
    third = F.floor(n / F.lit(3)).cast("int")
    both = at.join(given, "k").withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("head"), F.lit(1), third))})
    done = both.select(F.when(F.col("k") != nothing, F.col("k")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sigs", "next_sigs", signatures(F.col("edited")).alias("edited_sigs"))
    return done.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs ``(a, b, jaccard)`` of distinct signature sets at ``threshold`` or more, and ``(doc_id, class_id)``.

    ``class_id`` is the smallest doc_id with that very signature set, so copies are never expanded to pairs.  Sets are
    partitioned by length such that similar ones are in the same or the next partition, and within that only sets that
    share one of their rarest signatures meet (a set of n has n - ceil(threshold * n) + 1 of those); then Jaccard decides.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    rows = saved(rows.withColumn("fp", F.sha2(as_text(F.col("sigs")), 256)), "signatures")
    sets = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("sigs").alias("sigs")), "sets")
    members = rows.join(sets.select("fp", F.col("id").alias("class_id")), "fp").select("doc_id", "class_id")
    one = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = one.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    ranks = one.join(rarity, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "sig")))
    # signatures that no other set has come first in rarity, and need not meet anything
    lone = one.groupBy("id").agg(F.count("*").alias("all")).join(one.join(rarity, "sig", "left_semi").groupBy("id").agg(F.count("*").alias("shared")), "id").select("id", (F.col("all") - F.col("shared")).alias("lone"))
    cut = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    heads = ranks.join(lone, "id").where(F.col("rank") + F.col("lone") <= cut).select("id", "n", "sig", part.alias("part"))
    left = heads.select(F.col("id").alias("a"), F.col("n").alias("an"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = heads.select(F.col("id").alias("b"), F.col("n").alias("bn"), "sig", "part")
    near = within_length(F.col("an"), F.col("bn"), threshold) & ((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b"))))
    met = left.join(right, ["sig", "part"]).where(near).select("a", "b").distinct()
    full = met.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("y")), "b")
    pairs = full.withColumn("jaccard", likeness(F.col("x"), F.col("y"))).where(F.col("jaccard") >= threshold)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard"), members
