"""Evidence search: keywords, BM25, cosine, and their fusion.  Limits are the feature (top k)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.scratch import saved

#: Bytes of query vectors that are broadcast at a time.
QUERY_BYTES = 64_000_000
#: Bytes of scores that a task holds of a block of queries, and vectors that it scores at a time.
SCORE_BYTES, SLICE = 64_000_000, 1024


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ask(evidence: DataFrame, question: str, fallback: int = 2) -> DataFrame:
    """Rows of ``evidence(id, title, excerpt)`` that have a word of the question longer than three letters; else the first rows by id."""
    terms = sorted({w for w in question.lower().split() if len(w) > 3})
    words = F.split(F.lower(F.concat_ws(" ", "title", "excerpt")), r"\s+")
    hits = evidence.where(F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False))
    return hits if not hits.isEmpty() else evidence.orderBy("id").limit(fallback)


def bm25(docs: DataFrame, query: list[str], k: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(id, score)`` of ``docs(id, text)`` by BM25; the k best, ties by id.  Only query words are exploded.

    Scores have nine decimals, so that equal texts tie in whatever order their words are added.  Texts are split once: what is
    kept of one are its length and the query's words in it.
    """
    terms = F.array(*[F.lit(t) for t in query])
    rows = docs.select("id", tokens(F.col("text")).alias("w")).select("id", F.size("w").alias("n"), F.filter("w", lambda x: F.array_contains(terms, x)).alias("hit"))
    rows = saved(rows, "hits")
    n, mean = rows.agg(F.count("*"), F.avg("n")).first()
    tf = rows.select("id", "n", F.explode("hit").alias("t")).groupBy("id", "n", "t").agg(F.count("*").alias("tf"))
    df = F.broadcast(tf.groupBy("t").agg(F.count("*").alias("df")))  # one row per query word
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / (mean or 1)))
    out = tf.join(df, "t").groupBy("id").agg(F.round(F.sum(gain), 9).alias("score"))
    return out.orderBy(F.col("score").desc(), "id").limit(k) if k else out


def cosine(vectors: DataFrame, query: list[float], k: int | None = None) -> DataFrame:
    """``(id, score)`` of ``vectors(id, v)`` by cosine in double precision; the k best, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    score = dot(F.col("v"), q) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(q, q))
    out = vectors.select("id", score.alias("score")).where("score is not null")
    return out.orderBy(F.col("score").desc(), "id").limit(k) if k else out


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score)``: the k rows of ``vectors(id, v)`` with the greatest cosine for each of ``queries(id, v)``.

    Ties go by id, of any type that has an order; NULL and zero vectors, and vectors of another length than the query, are no answers.  Queries are a
    stated set: blocks of them, bounded in bytes and so that their scores against SLICE vectors are, are broadcast in turn; every task keeps k rows of its own
    per query, and those meet by query.
    """
    size, n = queries.agg(F.max(F.size("v")), F.count("*")).first()
    blocks = max(1, -(-n // max(1, min(QUERY_BYTES // (8 * max(1, size or 1)), SCORE_BYTES // (8 * (k + SLICE))))))
    ordered = vectors.select("id", "v").where("id is not null and v is not null").sortWithinPartitions("id")
    out = None
    for block in range(blocks):
        part = queries.select("id", "v").where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        mine = _nearest_block(ordered, part, k)
        out = mine if out is None else out.unionByName(mine)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    place = "__tw_place"
    return out.withColumn(place, F.row_number().over(best)).where(F.col(place) <= k).drop(place)


def _units(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (unit vectors, which rows they are of); vectors with NULLs, without a finite length or of length 0 are left out."""
    rows, by = column.to_pylist(), {}
    for i, v in enumerate(rows):
        if v and None not in v:
            by.setdefault(len(v), []).append(i)
    out = {}
    for dim, at in by.items():
        x = np.array([rows[i] for i in at], np.float64)
        length = np.sqrt((x * x).sum(1))
        fine = np.isfinite(length) & (length > 0)
        out[dim] = x[fine] / length[fine, None], np.array(at)[fine]
    return out


class _Best:
    """The k best of each of some queries so far.  Vectors come in the order of their ids, so of equal scores the first stays."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.score, self.names = np.full((len(queries), k), -np.inf), np.full((len(queries), k), None, object)

    def add(self, x: np.ndarray, names: np.ndarray) -> None:
        s = np.round(self.q @ x.T, 12)  # so that vectors of one direction tie
        better = s > self.score[:, -1:]
        rows, columns = np.flatnonzero(better.any(1)), np.flatnonzero(better.any(0))
        if not len(rows):
            return
        both = np.concatenate([self.score[rows], s[np.ix_(rows, columns)]], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, : self.k]
        named = np.concatenate([self.names[rows], np.broadcast_to(names[columns], (len(rows), len(columns)))], axis=1)
        self.score[rows], self.names[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)


def _nearest_block(vectors: DataFrame, part: pa.Table, k: int) -> DataFrame:
    ids = np.array([*part.column("id").to_pylist(), None], object)[:-1]
    shared = vectors.sparkSession.sparkContext.broadcast({dim: (q, ids[at]) for dim, (q, at) in _units(part.column("v")).items()})
    of, kind = part.schema.field("id").type, vectors.schema["id"].dataType.simpleString()

    def scan(batches):
        best = {dim: _Best(q, k) for dim, (q, _) in shared.value.items()}
        own = None
        for batch in batches:
            own = batch.schema.field(0).type
            names = np.array([*batch.column(0).to_pylist(), None], object)[:-1]
            for dim, (x, rows) in _units(batch.column(1)).items():
                for i in range(0, len(x) if dim in best else 0, SLICE):
                    best[dim].add(x[i : i + SLICE], names[rows[i : i + SLICE]])
        for dim, b in best.items():
            asked, place = np.nonzero(np.isfinite(b.score))
            for i in range(0, len(asked), 1 << 16):
                r, c = asked[i : i + (1 << 16)], place[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[dim][1][r].tolist(), of), pa.array(b.names[r, c].tolist(), own), pa.array(b.score[r, c])], ["query_id", "id", "score"])

    asked = {"int64": "bigint", "int32": "int", "string": "string"}.get(str(of), kind)
    return vectors.mapInArrow(scan, f"query_id {asked}, id {kind}, score double")


def fused(*rankings: DataFrame, k: int, c: int = 60) -> DataFrame:
    """The k best by reciprocal-rank fusion of whole rankings ``(id, score)``; ties by id.

    A row beyond rank ``lists * (c + k) - c`` of every list can't pass the k-th of any one of them, so the rows above it are
    the candidates.  A candidate's rank in a list is one more than the rows before it, counted in one pass over the list
    against the candidates, whose number depends on k alone.
    """
    depth = len(rankings) * (c + k) - c
    lists = [saved(r.select("id", "score").where("score is not null"), "ranking") for r in rankings]
    tops = [r.orderBy(F.col("score").desc(), "id").limit(depth).select("id") for r in lists]
    candidates = tops[0]
    for t in tops[1:]:
        candidates = candidates.unionByName(t)
    candidates, every = saved(candidates.distinct(), "candidates"), None
    for r in lists:
        own = F.broadcast(r.join(F.broadcast(candidates), "id").select(F.col("id").alias("own"), F.col("score").alias("least")))  # lists * depth rows
        before = (F.col("score") > F.col("least")) | ((F.col("score") == F.col("least")) & (F.col("id") <= F.col("own")))
        share = r.join(own, before).groupBy(F.col("own").alias("id")).agg((1 / (c + F.count("*"))).alias("share"))
        every = share if every is None else every.unionByName(share)
    return every.groupBy("id").agg(F.sum("share").alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
