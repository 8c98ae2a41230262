"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import crc_fold, mapped

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Training uses about so many documents at most, picked by a hash of their id; below that, all.
MAX_TRAIN_DOCS = 20_000
#: N-grams of a text overlap and repeat; so many at most count as independent evidence in its score.
EVIDENCE = 20
#: Code points that are scored at a time.
_BLOCK = 1 << 20


def _features(points: np.ndarray) -> list[np.ndarray]:
    """For each order n, the bucket of the n-gram that starts at each code point (the last n-1 run into padding)."""
    out, h = [], np.zeros(len(points), np.uint32)
    for n in range(max(ORDERS)):
        h = h * np.uint32(0x01000193) + (np.concatenate([points[n:], np.full(min(n, len(points)), 32, np.uint32)]) + np.uint32(1)) * np.uint32(0x9E3779B1)
        if n + 1 in ORDERS:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)) & np.uint32(BUCKETS - 1))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(texts: list[str | None]):
    """(indexes, starts, ends, points): texts joined with a padding that no n-gram of one text can cross."""
    pad, at, held, size = np.full(max(ORDERS) - 1, 32, np.uint32), [], [], 0
    for i, text in enumerate(texts):
        if text:
            held.append(_points(text))
            at.append(i)
            size += len(held[-1])
        if held and (size >= _BLOCK or i + 1 == len(texts)):
            ends = np.cumsum([len(x) + len(pad) for x in held])
            starts = np.concatenate([[0], ends[:-1]])
            yield at, starts, ends - len(pad), np.concatenate([y for x in held for y in (x, pad)])
            at, held, size = [], [], 0

#: Languages that a model may have.
MOST_LANGS = 1000


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> dict:
    """A model from ``docs(doc_id, text, lang)``; rows with NULL text or lang teach nothing.

    Executors count n-grams per language and bucket, partial sums are added in Spark, and at most languages x BUCKETS
    numbers reach the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    share = min(1.0, max_docs / max(n, 1))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < share * 1_000_000)

    def count(it):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in it:
            langs = batch.column(1).to_pylist()
            for at, starts, ends, points in _blocks(batch.column(0).to_pylist()):
                features = _features(points)
                for i, a, b in zip(at, starts, ends):
                    total = sums.setdefault(langs[i], np.zeros(BUCKETS, np.int64))
                    for f in features:
                        total += np.bincount(f[a:b], minlength=BUCKETS)
                    seen[langs[i]] = seen.get(langs[i], 0) + 1
        for lang, total in sums.items():
            hit = np.append(np.flatnonzero(total), -1)  # bucket -1 counts documents
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(hit), "bucket": pa.array(hit, pa.int64()), "n": pa.array(np.append(total[hit[:-1]], seen[lang]), pa.int64())})

    several = rows.select("lang").distinct().limit(MOST_LANGS + 1).count()
    if several > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values; the model has a column of numbers for each and goes to every task")
    found = rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(found["lang"]), key=lambda x: x.encode())
    place = {x: i for i, x in enumerate(langs)}
    counts, prior = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for lang, part in found.groupby("lang"):
        gram = part[part["bucket"] >= 0]
        counts[gram["bucket"].to_numpy(), place[lang]] = gram["n"].to_numpy()
        prior[place[lang]] = part.loc[part["bucket"] < 0, "n"].sum()
    smooth = 0.1
    return {"langs": langs, "prior": np.log(prior / max(prior.sum(), 1)), "logp": np.log((counts + smooth) / (counts.sum(axis=0) + smooth * BUCKETS)).astype(np.float32)}


def _classify(texts: list[str | None], langs: list[str], prior: np.ndarray, logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if langs:
        for at, starts, ends, points in _blocks(texts):
            total = np.tile(prior, (len(at), 1))
            spans = np.stack([starts, ends], axis=1).ravel()
            for f in _features(points):  # only the buckets that occur are looked up, then summed by text
                total += np.add.reduceat(logp[f], spans, axis=0, dtype=np.float64)[::2]
            best = total.argmax(axis=1)
            grams = len(ORDERS) * np.maximum(1, ends - starts)
            weight = np.minimum(grams, EVIDENCE) / grams
            # the alternative is text of no language, with every bucket alike
            each = np.concatenate([(total - prior) * weight[:, None], (-np.log(BUCKETS) * grams * weight)[:, None]], axis=1)
            post = np.exp(each[np.arange(len(at)), best] - np.logaddexp.reduce(each, axis=1))
            for i, k, p in zip(at, best, post):
                if any(map(str.isalpha, texts[i])):
                    names[i], scores[i] = langs[k], p
    return names, scores


def _share(docs: DataFrame, model: dict):
    return docs.sparkSession.sparkContext.broadcast((model["langs"], model["prior"], model["logp"]))  # languages x BUCKETS numbers


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row, from its whole text alone.

    The language is that of the largest posterior; equal ones go to the language that sorts first.  ``score`` is its
    probability against the other languages and a text of no language (all buckets alike), from the text's mean log
    probability of an n-gram over EVIDENCE n-grams at most, so that it doesn't grow with length.  Text that is NULL or has
    no letter, or a model that has seen no language: ``und`` with score 0.  Very long texts are scored whole.
    """
    shared = _share(docs, model)

    def batches(it):
        for batch in it:
            names, scores = _classify(batch.column(1).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learns from the rows whose crc32(doc_id) modulo ``folds`` is not ``held``.

    A NULL doc_id is neither learned from nor held out.  Repeated rows are predicted one by one; an empty table gives no rows.
    """
    fold = crc_fold(F.col("doc_id"), folds)
    model = train(docs.where(fold != held).select("doc_id", "text", "lang"), max_docs)
    return predict(docs, model).select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The rows of ``docs`` whose text has a language with score ``least`` or more; all columns stay.

    Rejected are texts that are NULL or have no letter (``und``), and texts that are better explained by no language than by any,
    such as other scripts; texts in several languages or with few words among numbers stay.  A table without a labelled row rejects ``und`` texts only.
    """
    model = train(docs.where(crc_fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared, where = _share(docs, model), docs.columns.index("text")

    def batches(it):
        for batch in it:
            names, scores = _classify(batch.column(where).to_pylist(), *shared.value)
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return mapped(docs, batches)
