"""Whole investigations as lazy plans: every part is a DataFrame, nothing runs before a sink asks for it."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import scoring

# Case numbers, and lengths of a question.
CASE_NUMBER, QUESTION = r"^OT-[0-9]{4}-[0-9]{4}$", (3, 500)


def valid_case_number(number: Column) -> Column:
    """NULL is not valid."""
    return F.coalesce(number.rlike(CASE_NUMBER), F.lit(False))


def valid_question(question: Column) -> Column:
    return F.coalesce(F.char_length(question).between(*QUESTION), F.lit(False))


@dataclasses.dataclass(frozen=True)
class Investigation:
    candidates: DataFrame
    evidence: DataFrame
    claims: DataFrame
    report: DataFrame
    steps: DataFrame


def investigate(points: DataFrame, cases: DataFrame, fixed_evidence: DataFrame, names: DataFrame | None = None) -> Investigation:
    """Candidates, evidence, claims, report and status rows of all ``cases`` at once.

    ``cases`` has the columns of ``scoring.SCENARIO``.  A case without vessels has no candidates, and a report that says so.
    """
    candidates = scoring.ranked(scoring.features(points, cases), names)
    evidence = scoring.evidence(candidates, fixed_evidence)
    claims = scoring.claims(candidates, cases)
    return Investigation(candidates, evidence, claims, scoring.report(claims), steps(cases, candidates, evidence))


def steps(cases: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(case_id, step, name, n)``: the stages of a case in order, with the rows that the last ones made."""
    counted = cases.select("case_id").join(candidates.groupBy("case_id").agg(F.count("*").alias("c")), "case_id", "left").join(evidence.groupBy("case_id").agg(F.count("*").alias("e")), "case_id", "left")
    rows = [("satellite", None), ("detection", None), ("drift", None), ("candidates", "c"), ("evidence", "e"), ("report", None)]
    row = lambda k, name, n: F.struct(F.lit(k).cast("long").alias("step"), F.lit(name).alias("name"), (F.coalesce(F.col(n), F.lit(0)) if n else F.lit(None)).cast("long").alias("n"))
    return counted.select("case_id", F.inline(F.array(*[row(k + 1, name, n) for k, (name, n) in enumerate(rows)])))


def newest_first(cases: DataFrame, at: str, key: str) -> DataFrame:
    """``cases`` with ``place``, from 1: newest ``at`` first, ties by ``key``.

    Places are counted within a day; the window over all of them sees one row a day.
    """
    dated = cases.withColumn("_day", F.to_date(at))
    days = dated.groupBy("_day").agg(F.count("*").alias("_n"))
    newer = F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_day").orderBy(F.col(at).desc_nulls_last(), key))
    rows, before = dated.withColumn("_own", own), days.select(F.col("_day").alias("_d"), newer.alias("_newer"))
    return rows.join(before, F.col("_day").eqNullSafe(F.col("_d"))).withColumn("place", (F.col("_newer") + F.col("_own")).cast("long")).drop("_day", "_d", "_own", "_newer")
