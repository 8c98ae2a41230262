import math
import random

from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators import scoring

#: What the surveyed system's language gives for these.
KNOWN = {2.675: 2.67, 1.005: 1.0, 84.955: 84.95, 0.125: 0.12, 0.375: 0.38, 0.625: 0.62, 2.5: 2.5, -2.675: -2.67, -0.125: -0.12, 1e-9: 0.0, 99.995: 100.0, 0.285: 0.28, 1.115: 1.11, 1e17: 1e17}


def test_rounding_is_by_the_exact_binary_value(spark):
    rng = random.Random(1)
    values = [*KNOWN, *(round(rng.uniform(-100, 100), 3) for _ in range(3000)), *(k / 1000 + 0.005 for k in range(3000)), *(rng.uniform(-1e9, 1e9) for _ in range(500)), *(math.nextafter(k + 0.125, s) for k in range(50) for s in (0, 1e9))]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", geo.round_half_even(F.col("v")).alias("a"), geo.round_half_even(F.col("v"), 0).alias("b")).collect()]
    assert all(a == round(v, 2) and b == round(v, 0) for v, a, b in got)
    assert {v: a for v, a, _ in got if v in KNOWN} == KNOWN
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) v").select(geo.round_half_even(F.col("v")).alias("r")).first().r is None


def test_candidates_are_explained_in_these_words(spark):
    rows = [("c", "123", 2.675, 84.955, 1.0, 0.0, 0.0, 91.285)]
    scores = spark.createDataFrame(rows, "case_id string, mmsi string, proximity double, temporal_overlap double, trajectory_consistency double, drift_consistency double, behavioral_anomaly double, total double")
    (one,) = scoring.ranked(scores).collect()
    assert one.explanation == "Total 91.28; proximity 2.67, overlap 84.95" and one.vessel_name == "Vessel 123" and one.evidence_ids == ["ais-123", "drift-ensemble-001"]
    assert scoring.rounded(scores).first().total == round(91.285, 2) == 91.28
