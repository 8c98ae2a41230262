"""Candidate scores: five features of a track against a scenario, their weighted total, rank, and report parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators.tracks import HOUR
from tidewake.scratch import small

# The features' weights.
WEIGHTS = {"proximity": 0.25, "temporal_overlap": 0.25, "trajectory_consistency": 0.20, "drift_consistency": 0.20, "behavioral_anomaly": 0.10}
SCENARIO = "case_id string, origin_lat double, origin_lon double, observed_lat double, observed_lon double, release_us long"
#: Cases that meet the points at a time, and are broadcast together.
CASES = 1000
DISCLAIMER = "Rankings are investigative leads, not attribution."


def features(points: DataFrame, scenarios: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``(case_id, mmsi, five features, total)``, unrounded: one aggregation by case and vessel.

    Every case is held against every vessel, so cases are a set of questions: they meet the points in blocks of about CASES,
    each broadcast, and partial aggregates by case and vessel leave the tasks.  Vessels without points have no row.
    """
    n = scenarios.count()
    if n > CASES:
        blocks = -(-2 * n // CASES)
        parts = [_features(points, scenarios.where(F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == k), weights) for k in range(blocks)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    return _features(points, scenarios, weights)


def _features(points: DataFrame, scenarios: DataFrame, weights: dict[str, float]) -> DataFrame:
    """What depends on a vessel alone is gathered once a vessel; only distances and hours are taken of every case and report."""
    c = F.col
    far = geo.flat_km(c("lat"), c("lon"), c("origin_lat"), c("origin_lon"))
    off = F.abs(c("us") - c("release_us")) / HOUR
    at, pos, sog = F.struct("us", "ord"), F.struct("lat", "lon"), F.coalesce("sog", F.lit(0.0))
    vessels = points.groupBy(c("mmsi").alias("vessel")).agg(F.min_by(pos, at).alias("p"), F.max_by(pos, at).alias("q"), (F.max(sog) - F.min(sog)).alias("v"))
    keys = ["case_id", "origin_lat", "origin_lon", "observed_lat", "observed_lon"]
    met = points.select("mmsi", "us", "lat", "lon").join(F.broadcast(scenarios)).groupBy(*keys, "mmsi").agg(F.min(far).alias("d"), F.min(off).alias("h"))
    a = met.join(vessels, c("mmsi").eqNullSafe(c("vessel")))
    turn = geo.wrap_degrees(geo.flat_bearing(c("p.lat"), c("p.lon"), c("q.lat"), c("q.lon")), geo.flat_bearing(c("origin_lat"), c("origin_lon"), c("observed_lat"), c("observed_lon")))
    parts = {"proximity": 100 * F.exp(-c("d") / 18), "temporal_overlap": 100 * F.exp(-c("h") / 2.5), "trajectory_consistency": 100 * (1 - turn / 180), "drift_consistency": F.greatest(F.lit(0.0), 100 - 4 * c("d")), "behavioral_anomaly": F.least(F.lit(100.0), 8 * c("v"))}
    out = a.select("case_id", "mmsi", *[v.alias(k) for k, v in parts.items()])
    return out.withColumn("total", sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))


def ranked(scores: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``rank`` per case by total, ties in mmsi order; with ``names(mmsi, vessel_name)`` or "Vessel <mmsi>"; evidence ids and text."""
    w = Window.partitionBy("case_id").orderBy(F.col("total").desc(), "mmsi")
    out = scores.withColumn("rank", F.row_number().over(w).cast("long"))
    named = out.join(names, "mmsi", "left") if names is not None else out.withColumn("vessel_name", F.lit(None).cast("string"))
    shown = lambda k: F.format_string("%.2f", geo.round_half_even(F.col(k)))
    return named.withColumns({"vessel_name": F.coalesce("vessel_name", F.concat(F.lit("Vessel "), "mmsi")), "evidence_ids": F.array(F.concat(F.lit("ais-"), "mmsi"), F.lit("drift-ensemble-001")), "explanation": F.concat(F.lit("Total "), shown("total"), F.lit("; proximity "), shown("proximity"), F.lit(", overlap "), shown("temporal_overlap"))})


def evidence(candidates: DataFrame, fixed: DataFrame) -> DataFrame:
    """The fixed evidence of the cases and one row per candidate: ``(case_id, id, source, title)``."""
    own = candidates.select("case_id", F.concat(F.lit("ais-"), "mmsi").alias("id"), F.lit("ais").alias("source"), F.concat(F.lit("Track of "), "vessel_name").alias("title"))
    return candidates.select("case_id").distinct().join(small(fixed)).select("case_id", "id", "source", "title").unionByName(own)


def claims(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """Three claims per case: detection, origin and top candidate (confidence 0 if there is none)."""
    top = candidates.where("rank = 1").select("case_id", "vessel_name", "evidence_ids", (F.col("total") / 100).alias("confidence"))
    row = lambda n, claim, ids, conf: F.struct(F.lit(n).cast("long").alias("n"), claim.alias("claim"), ids.alias("evidence_ids"), conf.alias("confidence"))
    some = F.col("vessel_name").isNotNull()
    three = F.array(
        row(1, F.lit("A slick was detected"), F.array(F.lit("detection-001")), F.lit(0.91)),
        row(2, F.lit("The drift ensemble gives a region of origin"), F.array(F.lit("drift-ensemble-001")), F.lit(0.73)),
        row(3, F.when(some, F.concat("vessel_name", F.lit(" ranks first"))).otherwise(F.lit("No candidate was found")), F.when(some, F.col("evidence_ids")).otherwise(F.array(F.lit("guidance-001"))), F.coalesce("confidence", F.lit(0.0))),
    )
    return cases.select("case_id").join(top, "case_id", "left").select("case_id", F.explode(three).alias("c")).select("case_id", "c.*")


def unsupported(claims_: DataFrame, evidence_: DataFrame) -> DataFrame:
    """Claims' evidence ids that no evidence of the case has; empty for a sound report."""
    return claims_.select("case_id", "n", F.explode("evidence_ids").alias("id")).join(evidence_.select("case_id", "id"), ["case_id", "id"], "left_anti")


def candidate(candidates: DataFrame, evidence_: DataFrame, case_id: str, mmsi: str) -> DataFrame:
    """The candidate of one case and vessel with its evidence as an array; no row if there is none."""
    one = candidates.where((F.col("case_id") == case_id) & (F.col("mmsi") == mmsi))
    own = evidence_of(one, evidence_).groupBy("case_id", "mmsi").agg(F.sort_array(F.collect_list(F.struct("id", "source", "title"))).alias("evidence"))
    return one.join(own, ["case_id", "mmsi"], "left")


def rounded(candidates: DataFrame) -> DataFrame:
    """Features and total to two decimals, as reports show them; see :func:`tidewake.functions.geo.round_half_even`."""
    return candidates.withColumns({k: geo.round_half_even(F.col(k)) for k in (*WEIGHTS, "total") if k in candidates.columns})


def evidence_of(candidates: DataFrame, evidence_: DataFrame) -> DataFrame:
    return candidates.select("case_id", "mmsi", F.explode("evidence_ids").alias("id")).join(evidence_, ["case_id", "id"])


def report(claims_: DataFrame) -> DataFrame:
    """One row per case with its claims as an array and all evidence ids."""
    return claims_.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("n", "claim", "evidence_ids", "confidence"))).alias("claims"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids")).withColumn("disclaimer", F.lit(DISCLAIMER))


def geojson(features_: DataFrame, ring: Column, *properties: str, many: bool = False) -> DataFrame:
    """One GeoJSON Feature per row; a FeatureCollection is their concatenation, written by any text sink.

    ``ring`` is a closed ring of (lon, lat) structs, or with ``many`` an array of them, the outer one first.
    """
    line = lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"]))
    coordinates = F.transform(ring, line) if many else F.array(line(ring))
    return features_.select(*properties, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
