"""Registered queries of the engine's own operators, each with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import geo, geodesy
from tidewake.functions import sql as sql_functions
from tidewake.operators import anomalies, contours, drift, drift_steps, evaluation, nearest, raster, retrieval, scoring, track_index, tracks
from tidewake.plans import adapters, investigation
from tidewake.plans.adapters import AIS_SQL, ERROR_SQL, HEIGHT, PIXEL_SQL, SCENARIO_SQL, WIDTH, ais, pixels, table
from tidewake.plans.registry import QUERIES, SQL, query  # noqa: F401
from tidewake.scratch import fresh
from tidewake.sources import ais as reports

ROUTE = [(15.1, 73.1), (15.3, 73.2), (15.45, 73.35)]

def _r(name: str, places: int = 6):
    return F.round(name, places).alias(name)


# ---- SQL pieces


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(6371.0::DOUBLE * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _gcb(a: str, b: str, c: str, d: str) -> str:
    dl = f"radians({d} - {b})"
    return f"fmod(degrees(atan2(sin({dl}) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({dl}))) + 360, 360)"


def _flat(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(pow(({c} - {a}) * 111, 2) + pow(({d} - {b}) * 111 * cos(radians(({a} + {c}) / 2)), 2))"


def _fb(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2({d} - {b}, {c} - {a})) + 360, 360)"


def _wrap(a: str, b: str) -> str:
    return f"abs(fmod({a} - {b} + 540, 360) - 180)"


def _lerpb(a: str, b: str, s: str) -> str:
    y, x = (f"({f}(radians({a})) * (1 - {s}) + {f}(radians({b})) * {s})" for f in ("sin", "cos"))
    return f"fmod(degrees(atan2({y}, {x})) + 360, 360)"


_POS = "pos AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) pos, " + ", ".join(f"lag({c}) OVER w p_{c}, lead({c}) OVER w n_{c}" for c in ("us", "lat", "lon", "sog", "cog", "heading")) + " FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY us, ord))"
_WITH = f"WITH {AIS_SQL}, {_POS}"
_SUM = f"WITH {AIS_SQL}, s AS (SELECT mmsi, count(*) n, min(us) t0, max(us) t1, min_by(lat, (us, ord)) first_lat, min_by(lon, (us, ord)) first_lon, max_by(lat, (us, ord)) last_lat, max_by(lon, (us, ord)) last_lon, min(lat) min_lat, max(lat) max_lat, min(lon) min_lon, max(lon) max_lon, min(coalesce(sog, 0)) min_sog, max(coalesce(sog, 0)) max_sog FROM ais GROUP BY mmsi)"

# ---- parsing


def _raw_sql(more: str) -> str:
    return f"WITH {AIS_SQL}, r AS (SELECT *, {ERROR_SQL.format(more)} error FROM ais)"


@query(_raw_sql("") + " SELECT mmsi, CAST(us // 1000000 AS BIGINT) s, round(lat, 6) lat, round(lon, 6) lon, CASE WHEN ord % 103 = 0 THEN NULL ELSE round(sog, 6) END sog, heading FROM r WHERE error IS NULL")
def ais_parse_valid(spark, d):
    good, _ = reports.split(reports.parsed(adapters.raw_reports(spark, d), "lenient"))
    return good.select("mmsi", F.unix_seconds("ts").alias("s"), _r("lat"), _r("lon"), _r("sog"), "heading")


@query(_raw_sql(" WHEN ord % 103 = 0 THEN 'sog is not a number'") + " SELECT error, count(*) AS n FROM r WHERE error IS NOT NULL GROUP BY error")
def ais_rejects(spark, d):
    _, bad = reports.split(reports.parsed(adapters.raw_reports(spark, d), "strict"))
    return bad.groupBy("error").agg(F.count("*").alias("n"))


def _ingested(spark, d):
    """Damaged reports of which every seventh comes twice."""
    raw = adapters.raw_reports(spark, d)
    return reports.ingested(raw.unionByName(raw.where("ord % 7 = 0").withColumn("ord", F.col("ord") + 1_000_000_000)), F.col("ord"))


_FIRST = f"{_raw_sql('')}, k AS (SELECT mmsi, ord, us // 1000000 * 1000000 us, lat, lon FROM r WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY mmsi, us // 1000000, round(lat, 6), round(lon, 6) ORDER BY ord) = 1)"


@query(f"{_FIRST} SELECT mmsi, ord, CAST(us AS BIGINT) AS us FROM k")
def ais_ingest_points(spark, d):
    return _ingested(spark, d)[0].select("mmsi", "ord", "us")


@query(f"{_FIRST} SELECT mmsi, count(*) AS n, CAST(min(us) AS BIGINT) AS t0, CAST(max(us) AS BIGINT) AS t1, round(min(lat), 6) AS min_lat FROM k GROUP BY mmsi HAVING count(*) >= 2")
def ais_ingest_tracks(spark, d):
    return _ingested(spark, d)[1].select("mmsi", "n", "t0", "t1", _r("min_lat"))


@query(f"WITH {AIS_SQL} SELECT mmsi, ord, us FROM ais")
def ais_dedupe(spark, d):
    a = ais(spark, d)
    again = a.where("ord % 7 = 0").withColumn("ord", F.col("ord") + 1_000_000_000)
    return tracks.deduplicate(a.unionByName(again)).select("mmsi", "ord", "us")


# ---- tracks


@query(_SUM + " SELECT mmsi, n, t0, t1, " + ", ".join(f"round({c}, 6) {c}" for c in ("first_lat", "first_lon", "last_lat", "last_lon", "min_lat", "max_lat", "min_lon", "max_lon", "min_sog", "max_sog")) + " FROM s")
def track_summary(spark, d):
    s = tracks.summaries(ais(spark, d))
    return s.select("mmsi", "n", "t0", "t1", *[_r(c) for c in s.columns[4:]])


@query(f"{_WITH} SELECT mmsi, pos - 1 AS pos0, pos AS pos1, round((us - p_us) / 3600000000.0::DOUBLE, 6) AS hours FROM pos WHERE us - p_us > 21600000000")
def track_gaps(spark, d):
    return tracks.gaps(ais(spark, d)).select("mmsi", "pos0", "pos1", _r("hours"))


def _ticks_sql(where: str, k0: str, k1: str, base: str, step: int) -> str:
    t = f"{base} + k * {step}"
    s = "((t - us) / (n_us - us)::DOUBLE)"
    lerp = ", ".join(f"round({c} + (n_{c} - {c}) * {s}, 6) {c}" for c in ("lat", "lon", "sog"))
    return f"SELECT mmsi, t AS us, {lerp}, round({_lerpb('heading', 'n_heading', s)}, 5) heading FROM (SELECT *, {t} t FROM (SELECT *, unnest(generate_series({k0}, {k1})) k FROM (SELECT *, min(us) OVER (PARTITION BY mmsi) u0 FROM pos) WHERE {where}))"


_PLAIN = "SELECT mmsi, us, round(lat, 6) lat, round(lon, 6) lon, round(sog, 6) sog, round(heading, 5) heading FROM"


@query(f"{_WITH} {_PLAIN} pos WHERE pos = 0 UNION ALL " + _ticks_sql("n_us > us", "(us - u0) // 3600000000 + 1", "(n_us - u0) // 3600000000", "u0", 3_600_000_000))
def track_interpolate(spark, d):
    out = tracks.interpolate(ais(spark, d), 60)
    return out.select("mmsi", "us", _r("lat"), _r("lon"), _r("sog"), _r("heading", 5))


@query(f"{_WITH} {_PLAIN} pos UNION ALL " + _ticks_sql("n_us - us > 3600000000", "1", "(n_us - us) // 600000000", "us", 600_000_000))
def track_fill_gaps(spark, d):
    out = tracks.fill_gaps(ais(spark, d), 60)
    return out.select("mmsi", "us", _r("lat"), _r("lon"), _r("sog"), _r("heading", 5))


@query(f"{_SUM} SELECT mmsi, n FROM s WHERE n >= 2 AND max_lon >= 73.0::DOUBLE AND min_lon <= 73.1::DOUBLE AND max_lat >= 15.0::DOUBLE AND min_lat <= 15.1::DOUBLE")
def tracks_in_bbox(spark, d):
    return tracks.in_bbox(tracks.envelopes(ais(spark, d)), 73.0, 15.0, 73.1, 15.1).select("mmsi", "n")


@query(f"{_SUM} SELECT mmsi, n FROM s WHERE n >= 2 AND max_lon >= 73.05 - 5 / 111.0::DOUBLE AND min_lon <= 73.05 + 5 / 111.0::DOUBLE AND max_lat >= 15.1 - 5 / 111.0::DOUBLE AND min_lat <= 15.1 + 5 / 111.0::DOUBLE")
def tracks_in_radius(spark, d):
    return tracks.in_radius(tracks.envelopes(ais(spark, d)), 15.1, 73.05, 5).select("mmsi", "n")


@query(f"{_SUM} SELECT mmsi, n FROM s, (SELECT min(epoch_us(ts)) a FROM events) WHERE n >= 2 AND t0 <= a + 7200000000 AND t1 >= a")
def tracks_in_time_range(spark, d):
    points = ais(spark, d)
    start = points.agg(F.min("us")).first()[0]
    return tracks.in_time_range(tracks.envelopes(points), start, start + 7_200_000_000).select("mmsi", "n")


@query(f"{_SUM}, b AS (SELECT n_nationkey AS box_id, 73 + 2e-2 * n_nationkey x0, 15 + 2e-2 * n_nationkey y0 FROM nation) SELECT box_id, mmsi FROM b JOIN s ON n >= 2 AND max_lon >= x0 AND min_lon <= x0 + 5e-2 AND max_lat >= y0 AND min_lat <= y0 + 3e-2")
def tracks_in_boxes(spark, d):
    k = F.col("n_nationkey")
    boxes = table(spark, d, "nation").select(k.alias("box_id"), (73 + 0.02 * k).alias("min_lon"), (15 + 0.02 * k).alias("min_lat")).withColumns({"max_lon": F.col("min_lon") + 0.05, "max_lat": F.col("min_lat") + 0.03})
    return tracks.boxes_join(tracks.envelopes(ais(spark, d)), boxes, 0.05)


# ---- anomalies


def _runs_sql(inside: str, having: str = "") -> str:
    return f"{_WITH}, i AS (SELECT *, {inside} f, sum(CASE WHEN {inside} THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi ORDER BY us, ord ROWS UNBOUNDED PRECEDING) isle FROM pos) SELECT mmsi, min(pos) AS pos0, max(pos) AS pos1 FROM i WHERE f GROUP BY mmsi, isle {having}"


@query(_runs_sql("coalesce(sog, 0) < 12", "HAVING max(us) - min(us) >= 1800000000"))
def stops(spark, d):
    return anomalies.stops(ais(spark, d), 12.0, 30).select("mmsi", "pos0", "pos1")


@query(_runs_sql("least(" + ", ".join(_hav("lat", "lon", f"{a}::DOUBLE", f"{b}::DOUBLE") for a, b in ROUTE) + ") > 10"))
def route_deviation(spark, d):
    return anomalies.route_deviation(ais(spark, d), ROUTE).select("mmsi", "pos0", "pos1")


@query(f"{_WITH}, z AS (SELECT *, count(sog) OVER v n, avg(sog) OVER v m, stddev_pop(sog) OVER v sd FROM pos WINDOW v AS (PARTITION BY mmsi)) SELECT mmsi, pos, round(abs(sog - m) / sd, 6) AS z FROM z WHERE n >= 3 AND sd > 0 AND abs(sog - m) / sd > 3")
def speed_anomaly(spark, d):
    return anomalies.speed_anomaly(ais(spark, d)).select("mmsi", "pos", _r("z"))


@query(f"{_WITH}, t AS (SELECT mmsi, pos, {_wrap(_gcb('lat', 'lon', 'n_lat', 'n_lon'), _gcb('p_lat', 'p_lon', 'lat', 'lon'))} turn FROM pos WHERE cog IS NOT NULL AND p_cog IS NOT NULL AND n_cog IS NOT NULL) SELECT mmsi, pos, round(turn, 5) AS turn FROM t WHERE turn > 45")
def course_change(spark, d):
    return anomalies.course_change(ais(spark, d)).select("mmsi", "pos", _r("turn", 5))


_NEAR = f"{_hav('st.clat', 'st.clon', 'p.lat', 'p.lon')} <= 5"


@query(
    f"WITH RECURSIVE {AIS_SQL}, {_POS}, st AS (SELECT mmsi, pos, lat clat, lon clon, NULL::BIGINT s, NULL::BIGINT sus, us pus, NULL::BIGINT e0, NULL::BIGINT e1 FROM pos WHERE pos = 0 UNION ALL "
    f"SELECT p.mmsi, p.pos, CASE WHEN {_NEAR} THEN clat ELSE p.lat END, CASE WHEN {_NEAR} THEN clon ELSE p.lon END, CASE WHEN {_NEAR} THEN coalesce(s, p.pos) END, CASE WHEN {_NEAR} THEN coalesce(sus, p.us) END, p.us, "
    f"CASE WHEN NOT {_NEAR} AND pus - sus >= 3600000000 THEN s END, CASE WHEN NOT {_NEAR} AND pus - sus >= 3600000000 THEN st.pos END FROM st JOIN pos p ON p.mmsi = st.mmsi AND p.pos = st.pos + 1) "
    "SELECT mmsi, e0 AS pos0, e1 AS pos1 FROM st WHERE e0 IS NOT NULL UNION ALL SELECT mmsi, s, pos FROM st JOIN (SELECT mmsi, max(pos) pos FROM pos GROUP BY mmsi) USING (mmsi, pos) WHERE pus - sus >= 3600000000"
)
def loitering(spark, d):
    return anomalies.loitering(ais(spark, d))


# ---- geometry


@query(f"{_WITH} SELECT ord, round({_hav('p_lat', 'p_lon', 'lat', 'lon')}, 6) AS haversine, round({_gcb('p_lat', 'p_lon', 'lat', 'lon')}, 5) AS bearing, round({_flat('p_lat', 'p_lon', 'lat', 'lon')}, 6) AS flat, round({_fb('p_lat', 'p_lon', 'lat', 'lon')}, 5) AS flat_bearing, round({_wrap('cog', 'p_cog')}, 6) AS turn FROM pos WHERE p_us IS NOT NULL")
def geo_legs(spark, d):
    p = tracks.with_neighbours(ais(spark, d), "us", "lat", "lon", "cog").where("prev_us is not null")
    leg = [F.col(c) for c in ("prev_lat", "prev_lon", "lat", "lon")]
    cols = {"haversine": (geo.haversine_km, 6), "bearing": (geo.great_circle_bearing, 5), "flat": (geo.flat_km, 6), "flat_bearing": (geo.flat_bearing, 5)}
    return p.select("ord", *[F.round(f(*leg), n).alias(k) for k, (f, n) in cols.items()], F.round(geo.wrap_degrees(F.col("cog"), F.col("prev_cog")), 6).alias("turn"))


@query(f"WITH {AIS_SQL}, b AS (SELECT c_custkey, 15 + 1e-3 * (c_custkey % 400) y, 73 + 1e-3 * (c_custkey % 300) x FROM customer) SELECT c_custkey, round(4 * 3e-2 * 2e-2 * 111 * 111 * cos(radians(y - 2e-2)), 6) AS area_km2, round(y, 6) AS lat, round(x, 6) AS lon, x - 3e-2 < 73.1003::DOUBLE AND 73.1003::DOUBLE < x + 3e-2 AND y - 2e-2 < 15.1003::DOUBLE AND 15.1003::DOUBLE < y + 2e-2 AS has_point FROM b")
def polygon_measures(spark, d):
    k = F.col("c_custkey")
    ring = table(spark, d, "customer").select("c_custkey", geo.box_ring(15 + 0.001 * (k % 400), 73 + 0.001 * (k % 300), 0.02, 0.03).alias("ring"))
    c = geo.ring_centroid(F.col("ring"))
    return ring.select("c_custkey", F.round(geo.ring_area_km2(F.col("ring")), 6).alias("area_km2"), F.round(c["lat"], 6).alias("lat"), F.round(c["lon"], 6).alias("lon"), geo.point_in_ring(F.lit(15.1003), F.lit(73.1003), F.col("ring")).alias("has_point"))


def _lambert(a: str, b: str, c: str, d: str) -> str:
    """Columns ``arc`` and ``h``, and the length ``km``, between (lat, lon) pairs."""
    f = geodesy.FLATTENING
    return f"""atan({1 - f!r}::DOUBLE * tan(radians({a}))) r1, atan({1 - f!r}::DOUBLE * tan(radians({c}))) r2, pow(sin((r2 - r1) / 2), 2) + cos(r1) * cos(r2) * pow(sin(radians({d} - {b}) / 2), 2) h, 2 * asin(sqrt(h)) arc,
CASE WHEN h > 0 THEN 6378.137::DOUBLE * (arc - {f / 2!r}::DOUBLE * ((arc - sin(arc)) * pow(sin((r1 + r2) / 2) * cos((r2 - r1) / 2), 2) / (1 - h) + (arc + sin(arc)) * pow(cos((r1 + r2) / 2) * sin((r2 - r1) / 2), 2) / h)) ELSE 0 END km"""


@query(f"WITH {AIS_SQL}, {_POS}, k AS (SELECT ord, {_lambert('p_lat', 'p_lon', 'lat', 'lon')} FROM pos WHERE p_us IS NOT NULL) SELECT ord, round(km, 5) AS km FROM k")
def geodesic_legs(spark, d):
    p = tracks.with_neighbours(ais(spark, d), "us", "lat", "lon").where("prev_us is not null")
    return p.select("ord", F.round(geodesy.geodesic_km(*map(F.col, ("prev_lat", "prev_lon", "lat", "lon"))), 5).alias("km"))


_SIDES = "v AS (SELECT c_custkey, 15 + 1e-3 * (c_custkey % 400) y, 73 + 1e-3 * (c_custkey % 300) x FROM customer), l AS (SELECT c_custkey, y + sa * 2e-2 la, x + sb * 3e-2 lo, y + sc * 2e-2 lb, x + sd * 3e-2 lp FROM v, (VALUES (-1, -1, -1, 1), (-1, 1, 1, 1), (1, 1, 1, -1), (1, -1, -1, -1)) s(sa, sb, sc, sd))"


def _authalic(lat: str) -> str:
    e, e2 = geodesy.E, geodesy.E2
    q = lambda s: f"({1 - e2!r}::DOUBLE * ({s} / (1 - {e2!r}::DOUBLE * {s} * {s}) - ln((1 - {e!r}::DOUBLE * {s}) / (1 + {e!r}::DOUBLE * {s})) / {2 * e!r}::DOUBLE))"
    return f"asin({q(f'sin(radians({lat}))')} / {q('1')})"


@query(f"WITH {_SIDES}, m AS (SELECT *, tan({_authalic('la')} / 2) s, tan({_authalic('lb')} / 2) t, {_lambert('la', 'lo', 'lb', 'lp')} FROM l) SELECT c_custkey, round(abs(sum(2 * atan2(tan(radians(lp - lo) / 2) * (s + t), 1 + s * t))) * {geodesy.AUTHALIC_KM**2!r}::DOUBLE, 5) AS area_km2, round(sum(km), 5) AS perimeter_km FROM m GROUP BY c_custkey")
def polygon_geodesic(spark, d):
    k = F.col("c_custkey")
    ring = table(spark, d, "customer").select("c_custkey", geo.box_ring(15 + 0.001 * (k % 400), 73 + 0.001 * (k % 300), 0.02, 0.03).alias("ring"))
    return ring.select("c_custkey", F.round(geodesy.ring_geodesic_km2(F.col("ring")), 5).alias("area_km2"), F.round(geodesy.ring_geodesic_km(F.col("ring")), 5).alias("perimeter_km"))


def _utm_sql(zone: int) -> str:
    """Columns ``east`` and ``north`` (metres) of ``lat`` and ``lon`` in the north."""
    terms = lambda f, g: " + ".join(f"{c!r}::DOUBLE * {f}({2 * k} * gx) * {g}({2 * k} * gy)" for k, c in enumerate(geodesy.TO_GRID, 1))
    e, scale = geodesy.E, geodesy.UTM_SCALE * geodesy.MERIDIAN_KM * 1000
    return f"sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) t, radians(lon - {6 * zone - 183}) away, atan2(t, cos(away)) gx, atanh(sin(away) / sqrt(1 + t * t)) gy, 500000 + {scale!r}::DOUBLE * (gy + {terms('cos', 'sinh')}) east, {scale!r}::DOUBLE * (gx + {terms('sin', 'cosh')}) north"


@query(f"WITH {AIS_SQL}, g AS (SELECT ord, lat, lon, {_utm_sql(43)} FROM ais) SELECT ord, round(east, 3) AS east, round(north, 3) AS north, round(lat, 6) AS lat, round(lon, 6) AS lon FROM g")
def utm_round_trip(spark, d):
    """Positions on the grid, and back: the twin has the positions themselves."""
    east, north = geodesy.to_utm(F.col("lat"), F.col("lon"), F.lit(43))
    p = ais(spark, d).select("ord", east.alias("east"), north.alias("north"))
    lat, lon = geodesy.from_utm(F.col("east"), F.col("north"), F.lit(43), F.lit(False))
    return p.select("ord", _r("east", 3), _r("north", 3), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


# ---- candidates

_PARTS = f"""{AIS_SQL}, {SCENARIO_SQL}, m AS (SELECT scn.*, mmsi, min({_flat('lat', 'lon', 'olat', 'olon')}) d, min(abs(us - rus) / 3600000000.0::DOUBLE) h, min_by(lat, (us, ord)) a, min_by(lon, (us, ord)) b, max_by(lat, (us, ord)) c, max_by(lon, (us, ord)) e, max(coalesce(sog, 0)) - min(coalesce(sog, 0)) v FROM ais, scn GROUP BY ALL),
f AS (SELECT case_id, mmsi, 100 * exp(-d / 18) proximity, 100 * exp(-h / 2.5::DOUBLE) temporal_overlap, 100 * (1 - {_wrap(_fb('a', 'b', 'c', 'e'), _fb('olat', 'olon', 'vlat', 'vlon'))} / 180) trajectory_consistency, greatest(0, 100 - 4 * d) drift_consistency, least(100, 8 * v) behavioral_anomaly FROM m),
t AS (SELECT *, 25e-2 * proximity + 25e-2 * temporal_overlap + 2e-1 * trajectory_consistency + 2e-1 * drift_consistency + 1e-1 * behavioral_anomaly total FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY total DESC, mmsi) AS rank FROM t)"""
_FEATURES = ["proximity", "temporal_overlap", "trajectory_consistency", "drift_consistency", "behavioral_anomaly", "total"]


def _candidates(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("mmsi"), F.col("c_name").alias("vessel_name")).where("c_custkey % 2 = 0")
    return scoring.ranked(scoring.features(ais(spark, d), adapters.scenarios(spark, d)), names)


@query(f"WITH {_PARTS} SELECT case_id, mmsi, {', '.join(f'round({c}, 5) {c}' for c in _FEATURES)} FROM t")
def candidate_features(spark, d):
    return scoring.features(ais(spark, d), adapters.scenarios(spark, d)).select("case_id", "mmsi", *[_r(c, 5) for c in _FEATURES])


@query(f"WITH {_PARTS} SELECT case_id, mmsi, coalesce(c_name, 'Vessel ' || mmsi) AS vessel_name, round(total, 5) AS total, rank FROM r LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = mmsi AND c_custkey % 2 = 0")
def candidate_rank(spark, d):
    return _candidates(spark, d).select("case_id", "mmsi", "vessel_name", _r("total", 5), "rank")


@query(f"WITH {_PARTS} SELECT case_id, mmsi, round(total, 5) AS total FROM r WHERE rank = 1")
def top_candidate(spark, d):
    return _candidates(spark, d).where("rank = 1").select("case_id", "mmsi", _r("total", 5))


def _fixed_evidence(spark, d):
    return table(spark, d, "region").where("r_regionkey < 3").select(F.element_at(F.array(F.lit("detection-001"), F.lit("drift-ensemble-001"), F.lit("guidance-001")), F.col("r_regionkey") + 1).alias("id"), F.lit("fixed").alias("source"), F.col("r_name").alias("title"))


_EVIDENCE = f"{_PARTS}, ev AS (SELECT DISTINCT case_id, id, 'fixed' AS source FROM r, (VALUES ('detection-001'), ('drift-ensemble-001'), ('guidance-001')) x(id) UNION ALL SELECT case_id, 'ais-' || mmsi, 'ais' FROM r)"


@query(f"WITH {_EVIDENCE} SELECT case_id, id, source FROM ev")
def evidence(spark, d):
    return scoring.evidence(_candidates(spark, d), _fixed_evidence(spark, d)).select("case_id", "id", "source")


@query(f"WITH {_PARTS} SELECT case_id, n, round(CASE n WHEN 1 THEN 91e-2 WHEN 2 THEN 73e-2 ELSE total / 100 END, 6) AS confidence, CASE n WHEN 1 THEN 'detection-001' WHEN 2 THEN 'drift-ensemble-001' ELSE 'ais-' || mmsi || ',drift-ensemble-001' END AS ids FROM r, (SELECT unnest([1, 2, 3])::BIGINT n) WHERE rank = 1")
def report_claims(spark, d):
    c = scoring.claims(_candidates(spark, d), adapters.scenarios(spark, d))
    return c.select("case_id", "n", _r("confidence"), F.array_join("evidence_ids", ",").alias("ids"))


@query(f"WITH {_PARTS} SELECT case_id, 3::BIGINT AS n, 'ais-' || mmsi AS id FROM r WHERE rank = 1 AND right(case_id, 1) IN ('1', '3') UNION ALL SELECT DISTINCT case_id, 1::BIGINT, 'detection-001' FROM r WHERE right(case_id, 1) = '2'")
def claim_integrity(spark, d):
    """Reports of which some lost evidence: cases 1 and 3 that of vessels, case 2 the detection."""
    c, case = _candidates(spark, d), F.right("case_id", F.lit(1))
    left = scoring.evidence(c, _fixed_evidence(spark, d)).where(~(case.isin("1", "3") & (F.col("source") == "ais")) & ~((case == "2") & (F.col("id") == "detection-001")))
    return scoring.unsupported(scoring.claims(c, adapters.scenarios(spark, d)), left).select("case_id", "n", "id")


@query(f"WITH {_PARTS}, v AS (SELECT min(mmsi) one FROM ais) SELECT case_id, mmsi, round(total, 5) AS total, rank, 'ais-' || mmsi || ':ais,drift-ensemble-001:fixed' AS evidence FROM r, v WHERE case_id = 'OT-2026-0001' AND mmsi = one")
def candidate_detail(spark, d):
    c = _candidates(spark, d)
    vessel = ais(spark, d).agg(F.min("mmsi")).first()[0] or ""
    one = scoring.candidate(c, scoring.evidence(c, _fixed_evidence(spark, d)), "OT-2026-0001", vessel)
    return one.select("case_id", "mmsi", _r("total", 5), "rank", F.array_join(F.transform("evidence", lambda e: F.concat(e["id"], F.lit(":"), e["source"])), ",").alias("evidence"))


@query(f"WITH {_PARTS} SELECT case_id, mmsi, {', '.join(f'round({c}, 2) {c}' for c in _FEATURES)} FROM t")
def candidate_rounded(spark, d):
    return scoring.rounded(scoring.features(ais(spark, d), adapters.scenarios(spark, d))).select("case_id", "mmsi", *_FEATURES)


@query(f"WITH {_PARTS} SELECT case_id, mmsi, unnest(['ais-' || mmsi, 'drift-ensemble-001']) AS id FROM r")
def candidate_evidence(spark, d):
    c = _candidates(spark, d)
    return scoring.evidence_of(c, scoring.evidence(c, _fixed_evidence(spark, d))).select("case_id", "mmsi", "id")


@query("SELECT o_orderkey, o_orderdate AS created_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def cases_newest_first(spark, d):
    return investigation.newest_first(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at")), "created_at", "o_orderkey")


# ---- search and metrics


@query("SELECT doc_id AS id FROM documents WHERE list_has_any(string_split_regex(lower(concat(source, ' ', text)), '\\s+'), ['license', 'license.', 'src3'])")
def ask_keyword(spark, d):
    return retrieval.ask(adapters.evidence_docs(spark, d), "Is License license. in src3 the").select("id")


@query("SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 2")
def ask_fallback(spark, d):
    """No document has a word of the question: the first ones answer."""
    return retrieval.ask(adapters.evidence_docs(spark, d), "Which unheardofword was neverwritten").select("id")


_WORDS = "w AS (SELECT doc_id id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w FROM documents)"


_BM25 = f"{_WORDS}, u AS (SELECT id, unnest(w) t, len(w) n FROM w), tf AS (SELECT id, n, t, count(*) tf FROM u WHERE t IN ('license', 'version', 'work') GROUP BY ALL), df AS (SELECT t, count(*) df FROM tf GROUP BY t), g AS (SELECT count(*) cnt, avg(len(w)) mean FROM w), bm AS (SELECT id, round(sum(ln(1 + (cnt - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * n / mean))), 9) AS s FROM tf JOIN df USING (t), g GROUP BY id)"


@query(f"WITH {_BM25} SELECT id, round(s, 5) AS score FROM bm")
def bm25_scores(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.bm25(docs, ["license", "version", "work"]).select("id", _r("score", 5))


_COS = "q AS (SELECT embedding::DOUBLE[] q FROM embeddings ORDER BY vec_id LIMIT 1), c AS (SELECT vec_id id, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) s FROM embeddings, q)"


def _first_vector(spark, d):
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query(f"WITH {_COS} SELECT id, round(s, 5) AS score FROM c ORDER BY s DESC, id LIMIT 10")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.cosine(v, _first_vector(spark, d), 10).select("id", _r("score", 5))


@query("WITH e AS (SELECT vec_id id, embedding::DOUBLE[] v FROM embeddings), s AS (SELECT q.id query_id, e.id, list_dot_product(e.v, q.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(q.v, q.v)) s FROM e q, e WHERE q.id % 20 = 0) SELECT query_id, id, round(s, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10")
def vector_search(spark, d):
    """Every vector whose id is divisible by 20 asks for its ten nearest of all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.nearest(v, v.where("id % 20 = 0"), 10).select("query_id", "id", _r("score", 5))


_SHARES = " UNION ALL ".join(f"(SELECT id, 1 / (60 + row_number() OVER (ORDER BY s DESC, id))::DOUBLE sh FROM {t} WHERE s IS NOT NULL)" for t in ("c", "bm"))


@query(f"WITH {_COS}, {_BM25}, f AS ({_SHARES}) SELECT id, round(sum(sh), 6) AS score FROM f GROUP BY id ORDER BY sum(sh) DESC, id LIMIT 20")
def hybrid_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.fused(retrieval.cosine(v, _first_vector(spark, d)), retrieval.bm25(docs, ["license", "version", "work"]), k=20).select("id", _r("score"))


_FLAGS = "(SELECT quality = 1 p, toxic = 1 a FROM labels)"


@query(f"SELECT round(count(*) FILTER (p AND a) / nullif(count(*) FILTER (p OR a), 0)::DOUBLE, 6) AS iou, round(2 * count(*) FILTER (p AND a) / nullif(count(*) FILTER (p) + count(*) FILTER (a), 0)::DOUBLE, 6) AS dice, round(count(*) FILTER (p AND a) / nullif(count(*) FILTER (p), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (p AND a) / nullif(count(*) FILTER (a), 0)::DOUBLE, 6) AS recall FROM {_FLAGS}")
def mask_metrics(spark, d):
    p, a = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, d, "labels").agg(*[F.round(f(p, a), 6).alias(f.__name__) for f in (evaluation.iou, evaluation.dice, evaluation.precision, evaluation.recall)])


# ---- rasters


@query(f"""WITH {PIXEL_SQL} SELECT scene_id, y, x, round(greatest(0, least(1, (10 * log10(v + 1e-10) + 25) / 30)), 6) AS v FROM px""")
def sar_db_normalize(spark, d):
    return pixels(spark, d).select("scene_id", "y", "x", F.round(raster.normalised(raster.to_db(F.col("v")), -25, 5), 6).alias("v"))


@query(f"WITH {PIXEL_SQL} SELECT scene_id, y, x, round(avg(v * (1 + ty / 10.0::DOUBLE + tx / 100.0::DOUBLE)), 6) AS v FROM px, (SELECT unnest(range(0, 3)) ty), (SELECT unnest(range(0, 4)) tx) WHERE y BETWEEN 24 * ty AND 24 * ty + 31 AND x BETWEEN 24 * tx AND 24 * tx + 31 GROUP BY scene_id, y, x")
def tile_stitch(spark, d):
    """Tiles predict differently, and overlaps are averaged."""
    predicted = raster.tiles(pixels(spark, d), HEIGHT, WIDTH, 32, 8).withColumn("v", F.col("v") * (1 + F.col("tile_row") / 10.0 + F.col("tile_col") / 100.0))
    return raster.stitched(predicted).select("scene_id", "y", "x", _r("v"))


@query(f"WITH {PIXEL_SQL} SELECT scene_id, round(coalesce(avg(v) FILTER (\"on\"), 0), 6) AS v FROM px GROUP BY scene_id")
def masked_mean(spark, d):
    return pixels(spark, d).groupBy("scene_id").agg(F.round(raster.masked_mean(F.col("v"), F.col("on")), 6).alias("v"))


_NINE = "(SELECT unnest([-1, 0, 1]) dy), (SELECT unnest([-1, 0, 1]) dx)"


@query(f'WITH {PIXEL_SQL}, g AS (SELECT DISTINCT scene_id, y + dy y, x + dx x FROM px, {_NINE} WHERE "on" AND y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 95) SELECT scene_id, y + dy AS y, x + dx AS x FROM g, {_NINE} WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 95 GROUP BY 1, 2, 3 HAVING count(*) = 9')
def morph_close(spark, d):
    return raster.closed(pixels(spark, d).where("on"), HEIGHT, WIDTH)


def _labelled_sql(name: str, rows: str) -> str:
    """CTEs that end in ``name(scene_id, y, x, component)``: the smallest pixel number that spreads over four neighbours."""
    steps = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx)"
    return f"""{name}_n AS (SELECT scene_id, y, x, scene_id * 1099511627776 + y * {WIDTH} + x AS id FROM {rows}),
{name}_e AS (SELECT a.id u, b.id v FROM (SELECT *, y + dy ny, x + dx nx FROM {name}_n, {steps}) a JOIN {name}_n b ON b.scene_id = a.scene_id AND b.y = ny AND b.x = nx),
{name}_c(id, c) USING KEY (id) AS (SELECT id, id FROM {name}_n UNION SELECT v, min(f.c) FROM {name}_c f JOIN {name}_e ON u = f.id JOIN recurring.{name}_c r ON r.id = v WHERE f.c < r.c GROUP BY v),
{name} AS (SELECT scene_id, y, x, c AS component FROM {name}_n JOIN {name}_c USING (id))"""


@query(f"""WITH {PIXEL_SQL}, g AS (SELECT scene_id, ty, tx, 75 + 9e-4 * (tx + 5e-1) lon, 15012e-3 - 9e-4 * (ty + 5e-1) lat FROM (SELECT DISTINCT scene_id FROM px), (SELECT unnest(range(0, 66)) ty), (SELECT unnest(range(0, 98)) tx)),
u AS (SELECT scene_id, ty, tx, {_utm_sql(43)}, (east - 500000) / 100 - 5e-1 cx, (1660000 - north) / 100 - 5e-1 cy FROM g), c AS (SELECT *, floor(cx) + i x4, floor(cy) + j y4 FROM u, (SELECT unnest([0, 1]) i), (SELECT unnest([0, 1]) j)),
w AS (SELECT c.scene_id, ty, tx, v, (1 - abs(cx - x4)) * (1 - abs(cy - y4)) w FROM c JOIN px ON px.scene_id = c.scene_id AND x = x4 AND y = y4) SELECT scene_id, ty AS y, tx AS x, round(sum(w * v) / sum(w), 5) AS v FROM w GROUP BY ALL""")
def raster_reproject(spark, d):
    out = raster.reprojected(pixels(spark, d), (100.0, 0.0, 500000.0, 0.0, -100.0, 1660000.0), 43, (0.0009, 0.0, 75.0, 0.0, -0.0009, 15.012), 66, 98)
    return out.select("scene_id", "y", "x", _r("v", 5))


_ON = f'{PIXEL_SQL}, set_px AS (SELECT * FROM px WHERE "on"), {_labelled_sql("lab", "set_px")}'


@query(f"""WITH {PIXEL_SQL}, g AS (SELECT scene_id, ty, tx, 75 + 9e-4 * (tx + 5e-1) lon, 15012e-3 - 9e-4 * (ty + 5e-1) lat FROM (SELECT DISTINCT scene_id FROM px), (SELECT unnest(range(0, 66)) ty), (SELECT unnest(range(0, 98)) tx)),
u AS (SELECT scene_id, ty, tx, 6378137.0::DOUBLE * radians(lon) east, 6378137.0::DOUBLE * ln(tan(radians(45 + lat / 2))) north, (east - 8348900) / 100 - 5e-1 cx, (1690600 - north) / 100 - 5e-1 cy FROM g), c AS (SELECT *, floor(cx) + i x4, floor(cy) + j y4 FROM u, (SELECT unnest([0, 1]) i), (SELECT unnest([0, 1]) j)),
w AS (SELECT c.scene_id, ty, tx, v, (1 - abs(cx - x4)) * (1 - abs(cy - y4)) w FROM c JOIN px ON px.scene_id = c.scene_id AND x = x4 AND y = y4) SELECT scene_id, ty AS y, tx AS x, round(sum(w * v) / sum(w), 5) AS v FROM w GROUP BY ALL""")
def raster_reproject_mercator(spark, d):
    out = raster.reprojected(pixels(spark, d), (100.0, 0.0, 8_348_900.0, 0.0, -100.0, 1_690_600.0), geodesy.projection(3857), (0.0009, 0.0, 75.0, 0.0, -0.0009, 15.012), 66, 98)
    return out.select("scene_id", "y", "x", _r("v", 5))


@query(f"WITH RECURSIVE {_ON} SELECT scene_id, component, count(*) AS size FROM lab GROUP BY ALL")
def component_sizes(spark, d):
    return raster.component_sizes(pixels(spark, d).where("on"), WIDTH)


def _cleaned_sql(min_area: int, max_hole: int) -> str:
    """CTEs after ``lab`` that end in ``cleaned``: small components away, small holes filled, closed."""
    inside = f"y + dy BETWEEN 0 AND {HEIGHT - 1} AND x + dx BETWEEN 0 AND {WIDTH - 1}"
    return f"""big AS (SELECT * FROM lab WHERE component IN (SELECT component FROM lab GROUP BY component HAVING count(*) >= {min_area})), unset AS (SELECT scene_id, y, x FROM px ANTI JOIN big USING (scene_id, y, x)), {_labelled_sql("hole", "unset")},
whole AS (SELECT scene_id, y, x FROM big UNION ALL SELECT scene_id, y, x FROM hole WHERE component IN (SELECT component FROM hole GROUP BY component HAVING count(*) < {max_hole})),
grown AS (SELECT DISTINCT scene_id, y + dy y, x + dx x FROM whole, {_NINE} WHERE {inside}), cleaned AS (SELECT scene_id, y + dy AS y, x + dx AS x FROM grown, {_NINE} WHERE {inside} GROUP BY ALL HAVING count(*) = 9)"""


@query(f"WITH RECURSIVE {_ON}, {_cleaned_sql(50, 100)} SELECT scene_id, y, x FROM cleaned")
def mask_postprocess(spark, d):
    return raster.postprocessed(pixels(spark, d), HEIGHT, WIDTH)


@query(f"""WITH RECURSIVE {_ON}, sides AS (SELECT u, count(*) n FROM lab_e GROUP BY u), r AS (SELECT lab.*, v, 4 - coalesce(n, 0) side, 1e2 * (lab.x + 5e-1) cx, -1e2 * (lab.y + 5e-1) cy FROM lab JOIN lab_n USING (scene_id, y, x) LEFT JOIN sides ON u = id JOIN px USING (scene_id, y, x))
SELECT scene_id, component, count(*) AS pixels, {', '.join(f'round({e}, 6) AS {n}' for e, n in (('count(*) / 1e2', 'area_km2'), ('sum(side) / 1e1', 'perimeter_km'), ('avg(cx)', 'cx'), ('avg(cy)', 'cy'), ('min(cx)', 'min_x'), ('max(cx)', 'max_x'), ('min(cy)', 'min_y'), ('max(cy)', 'max_y'), ('avg(v)', 'confidence')))} FROM r GROUP BY scene_id, component""")
def mask_polygons(spark, d):
    px = pixels(spark, d)
    out = raster.polygons(px.where("on"), WIDTH, (100.0, 0.0, 0.0, 0.0, -100.0, 0.0), px.select("scene_id", "y", "x", F.col("v").alias("p")))
    return out.select("scene_id", "component", "pixels", *[_r(c) for c in out.columns[3:]])


_TRACED = f"""{_labelled_sql("lab", "set_px")}, pl AS (SELECT l.*, n.id FROM lab l JOIN lab_n n USING (scene_id, y, x)),
way(d, fy, fx, oy, ox, ey, ex) AS (VALUES (0, 0, 1, -1, 0, 0, 1), (1, 1, 0, 0, 1, 1, 1), (2, 0, -1, 1, 0, 1, 0), (3, -1, 0, 0, -1, 0, 0)),
ed AS (SELECT p.scene_id, p.component, d, p.id * 4 + d e, CASE WHEN f.id IS NULL THEN p.id * 4 + (d + 1) % 4 WHEN g.id IS NULL THEN f.id * 4 + d ELSE g.id * 4 + (d + 3) % 4 END nx, p.y + ey cy, p.x + ex cx
FROM pl p CROSS JOIN way LEFT JOIN pl o ON o.scene_id = p.scene_id AND o.y = p.y + oy AND o.x = p.x + ox LEFT JOIN pl f ON f.scene_id = p.scene_id AND f.y = p.y + fy AND f.x = p.x + fx LEFT JOIN pl g ON g.scene_id = p.scene_id AND g.y = p.y + fy + oy AND g.x = p.x + fx + ox WHERE o.id IS NULL),
wk AS (SELECT e AS ring, e, nx, 0::BIGINT seq FROM ed WHERE e < nx UNION ALL SELECT ring, ed.e, ed.nx, seq + 1 FROM wk JOIN ed ON ed.e = wk.nx WHERE ed.e > ring),
whole AS (SELECT scene_id, component, ring, seq, cx, cy FROM wk JOIN ed USING (e) WHERE ring IN (SELECT ring FROM wk WHERE nx = ring) AND ed.e % 4 <> ed.nx % 4),
numbered AS (SELECT scene_id, component, dense_rank() OVER (PARTITION BY scene_id, component ORDER BY ring) - 1 AS ring, row_number() OVER (PARTITION BY ring ORDER BY seq) - 1 AS point, cx, cy, count(*) OVER (PARTITION BY ring) n FROM whole)"""


_RINGS = f"{PIXEL_SQL}, set_px AS (SELECT * FROM px WHERE v > 8e-1), {_TRACED}"


@query(f"WITH RECURSIVE {_RINGS} SELECT scene_id, component, ring::INT AS ring, point::INT AS point, round(1e2 * cx, 6) AS lon, round(-1e2 * cy, 6) AS lat FROM numbered UNION ALL SELECT scene_id, component, ring::INT, n::INT, round(1e2 * cx, 6), round(-1e2 * cy, 6) FROM numbered WHERE point = 0")
def slick_rings(spark, d):
    """Outlines of bright pixels, as a reader of their GeoJSON sees them, a row per point."""
    out = raster.outlines(pixels(spark, d).where("v > 0.8"), WIDTH, (100.0, 0.0, 0.0, 0.0, -100.0, 0.0))
    read = scoring.geojson(out, F.col("rings"), "scene_id", "component", many=True).withColumn("f", F.from_json("feature", "struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>>"))
    rings = read.where("f.geometry.type = 'Polygon'").select("scene_id", "component", F.posexplode("f.geometry.coordinates").alias("ring", "line"))
    return rings.select("scene_id", "component", "ring", F.posexplode("line").alias("point", "at")).select("scene_id", "component", "ring", "point", F.round(F.col("at")[0], 6).alias("lon"), F.round(F.col("at")[1], 6).alias("lat"))


def _degrees_sql() -> str:
    """Per row of pixels, and per pixel, the area and the sides' lengths on the ellipsoid."""
    sides = {"top": ("hi", "0", "hi", "1e-3"), "bottom": ("lo", "0", "lo", "1e-3"), "side": ("lo", "0", "hi", "0")}
    rows = ", ".join(f"k_{n} AS (SELECT y, {_lambert(*at)} FROM rws)" for n, at in sides.items())
    open_ = lambda dy, dx: f"CASE WHEN EXISTS (SELECT 1 FROM lab n WHERE n.scene_id = lab.scene_id AND n.y = lab.y + {dy} AND n.x = lab.x + {dx}) THEN 0 ELSE 1 END"
    return f"""rws AS (SELECT y, 152e-1 - 1e-3 * y hi, 152e-1 - 1e-3 * (y + 1) lo FROM (SELECT DISTINCT y FROM px)), {rows},
m AS (SELECT lab.*, {geodesy.AUTHALIC_KM**2!r}::DOUBLE * radians(1e-3) * (sin({_authalic("hi")}) - sin({_authalic("lo")})) area, ({open_(0, 1)} + {open_(0, -1)}) * k_side.km + {open_(-1, 0)} * k_top.km + {open_(1, 0)} * k_bottom.km line
FROM lab JOIN rws USING (y) JOIN k_side USING (y) JOIN k_top USING (y) JOIN k_bottom USING (y))"""


@query(f"WITH RECURSIVE {_ON}, {_degrees_sql()} SELECT scene_id, component, round(sum(area), 5) AS area_km2, round(sum(line), 5) AS perimeter_km FROM m GROUP BY scene_id, component")
def mask_polygons_geodesic(spark, d):
    out = raster.polygons(pixels(spark, d).where("on"), WIDTH, (0.001, 0.0, 73.0, 0.0, -0.001, 15.2), degrees=True)
    return out.select("scene_id", "component", _r("area_km2", 5), _r("perimeter_km", 5))


# ---- drift


@query(f"WITH {AIS_SQL}, e AS (SELECT ord, (lon - 73.2) * 111000 * cos(radians(lat)) dx, (lat - 15.2) * 111000 dy FROM ais), r AS (SELECT *, sqrt(dx * dx + dy * dy) r FROM e) SELECT ord, round(CASE WHEN r < 50000 THEN -5e-1 * dy / 50000 ELSE 0 END, 6) + 0 AS u, round(CASE WHEN r < 50000 THEN 5e-1 * dx / 50000 ELSE 0 END, 6) + 0 AS v FROM r")
def field_eddy(spark, d):
    u, v = geo.eddy_current(F.col("lat"), F.col("lon"), 15.2, 73.2)
    zero = lambda c, name: (F.round(c, 6) + 0.0).alias(name)
    return ais(spark, d).select("ord", zero(u, "u"), zero(v, "v"))


@query("SELECT event_id, round(5 * (1 + 3e-1 * sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE - 6) / 24)), 6) AS u FROM events")
def field_diurnal(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(geo.diurnal_wind(F.hour("ts"), F.minute("ts"), 5.0, 2.0)[0], 6).alias("u"))


@query(f"WITH {AIS_SQL} SELECT ord, round(2 * (us % 3600000000) / 3600000000.0::DOUBLE + lat + 3 * lon, 5) AS u, round(lat, 5) AS v FROM ais")
def field_gridded(spark, d):
    """A field that is linear in time, latitude and longitude, which interpolation must give back."""
    p = ais(spark, d).withColumn("t", (F.col("us") % 3_600_000_000) / 3_600_000_000.0)
    y, x = F.col("yi") * 0.1, F.col("xi") * 0.1
    axis = lambda name, lo, hi: spark.range(lo, hi).withColumnRenamed("id", name)
    grid = axis("ti", 0, 2).crossJoin(axis("yi", 148, 162)).crossJoin(axis("xi", 728, 742)).select("ti", "yi", "xi", (2.0 * F.col("ti") + y + 3 * x).alias("u"), y.alias("v"))
    return drift.gridded(p, F.broadcast(grid), 1.0, 0.1, 0.1).select("ord", _r("u", 5), _r("v", 5))


def _steps_sql(n: int) -> str:
    lat, lon = "lat", "lon"
    for _ in range(n):
        lat, lon = f"({lat} + 18e-2 / 111)", f"({lon} + 36e-2 / (111 * cos(radians({lat}))))"
    return f"SELECT ord, round({lat}, 6) AS lat, round({lon}, 6) AS lon FROM ais"


@query(f"WITH {AIS_SQL} {_steps_sql(3)}")
def drift_uniform_steps(spark, d):
    p = ais(spark, d).select("ord", "lat", "lon")
    for _ in range(3):
        lat, lon = drift.rk4(F.col("lat"), F.col("lon"), F.lit(0.6), F.lit(0.3), 600)
        p = p.select("ord", lat.alias("lat"), lon.alias("lon"))
    return p.select("ord", _r("lat"), _r("lon"))


@query(f"WITH {AIS_SQL}, m AS (SELECT CAST(mmsi AS BIGINT) % 5 g, ord % 3 k, count(*) n, least(1, 1 / (1 + stddev_pop(lat) + stddev_pop(lon))) c FROM ais GROUP BY ALL), w AS (SELECT CAST(mmsi AS BIGINT) % 5 g, stddev_pop(lat) sy, stddev_pop(lon) sx FROM ais GROUP BY ALL) SELECT g, count(*) AS ensemble_size, CAST(sum(n) AS BIGINT) AS trajectories, round(avg(c), 6) AS confidence, round(any_value(sy), 6) AS lat_std, round(any_value(sx), 6) AS lon_std FROM m JOIN w USING (g) GROUP BY g")
def drift_aggregate(spark, d):
    p = ais(spark, d).select((F.col("mmsi").cast("long") % 5).alias("g"), (F.col("ord") % 3).alias("member"), "lat", "lon")
    return drift.aggregated(p, "g").select("g", "ensemble_size", "trajectories", _r("confidence"), _r("lat_std"), _r("lon_std"))


@query(f"WITH {AIS_SQL} SELECT mmsi, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(least(1, 1 / (1 + stddev_pop(lat) + stddev_pop(lon))), 6) AS confidence FROM ais GROUP BY mmsi")
def drift_stats(spark, d):
    return drift.statistics(ais(spark, d), "mmsi").select("mmsi", "n", _r("lat"), _r("lon"), _r("confidence"))


def _kde_sql(last: int) -> str:
    """CTEs that end in ``dens(g, gy, gx, density)`` on last + 1 nodes a side."""
    return f"""{AIS_SQL}, k AS (SELECT CAST(mmsi AS BIGINT) % 5 g, lat, lon FROM ais), s0 AS (SELECT g, count(*)::DOUBLE n, var_samp(lat) vy, var_samp(lon) vx, covar_samp(lat, lon) c, min(lat) y0, max(lat) y1, min(lon) x0, max(lon) x1 FROM k GROUP BY g),
s AS (SELECT *, vy * pow(n, -1 / 3.0::DOUBLE) a, vx * pow(n, -1 / 3.0::DOUBLE) b, c * pow(n, -1 / 3.0::DOUBLE) r FROM s0), n AS (SELECT *, y0 - 1e-1 * (y1 - y0) + gy * (12e-1 * (y1 - y0) / {last}) qy, x0 - 1e-1 * (x1 - x0) + gx * (12e-1 * (x1 - x0) / {last}) qx FROM s, (SELECT unnest(generate_series(0, {last})) gy), (SELECT unnest(generate_series(0, {last})) gx)),
dens AS (SELECT g, gy, gx, any_value(qy) qy, any_value(qx) qx, sum(exp(-(b * pow(qy - lat, 2) - 2 * r * (qy - lat) * (qx - lon) + a * pow(qx - lon, 2)) / (a * b - r * r) / 2)) / (any_value(n.n) * 2 * pi() * sqrt(any_value(a * b - r * r))) density FROM n JOIN k USING (g) GROUP BY g, gy, gx)"""


@query(f"WITH {_kde_sql(9)} SELECT g, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, round(density, 4) AS density FROM dens")
def drift_kde_grid(spark, d):
    p = ais(spark, d).select((F.col("mmsi").cast("long") % 5).alias("g"), "lat", "lon")
    return drift.kde_grid(p, "g", 10).select("g", "gy", "gx", _r("density", 4))


# A point is a corner of the hull if some line through it and another point has no point on its right; gift wrapping from
# the leftmost, lowest point takes the sharpest right-hand neighbour at each step.
@query(
    f"WITH RECURSIVE {AIS_SQL}, p AS (SELECT DISTINCT mmsi, lat y, lon x FROM ais), s AS (SELECT mmsi, min_by(y, (x, y)) y, min(x) x, count(*) n FROM p GROUP BY mmsi), "
    "e AS (SELECT a.mmsi, a.y ay, a.x ax, b.y AS by_, b.x bx, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) far FROM p a JOIN p b ON a.mmsi = b.mmsi AND (a.y, a.x) <> (b.y, b.x) "
    "WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.mmsi = a.mmsi AND (c.y, c.x) <> (a.y, a.x) AND (c.y, c.x) <> (b.y, b.x) AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-12)), "
    "o AS (SELECT mmsi, ay, ax, max_by(by_, far) ny, max_by(bx, far) nx FROM e GROUP BY mmsi, ay, ax), "
    "w AS (SELECT mmsi, 0::BIGINT seq, y lat, x lon FROM s UNION ALL SELECT w.mmsi, seq + 1, ny, nx FROM w JOIN o ON o.mmsi = w.mmsi AND ay = lat AND ax = lon JOIN s ON s.mmsi = w.mmsi WHERE seq = 0 OR (lat, lon) <> (s.y, s.x)) "
    "SELECT mmsi, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM w"
)
def drift_hull(spark, d):
    return drift.hulls(ais(spark, d).select("mmsi", "lat", "lon"), "mmsi").select("mmsi", "seq", _r("lat"), _r("lon"))


@query(f"WITH {_kde_sql(49)} SELECT g, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, round(qy, 6) AS lat, round(qx, 6) AS lon, round(density, 4) AS density FROM dens QUALIFY density >= 5e-1 * max(density) OVER (PARTITION BY g)")
def drift_region(spark, d):
    p = ais(spark, d).select((F.col("mmsi").cast("long") % 5).alias("g"), "lat", "lon")
    return drift.density_region(drift.kde_grid(p, "g", 50), "g").select("g", "gy", "gx", _r("lat"), _r("lon"), _r("density", 4))


_REGION_RINGS = f"""{_kde_sql(49)}, set_px AS (SELECT g AS scene_id, gy AS y, gx AS x FROM dens QUALIFY density >= 5e-1 * max(density) OVER (PARTITION BY g)), {_TRACED},
place AS (SELECT g, min(qy) y0, (max(qy) - min(qy)) / 49 y1, min(qx) x0, (max(qx) - min(qx)) / 49 x1 FROM dens GROUP BY g),
made AS (SELECT scene_id g, dense_rank() OVER (PARTITION BY scene_id ORDER BY component) - 1 AS part, ring, point, n, x0 + (cx - 5e-1) * x1 lon, y0 + (cy - 5e-1) * y1 lat FROM numbered JOIN place ON g = scene_id)"""


@query(f"WITH RECURSIVE {_REGION_RINGS} SELECT g, part::INT AS part, ring::INT AS ring, point::INT AS point, round(lon, 6) AS lon, round(lat, 6) AS lat FROM made UNION ALL SELECT g, part::INT, ring::INT, n::INT, round(lon, 6), round(lat, 6) FROM made WHERE point = 0")
def drift_region_rings(spark, d):
    p = ais(spark, d).select((F.col("mmsi").cast("long") % 5).alias("g"), "lat", "lon")
    rings = drift.region_polygons(p, "g").select("g", "part", F.posexplode("rings").alias("ring", "line"))
    return rings.select("g", "part", "ring", F.posexplode("line").alias("point", "at")).select("g", "part", "ring", "point", F.round("at.lon", 6).alias("lon"), F.round("at.lat", 6).alias("lat"))


def _contour_sql(last: int) -> str:
    """CTEs that end in ``seg(g, u, v, lat, lon)``, sides between crossings of half the peak; ``edge`` numbers a cell's side by its nodes."""
    n, high = last + 3, [f"(d{k} >= lv)" for k in range(4)]
    edge = [f"(((cy + {i + 1}) * {n} + cx + {j + 1}) * 2 + {w})" for i, j, w in ((0, 0, 0), (0, 1, 1), (1, 0, 0), (0, 0, 1))]
    at = [("cy", f"cx + {'(lv - d0) / (d1 - d0)'}"), ("cy + (lv - d1) / (d2 - d1)", "cx + 1"), ("cy + 1", "cx + (lv - d3) / (d2 - d3)"), ("cy + (lv - d0) / (d3 - d0)", "cx")]
    each = " UNION ALL ".join(f"SELECT g, {edge[k]} u, CASE WHEN NOT {high[(k + 3) % 4]} THEN {edge[(k + 3) % 4]} WHEN NOT {high[(k + 2) % 4]} THEN {edge[(k + 2) % 4]} ELSE {edge[(k + 1) % 4]} END v, y0 + ({at[k][0]}) * y1 lat, x0 + ({at[k][1]}) * x1 lon FROM cell WHERE {high[k]} AND NOT {high[(k + 1) % 4]}" for k in range(4))
    corners = ", ".join(f"coalesce(c{k}.density, 0) d{k}" for k in range(4))
    joins = " ".join(f"LEFT JOIN dens c{k} ON c{k}.g = t.g AND c{k}.gy = cy + {i} AND c{k}.gx = cx + {j}" for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))))
    return f"""{_kde_sql(last)}, t AS (SELECT g, 5e-1 * max(density) lv, min(qy) y0, (max(qy) - min(qy)) / {last} y1, min(qx) x0, (max(qx) - min(qx)) / {last} x1 FROM dens GROUP BY g),
cell AS (SELECT t.*, cy, cx, {corners} FROM t, (SELECT unnest(generate_series(-1, {last})) cy), (SELECT unnest(generate_series(-1, {last})) cx) {joins}), seg AS ({each})"""


@query(f"WITH {_contour_sql(49)} SELECT g, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, round(lat, 6) AS lat, round(lon, 6) AS lon FROM seg")
def drift_contour_segments(spark, d):
    p = ais(spark, d).select((F.col("mmsi").cast("long") % 5).alias("g"), "lat", "lon")
    return contours.segments(drift.kde_grid(p, "g", 50), "g", 50).select("g", "u", "v", _r("lat"), _r("lon"))


@query(f"WITH {_contour_sql(49)} SELECT a.g, round(sum((a.lon - t.x0) * (b.lat - t.y0) - (b.lon - t.x0) * (a.lat - t.y0)) / 2 / (t.x1 * t.y1), 4) AS cells FROM seg a JOIN seg b ON a.g = b.g AND a.v = b.u JOIN t ON t.g = a.g GROUP BY a.g, t.x1, t.y1")
def drift_region_contours(spark, d):
    """What the lines of each region enclose, its holes taken out, in cells of its grid."""
    p = ais(spark, d).select((F.col("mmsi").cast("long") % 5).alias("g"), "lat", "lon")
    lines = drift.region_contours(p, "g", holes=True).select("g", F.explode("rings").alias("r"))
    area = F.expr("aggregate(sequence(1, size(r) - 1), 0D, (s, i) -> s + (r[i - 1].lon - r[0].lon) * (r[i].lat - r[0].lat) - (r[i].lon - r[0].lon) * (r[i - 1].lat - r[0].lat)) / 2")
    size = p.groupBy("g").agg((1.44 / 49 / 49 * (F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon"))).alias("cell"))
    return lines.groupBy("g").agg(F.sum(area).alias("area")).join(size, "g").select("g", F.round(F.col("area") / F.col("cell"), 4).alias("cells"))


@query(
    "WITH b AS (SELECT c_custkey // 20 g, 73 + 1e-3 * (c_custkey * 7 % 100) x0, 15 + 1e-3 * (c_custkey * 13 % 90) y0, 1e-3 * (10 + c_custkey % 17) w, 1e-3 * (5 + c_custkey % 11) h FROM customer), "
    "q AS (SELECT g, round(x0, 3) x0, round(x0 + w, 3) x1, round(y0, 3) y0, round(y0 + h, 3) y1 FROM b), "
    "xs AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) nx FROM (SELECT g, x0 x FROM q UNION SELECT g, x1 FROM q)), ys AS (SELECT g, y, lead(y) OVER (PARTITION BY g ORDER BY y) ny FROM (SELECT g, y0 y FROM q UNION SELECT g, y1 FROM q)) "
    "SELECT g, round(sum((nx - x) * (ny - y)) * 1000000, 3) AS area FROM xs JOIN ys USING (g) WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM q WHERE q.g = xs.g AND x0 <= x AND nx <= x1 AND y0 <= y AND ny <= y1) GROUP BY g"
)
def polygon_union(spark, d):
    """Overlapping boxes of twenty customers each, as polygons without overlap."""
    k, three = F.col("c_custkey"), lambda c: F.round(c, 3)
    x0, y0 = 73 + 0.001 * (k * 7 % 100), 15 + 0.001 * (k * 13 % 90)
    box = table(spark, d, "customer").select(F.floor(k / 20).alias("g"), three(x0).alias("x0"), three(x0 + 0.001 * (10 + k % 17)).alias("x1"), three(y0).alias("y0"), three(y0 + 0.001 * (5 + k % 11)).alias("y1"))
    ring = F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    made = contours.union(box.select("g", F.array(ring).alias("rings")), "g").select("g", F.explode("rings").alias("r"))
    area = F.expr("aggregate(sequence(1, size(r) - 1), 0D, (s, i) -> s + (r[i - 1].lon - r[0].lon) * (r[i].lat - r[0].lat) - (r[i].lon - r[0].lon) * (r[i - 1].lat - r[0].lat)) / 2")
    return made.groupBy("g").agg(F.round(F.sum(area) * 1_000_000, 3).alias("area"))


_FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<c_custkey:bigint>>"


@query("WITH b AS (SELECT c_custkey, 15 + 1e-3 * (c_custkey % 400) y, 73 + 1e-3 * (c_custkey % 300) x FROM customer) SELECT c_custkey, 'Feature/Polygon' AS kind, c_custkey AS property, 1 AS rings, k::INT AS point, round(x + 3e-2 * [-1, 1, 1, -1, -1][k + 1], 6) AS lon, round(y + 2e-2 * [-1, -1, 1, 1, -1][k + 1], 6) AS lat FROM b, (SELECT unnest(range(0, 5)) k)")
def geojson_export(spark, d):
    """The features as a reader of their text sees them, a row per point."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", geo.box_ring(15 + 0.001 * (k % 400), 73 + 0.001 * (k % 300), 0.02, 0.03).alias("ring"))
    read = scoring.geojson(rows, F.col("ring"), "c_custkey").withColumn("f", F.from_json("feature", _FEATURE))
    points = read.select("c_custkey", F.concat("f.type", F.lit("/"), "f.geometry.type").alias("kind"), F.col("f.properties.c_custkey").alias("property"), F.size("f.geometry.coordinates").alias("rings"), F.posexplode(F.col("f.geometry.coordinates")[0]).alias("point", "at"))
    return points.select("c_custkey", "kind", "property", "rings", "point", F.round(F.col("at")[0], 6).alias("lon"), F.round(F.col("at")[1], 6).alias("lat"))


def _rk4_sql(steps: int, seconds: int) -> str:
    """Runge-Kutta in the eddy, a table per slope."""
    ctes, before = [], "(SELECT ord, lat, lon FROM ais)"
    east, north = "(111000 * cos(radians(lat)))", "111000"
    for k in range(steps):
        for i, dt in enumerate((0, seconds // 2, seconds // 2, seconds)):
            y, x = (f"lat + v{i - 1} * {dt} / {north}", f"lon + u{i - 1} * {dt} / {east}") if i else ("lat", "lon")
            ctes.append(f"p{k}{i} AS (SELECT *, ({x} - 73.2::DOUBLE) * 111000 * cos(radians({y})) dx{i}, ({y} - 15.2::DOUBLE) * 111000 dy{i} FROM {before})")
            inside = f"CASE WHEN sqrt(dx{i} * dx{i} + dy{i} * dy{i}) < 50000 THEN"
            ctes.append(f"k{k}{i} AS (SELECT *, {inside} -5e-1 * dy{i} / 50000 ELSE 0 END u{i}, {inside} 5e-1 * dx{i} / 50000 ELSE 0 END v{i} FROM p{k}{i})")
            before = f"k{k}{i}"
        mean = lambda c: f"({c}0 + 2 * {c}1 + 2 * {c}2 + {c}3) / 6 * {seconds}"
        ctes.append(f"s{k} AS (SELECT ord, lat + {mean('v')} / {north} lat, lon + {mean('u')} / {east} lon FROM {before})")
        before = f"s{k}"
    return f"WITH {AIS_SQL}, {', '.join(ctes)} SELECT ord, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {before}"


@query(_rk4_sql(3, 1800))
def drift_rk4_eddy(spark, d):
    out = drift_steps.advected(ais(spark, d).select("ord", "lat", "lon", "us"), drift_steps.eddy(15.2, 73.2), 1800, 3)
    return out.select("ord", _r("lat"), _r("lon"))


@query()
def drift_ensemble(spark, d):
    """Backward ensembles from a box around each vessel's last report."""
    s = tracks.summaries(ais(spark, d))
    regions = s.select("mmsi", F.array(geo.box_ring(F.col("last_lat"), F.col("last_lon"), 0.02, 0.02)).alias("rings"), F.col("t1").alias("us"))
    request = drift.Request((), 3, 30, 250, drift_steps.eddy(15.2, 73.2), drift_steps.diurnal(5.0, 2.0), seed=7)
    return drift.statistics(drift.drifted(regions, "mmsi", request, 10), "mmsi")


_DIAMOND = [(73.05003, 15.20007), (73.20003, 15.10007), (73.35003, 15.20007), (73.20003, 15.30007), (73.05003, 15.20007)]


@query(f"WITH {AIS_SQL} SELECT ord FROM ais WHERE abs(lon - 73.20003::DOUBLE) / 15e-2 + abs(lat - 15.20007::DOUBLE) / 1e-1 < 1")
def points_in_polygon(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _DIAMOND])
    return ais(spark, d).where(geo.point_in_ring(F.col("lat"), F.col("lon"), ring)).select("ord")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 9999")
def valid_case_numbers(spark, d):
    k = F.col("o_orderkey")
    number = F.concat(F.lit("OT-"), (2020 + k % 7).cast("string"), F.lit("-"), k.cast("string"))
    return table(spark, d, "orders").where(investigation.valid_case_number(number)).select("o_orderkey")


def _investigation(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("mmsi"), F.col("c_name").alias("vessel_name")).where("c_custkey % 2 = 0")
    return investigation.investigate(ais(spark, d), adapters.scenarios(spark, d), _fixed_evidence(spark, d), names)


@query(f"WITH {_PARTS} SELECT case_id, 3::BIGINT AS n_claims, concat('ais-', mmsi, ',detection-001,drift-ensemble-001') AS evidence_ids, round(91e-2 + 73e-2 + total / 100, 5) AS confidence FROM r WHERE rank = 1")
def investigation_report(spark, d):
    r = _investigation(spark, d).report
    total = F.aggregate("claims", F.lit(0.0), lambda s, c: s + c["confidence"])
    return r.select("case_id", F.size("claims").cast("long").alias("n_claims"), F.array_join("evidence_ids", ",").alias("evidence_ids"), F.round(total, 5).alias("confidence"))


@query(f"WITH {_PARTS}, c AS (SELECT case_id, count(*) n FROM r GROUP BY case_id) SELECT case_id, k::BIGINT AS step, ['satellite', 'detection', 'drift', 'candidates', 'evidence', 'report'][k] AS name, CASE k WHEN 4 THEN n WHEN 5 THEN n + 3 END AS n FROM c, (SELECT unnest([1, 2, 3, 4, 5, 6]) k)")
def investigation_steps(spark, d):
    return _investigation(spark, d).steps


_SLICKS = f"""{PIXEL_SQL}, level AS (SELECT *, CASE WHEN greatest(0, least(1, (10 * log10(v + 1e-10) + 25) / 30)) > 8e-1 THEN 9e-1 ELSE 1e-1 END p FROM px), set_px AS (SELECT * FROM level WHERE p > 5e-1), {_labelled_sql("lab", "set_px")}, {_cleaned_sql(5, 20)}, {_labelled_sql("slick", "cleaned")},
sl AS (SELECT scene_id, component, count(*) / 1e2 area, coalesce(avg(p), 5e-1) c FROM slick LEFT JOIN level USING (scene_id, y, x) GROUP BY scene_id, component)"""


@query(f"WITH RECURSIVE {_SLICKS}, z AS (SELECT scene_id, count(*) slicks, sum(area) area_km2, avg(c) confidence FROM sl WHERE area >= 1e-3 GROUP BY scene_id) SELECT scene_id, slicks, round(area_km2, 6) AS area_km2, round(confidence, 6) AS confidence, CASE WHEN confidence >= 8e-1 THEN 'high' WHEN confidence > 3e-1 THEN 'medium' ELSE 'low' END AS level FROM z")
def segmentation(spark, d):
    slicks = raster.segmented(pixels(spark, d), HEIGHT, WIDTH, (100.0, 0.0, 0.0, 0.0, -100.0, 0.0), lambda level: F.when(level > 0.8, F.lit(0.9)).otherwise(F.lit(0.1)), 32, 8, min_area=5, max_hole=20)
    return raster.segmentation_summary(slicks).select("scene_id", "slicks", _r("area_km2"), _r("confidence"), "level")


# ---- fields that vary, in members, and on uneven axes


def _eddy_sql(n: int, seconds: int) -> str:
    """CTEs ``s0`` .. ``s<n>`` of Runge-Kutta steps of an eddy and a daily wind with each member's coefficients; the clock runs back."""
    def velocity(lat: str, lon: str, us: str) -> tuple[str, str]:
        dx, dy = f"(({lon} - 73.2::DOUBLE) * 111000 * cos(radians({lat})))", f"(({lat} - 15.2::DOUBLE) * 111000)"
        near = f"sqrt({dx} * {dx} + {dy} * {dy}) < 50000"
        daily = f"(1 + 3e-1 * sin(2 * pi() * (floor(({us} % 86400000000) / 60000000) / 60 - 6) / 24))"
        return f"c * CASE WHEN {near} THEN -5e-1 * {dy} / 50000 ELSE 0 END + w * 5.0::DOUBLE * {daily}", f"c * CASE WHEN {near} THEN 5e-1 * {dx} / 50000 ELSE 0 END + w * 2.0::DOUBLE * {daily}"

    at = lambda k, dt: (f"(lat + v{k} * {dt} / 111000)", f"(lon + u{k} * {dt} / (111000 * cos(radians(lat))))", f"(us + {dt * 1000000})")
    out = ["s0 AS (SELECT mmsi, ord, m, 8e-1 + 1e-1 * m c, 2e-2 + 5e-3 * m w, lat, lon, us FROM ais, (SELECT unnest([0, 1, 2, 3]) m))"]
    for i in range(n):
        u1, v1 = velocity("lat", "lon", "us")
        src = f"(SELECT *, {u1} u1, {v1} v1 FROM s{i})"
        for k, (of, dt) in enumerate(((1, seconds // 2), (2, seconds // 2), (3, seconds)), 2):
            u, v = velocity(*at(of, dt))
            src = f"(SELECT *, {u} u{k}, {v} v{k} FROM {src})"
        out.append(f"s{i + 1} AS (SELECT mmsi, ord, m, c, w, lat + (v1 + 2 * v2 + 2 * v3 + v4) / 6 * {seconds} / 111000 lat, lon + (u1 + 2 * u2 + 2 * u3 + u4) / 6 * {seconds} / (111000 * cos(radians(lat))) lon, us - {seconds * 1000000} us FROM {src})")
    return ", ".join(out)


def _eddied(spark, d):
    m = ais(spark, d).select("mmsi", "ord", "lat", "lon", "us", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("m"))
    rows = m.withColumns({"c": 0.8 + 0.1 * F.col("m"), "w": 0.02 + 0.005 * F.col("m")})
    velocity = drift_steps.combined(drift_steps.eddy(15.2, 73.2), drift_steps.diurnal(5.0, 2.0), F.col("c"), F.col("w"))
    return drift_steps.advected(rows, velocity, 1800.0, 3, backward=True)


@query(f"WITH {AIS_SQL}, {_eddy_sql(3, 1800)} SELECT ord, m, round(lat, 6) AS lat, round(lon, 6) AS lon, us FROM s3")
def drift_eddy_steps(spark, d):
    return _eddied(spark, d).select("ord", "m", _r("lat"), _r("lon"), "us")


@query(f"WITH {AIS_SQL}, {_eddy_sql(3, 1800)}, e AS (SELECT mmsi, m, count(*) n, least(1, greatest(0, 1 / (1 + stddev_pop(lat) + stddev_pop(lon)))) k FROM s3 GROUP BY mmsi, m), t AS (SELECT mmsi, stddev_pop(lat) a, stddev_pop(lon) b FROM s3 GROUP BY mmsi) SELECT mmsi, count(*) AS ensemble_size, CAST(sum(n) AS BIGINT) AS trajectories, round(avg(k), 6) AS confidence, round(any_value(a), 6) AS lat_std, round(any_value(b), 6) AS lon_std FROM e JOIN t USING (mmsi) GROUP BY mmsi")
def drift_eddy_ensemble(spark, d):
    """The ensemble of four members that each have the same particles and coefficients of their own."""
    out = drift.aggregated(_eddied(spark, d), "mmsi", "m")
    return out.select("mmsi", "ensemble_size", "trajectories", _r("confidence"), _r("lat_std"), _r("lon_std"))


@query(f"WITH {AIS_SQL}, p AS (SELECT ord, (us % 3600000000) / 3600000000.0::DOUBLE t, lat, lon FROM ais) SELECT ord, CASE WHEN t BETWEEN 0 AND 0.9 AND lat BETWEEN 15 AND 15.36 AND lon BETWEEN 73.01 AND 73.4 THEN round(t * lat * lon, 4) ELSE 0 END AS u, CASE WHEN t BETWEEN 0 AND 0.9 AND lat BETWEEN 15 AND 15.36 AND lon BETWEEN 73.01 AND 73.4 THEN round(lat - 2 * lon, 4) ELSE 0 END AS v FROM p")
def field_uneven(spark, d):
    """A field that is linear in each of time, latitude and longitude, which interpolation must give back, on nodes of growing distances."""
    p = ais(spark, d).withColumn("t", (F.col("us") % 3_600_000_000) / 3_600_000_000.0)
    axes = {"t": [0.0, 0.05, 0.4, 0.9], "y": [15 + k * k / 100 for k in range(7)], "x": [73.01, 73.02, 73.05, 73.051, 73.2, 73.4]}
    one = table(spark, d, "region").where("r_regionkey = 0")
    grid = one.select(*[F.array(*[F.lit(v) for v in a]).alias(k) for k, a in axes.items()])
    for k in axes:
        grid = grid.withColumn(k, F.explode(k))
    field = grid.withColumns({"u": F.col("t") * F.col("y") * F.col("x"), "v": F.col("y") - 2 * F.col("x")})
    return drift.gridded_uneven(p, field).select("ord", _r("u", 4), _r("v", 4))


@query(SQL["geo_legs"])
def geo_legs_sql(spark, d):
    """The legs by the engine's functions in SQL."""
    sql_functions.register(spark)
    tracks.with_neighbours(ais(spark, d), "us", "lat", "lon", "cog").createOrReplaceTempView("tidewake_legs")
    at = "prev_lat, prev_lon, lat, lon"
    return spark.sql(f"SELECT ord, round(tw_haversine_km({at}), 6) AS haversine, round(tw_bearing({at}), 5) AS bearing, round(tw_flat_km({at}), 6) AS flat, round(tw_flat_bearing({at}), 5) AS flat_bearing, round(tw_turn(cog, prev_cog), 6) AS turn FROM tidewake_legs WHERE prev_us IS NOT NULL")


# ---- routes as tables

_PLACES = "pl AS (SELECT 15 + 1e-3 * (c_custkey * 37 % 500) plat, 73 + 1e-3 * (c_custkey * 91 % 400) plon FROM customer)"


def _places(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select((15 + 0.001 * (k * 37 % 500)).alias("lat"), (73 + 0.001 * (k * 91 % 400)).alias("lon"))


@query(f"WITH {AIS_SQL}, {_PLACES} SELECT ord, round(min({_hav('lat', 'lon', 'plat', 'plon')}), 6) AS km FROM ais, pl GROUP BY ord")
def nearest_vertex(spark, d):
    return nearest.nearest(ais(spark, d), _places(spark, d)).select("ord", F.round("near_km", 6).alias("km"))


@query(_runs_sql(f"NOT EXISTS (SELECT 1 FROM pl WHERE {_hav('lat', 'lon', 'plat', 'plon')} <= 1.5::DOUBLE)").replace(_WITH, f"{_WITH}, {_PLACES}", 1))
def route_deviation_table(spark, d):
    return nearest.route_deviation(ais(spark, d), _places(spark, d), 1.5).select("mmsi", "pos0", "pos1")


# ---- a hot vessel: half of all reports, worked on in stretches of a day

_HOT_SQL = AIS_SQL.replace("CAST(user_id AS VARCHAR) mmsi", "CASE WHEN event_id % 2 = 0 THEN '7' ELSE CAST(user_id AS VARCHAR) END mmsi")
DAY = 24.0


def _hot(spark, d):
    a = ais(spark, d)
    return a.withColumn("mmsi", F.when(F.col("ord") % 2 == 0, "7").otherwise(F.col("mmsi")))


def _as_hot(name: str) -> str:
    return SQL[name].replace(AIS_SQL, _HOT_SQL)


@query(_as_hot("track_interpolate"))
def hot_interpolate(spark, d):
    out = tracks.interpolate(_hot(spark, d), 60, DAY)
    return out.select("mmsi", "us", _r("lat"), _r("lon"), _r("sog"), _r("heading", 5))


@query(_as_hot("track_fill_gaps"))
def hot_fill_gaps(spark, d):
    out = tracks.fill_gaps(_hot(spark, d), 60, DAY)
    return out.select("mmsi", "us", _r("lat"), _r("lon"), _r("sog"), _r("heading", 5))


@query(_as_hot("stops"))
def hot_stops(spark, d):
    return anomalies.stops(_hot(spark, d), 12.0, 30, DAY).select("mmsi", "pos0", "pos1")


@query(_as_hot("course_change"))
def hot_course_change(spark, d):
    return anomalies.course_change(_hot(spark, d), chunk_hours=DAY).select("mmsi", "pos", _r("turn", 5))


@query(_as_hot("loitering"))
def hot_loitering(spark, d):
    return anomalies.loitering(_hot(spark, d), chunk_hours=DAY)


# ---- paths in boxes and circles, by a stored index

_LEG_SQL = f"{_WITH}, leg AS (SELECT mmsi, pos, us us0, n_us us1, lat lat0, lon lon0, n_lat lat1, n_lon lon1, n_lon - lon dx, n_lat - lat dy FROM pos WHERE n_us IS NOT NULL)"


def _clip_sql(x0: str, y0: str, x1: str, y1: str) -> tuple[str, str]:
    """Where a leg's line enters and leaves a box: each side that it faces bounds the one, each that it has behind it the other."""
    t = lambda a, d, v: f"CASE WHEN {d} <> 0 THEN ({v} - {a}) / {d} END"
    first = [f"CASE WHEN {d} > 0 THEN {t(a, d, low)} WHEN {d} < 0 THEN {t(a, d, high)} WHEN {a} < {low} OR {a} > {high} THEN 2 ELSE 0 END" for a, d, low, high in (("lon0", "dx", x0, x1), ("lat0", "dy", y0, y1))]
    last = [f"CASE WHEN {d} > 0 THEN {t(a, d, high)} WHEN {d} < 0 THEN {t(a, d, low)} ELSE 1 END" for a, d, low, high in (("lon0", "dx", x0, x1), ("lat0", "dy", y0, y1))]
    return f"greatest(0, {', '.join(first)})", f"least(1, {', '.join(last)})"


def _stored(spark, d):
    path = fresh(spark, "legs")
    track_index.write(ais(spark, d), path, 16)
    return track_index.read(spark, path)


@query(f"{_LEG_SQL}, c AS (SELECT *, {_clip_sql('73.02::DOUBLE', '15.03::DOUBLE', '73.09::DOUBLE', '15.08::DOUBLE')[0]} f, {_clip_sql('73.02::DOUBLE', '15.03::DOUBLE', '73.09::DOUBLE', '15.08::DOUBLE')[1]} l FROM leg) SELECT mmsi, pos, CAST(round((us0 + f * (us1 - us0)) / 1e6::DOUBLE, 2) AS DOUBLE) AS enters FROM c WHERE f <= l")
def paths_in_box(spark, d):
    out = track_index.through_box(_stored(spark, d), 73.02, 15.03, 73.09, 15.08)
    return out.select("mmsi", "pos", F.round(F.col("enters_us") / 1e6, 2).alias("enters"))


_WITHIN = "cos(radians(15.1::DOUBLE))"


@query(f"{_LEG_SQL}, k AS (SELECT mmsi, pos, (lon0 - 73.05::DOUBLE) * 111 * {_WITHIN} x, (lat0 - 15.1::DOUBLE) * 111 y, dx * 111 * {_WITHIN} u, dy * 111 v FROM leg), t AS (SELECT *, CASE WHEN u * u + v * v > 0 THEN greatest(0, least(1, -(x * u + y * v) / (u * u + v * v))) ELSE 0 END t FROM k), e AS (SELECT mmsi, pos, sqrt(pow(x + t * u, 2) + pow(y + t * v, 2)) km FROM t) SELECT mmsi, pos, round(km, 6) AS km FROM e WHERE km <= 2")
def paths_within(spark, d):
    return track_index.within(_stored(spark, d), 15.1, 73.05, 2).select("mmsi", "pos", _r("km"))


@query(f"{_LEG_SQL}, b AS (SELECT n_nationkey AS box_id, 73 + 2e-2 * n_nationkey x0, 15 + 2e-2 * n_nationkey y0 FROM nation) SELECT box_id, mmsi, count(*) AS legs FROM b, leg WHERE {_clip_sql('x0', 'y0', 'x0 + 1e-2', 'y0 + 2e-2')[0]} <= {_clip_sql('x0', 'y0', 'x0 + 1e-2', 'y0 + 2e-2')[1]} GROUP BY box_id, mmsi")
def paths_in_boxes(spark, d):
    k = F.col("n_nationkey")
    boxes = table(spark, d, "nation").select(k.alias("box_id"), (73 + 0.02 * k).alias("min_lon"), (15 + 0.02 * k).alias("min_lat")).withColumns({"max_lon": F.col("min_lon") + 0.01, "max_lat": F.col("min_lat") + 0.02})
    return track_index.through_boxes(_stored(spark, d), boxes, 0.05).groupBy("box_id", "mmsi").agg(F.count("*").alias("legs"))


from tidewake.plans import scenes  # noqa: E402, F401  registers its queries
