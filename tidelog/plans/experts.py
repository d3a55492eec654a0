"""Queries over resolution, priors, physics, analogues, routes, corridors and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import EARTH_KM, EARTH_M, EARTH_NM, PriorConfig
from tidelog.functions import geo, numeric
from tidelog.operators import experts, joins, routes, sessions, states
from tidelog.plans.registry import query
from tidelog.plans.scalars import _bearing, _hav
from tidelog.plans.temporal import transition_rows
from tidelog.sources.domain import DECISIONS_SQL, POSITIONS_SQL, decisions, positions
from tidelog.session import shared_folder, written
from tidelog.sources.tables import table


def destination_texts(spark, sf) -> DataFrame:
    """Free-text destinations: names, codes, routes and noise, from the parts and nations."""
    x = table(spark, sf, "part").select("p_partkey", "p_name", F.concat(F.lit("NATION_"), (F.col("p_partkey") % 40).cast("string")).alias("n"))
    k = F.col("p_partkey") % 8
    t = (
        F.when(k == 0, F.col("n")).when(k == 1, F.concat(F.lit("home > "), F.lower("n"))).when(k == 2, F.concat(F.lit("NN"), F.lpad((F.col("p_partkey") % 40).cast("string"), 3, "0")))
        .when(k == 3, "FOR ORDERS").when(k == 4, "not available").when(k == 5, F.col("p_name")).when(k == 6, F.concat(F.lit("Łódź, "), F.col("n"))).otherwise(F.when(F.col("p_partkey") % 3 == 0, "AB9Z1").when(F.col("p_partkey") % 3 == 1, "In Port").otherwise("Mãltâ"))
    )
    return x.select("p_partkey", t.alias("text"))


def catalog(spark, sf) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select(F.concat(F.lit("NN"), F.lpad(n, 3, "0")).alias("code"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"), F.concat(F.lit("LAND "), n, F.lit(";COAST "), n).alias("aliases"), F.col("n_regionkey").cast("string").alias("country"))


_TEXTS_SQL = """r AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'NATION_' || p_partkey % 40 WHEN 1 THEN 'home > nation_' || p_partkey % 40 WHEN 2 THEN 'NN' || lpad((p_partkey % 40)::VARCHAR, 3, '0') WHEN 3 THEN 'FOR ORDERS'
  WHEN 4 THEN 'not available' WHEN 5 THEN p_name WHEN 6 THEN 'Łódź, NATION_' || p_partkey % 40 ELSE ['AB9Z1', 'In Port', 'Mãltâ'][p_partkey % 3 + 1] END AS text FROM part),
 t AS (SELECT DISTINCT text, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(upper(text)), '\\s*>\\s*', '>', 'g'), '[,_;|]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normal FROM r),
 u AS (SELECT *, string_split(normal, '>')[-1] AS terminal, contains(normal, '>') AS is_route FROM t), k AS (SELECT *, regexp_replace(terminal, '[^A-Z0-9]', '', 'g') AS compact,
  CASE WHEN terminal = 'NOT AVAILABLE' THEN 'unknown' WHEN terminal = 'FOR ORDERS' THEN 'for_orders' WHEN terminal = 'IN PORT' THEN 'non_specific' WHEN terminal = 'MALTA' THEN 'ambiguous_geography'
  WHEN regexp_full_match(terminal, 'NN0[0-9]{2}') AND right(terminal, 2)::INT < 25 THEN 'exact_code' WHEN regexp_full_match(terminal, 'NATION [0-9]+') AND string_split(terminal, ' ')[2]::INT < 25 THEN 'alias'
  WHEN regexp_full_match(regexp_replace(terminal, '[^A-Z0-9]', '', 'g'), '[A-Z]{2}[A-Z0-9]{3}') THEN 'code_like_unverified' ELSE 'unresolved_text' END AS kind FROM u),
 f AS (SELECT *, CASE kind WHEN 'exact_code' THEN terminal WHEN 'alias' THEN 'NN' || lpad(string_split(terminal, ' ')[2], 3, '0') END AS found FROM k),
 d AS (SELECT text, is_route, CASE kind WHEN 'unknown' THEN 'UNKNOWN' WHEN 'for_orders' THEN 'FOR_ORDERS' WHEN 'non_specific' THEN 'NON_SPECIFIC' WHEN 'ambiguous_geography' THEN 'AMBIGUOUS:MALTA' ELSE coalesce(found, CASE WHEN kind = 'code_like_unverified' THEN compact END, 'TEXT:' || terminal) END AS canonical,
  CASE WHEN is_route AND kind IN ('alias', 'exact_code') THEN 'route_' || kind ELSE kind END AS method, CASE kind WHEN 'alias' THEN 0.99 WHEN 'code_like_unverified' THEN 0.7 WHEN 'unresolved_text' THEN 0 ELSE 1 END::DOUBLE AS confidence,
  found IS NOT NULL AS is_resolved, kind IN ('unknown', 'for_orders', 'non_specific') AS is_vague, coalesce(n_regionkey::VARCHAR, CASE WHEN kind = 'code_like_unverified' THEN left(compact, 2) END) AS country FROM f LEFT JOIN nation ON found = 'NN' || lpad(n_nationkey::VARCHAR, 3, '0'))"""


@query(f"WITH {_TEXTS_SQL} SELECT * FROM d")
def destination_resolver(spark, sf):
    x = experts.resolve(destination_texts(spark, sf), catalog(spark, sf), fuzzy=False)
    return x.select("text", "is_route", "canonical", "method", "confidence", "is_resolved", "is_vague", "country")


@query()
def destination_resolver_fuzzy(spark, sf):
    return experts.resolve(destination_texts(spark, sf), catalog(spark, sf))


_LEVEL = """, s{i} AS (SELECT f.fold AS f, {key} AS k, median(target_h) AS m, count(*) AS n FROM folds f JOIN rows r ON r.fold <> f.fold GROUP BY 1, 2),
 p{i} AS (SELECT p.* EXCLUDE (pred, level), CASE WHEN n >= 3 THEN least(hi, greatest(lo, n / (n + 10.0) * m + (1 - n / (n + 10.0)) * pred)) ELSE pred END AS pred, CASE WHEN n >= 3 THEN {i} ELSE level END AS level FROM p{j} p LEFT JOIN s{i} ON f = fold AND k = {key})"""


@query(
    f"WITH {DECISIONS_SQL}, rows AS (SELECT *, destination || chr(31) || ship_type AS destination_type FROM dec), folds AS (SELECT DISTINCT fold FROM rows), g AS (SELECT f.fold AS gf, median(target_h) AS m, quantile_cont(target_h, 0.01) AS lo, quantile_cont(target_h, 0.99) AS hi FROM folds f JOIN rows r ON r.fold <> f.fold GROUP BY 1), p0 AS (SELECT key, fold, destination, destination_type, lo, hi, m AS pred, 0 AS level FROM rows JOIN g ON gf = fold)"
    + _LEVEL.format(i=1, j=0, key="destination")
    + _LEVEL.format(i=2, j=1, key="destination_type")
    + " SELECT key, round(pred, 5) AS prediction, level FROM p2"
)
def hierarchical_prior(spark, sf):
    rows = decisions(spark, sf).withColumn("destination_type", F.concat_ws("\u001f", "destination", "ship_type"))
    return experts.hierarchical_prior(rows, "target_h", PriorConfig()).select("key", F.round("prediction", 5).alias("prediction"), "level")




@query(f"""WITH {POSITIONS_SQL}, v AS (SELECT owner, id, recorded_at, {_hav(EARTH_NM, "lat", "lon", "37.5e0", "15.1e0")} AS nm, sog_raw, lag(sog_raw) OVER (PARTITION BY owner ORDER BY recorded_at, id) AS before, k FROM pos)
 SELECT id, nm >= 1 AND coalesce(greatest(sog_raw, before), 0) >= 2 AS eligible, round(nm * least(1.35, greatest(1.0, 1 + k / 300.0)) / least(25.0, greatest(2.0, CASE WHEN sog_raw >= 2 THEN sog_raw ELSE coalesce(before, 2.0) END)), 5) AS hours FROM v""")
def physics_eta(spark, sf):
    x = positions(spark, sf).withColumns({"nm": geo.haversine(F.col("lat"), F.col("lon"), F.lit(37.5), F.lit(15.1), EARTH_NM), "before": F.lag("sog_raw").over(sessions.by_owner())})
    factor = numeric.bounded_ratio(1 + F.col("k") / 300.0, F.lit(1.0), 1.0, 1.35, 1.0)
    return x.select("id", experts.physics_eligible(F.lit(True), F.lit(1.0), F.col("nm"), F.col("sog_raw"), F.col("before")).alias("eligible"), F.round(experts.physics(F.col("nm"), F.col("sog_raw"), F.col("before"), factor), 5).alias("hours"))


def _trailing(minutes: int) -> str:
    return f"(PARTITION BY owner ORDER BY epoch_us(recorded_at) RANGE BETWEEN {minutes * 60_000_000} PRECEDING AND CURRENT ROW)"


_TURN = f"abs((({_bearing('lat', 'lon', '37.5e0', '15.1e0')} - cog_raw + 540.0) % 360.0) - 180.0)"


@query(f"""WITH {POSITIONS_SQL}, s AS (SELECT *, {_hav(EARTH_KM, "lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS km FROM pos WINDOW w AS (PARTITION BY owner ORDER BY recorded_at)),
 f AS (SELECT id, lat, lon, cog_raw, median(sog_raw) OVER a AS s1, median(sog_raw) OVER b AS s2, sum(km) OVER a AS t1, sum(km) OVER b AS t2, first_value(lat) OVER a AS la, first_value(lon) OVER a AS lo, first_value(lat) OVER b AS lb, first_value(lon) OVER b AS lp FROM s WINDOW a AS {_trailing(18_000)}, b AS {_trailing(36_000)}),
 g AS (SELECT *, greatest(s1, s2) AS recent, {_hav(EARTH_NM, "lat", "lon", "37.5e0", "15.1e0")} AS nm FROM f)
 SELECT id, round(nm, 5) AS distance_nm, round({_bearing("lat", "lon", "37.5e0", "15.1e0")}, 5) AS bearing_deg, round({_TURN}, 5) AS alignment_deg, round(least(2, greatest(1, coalesce(t1 / greatest({_hav(EARTH_KM, "la", "lo", "lat", "lon")}, 1), 1))), 5) AS sinuosity_180,
  round(least(2, greatest(1, coalesce(t2 / greatest({_hav(EARTH_KM, "lb", "lp", "lat", "lon")}, 1), 1))), 5) AS sinuosity_360, round(recent, 5) AS recent_kn, nm >= 1 AND recent >= 2 AND id % 3 <> 0 AS eligible FROM g""")
def physics_features(spark, sf):
    """Features of the ways of the last 300 and 600 hours, as the events are that far apart, in place of 180 and 360 minutes."""
    x = joins.trailing_motion(positions(spark, sf), "owner", "recorded_at", {"180": 18_000, "360": 36_000}, EARTH_KM)
    x = x.withColumns({"cog": F.col("cog_raw"), "place_lat": F.lit(37.5), "place_lon": F.lit(15.1), "is_resolved": F.col("id") % 3 != 0, "confidence": F.lit(1.0)})
    x = experts.physics_features(x, EARTH_NM)
    names = ["distance_nm", "bearing_deg", "alignment_deg", "sinuosity_180", "sinuosity_360", "recent_kn"]
    return x.select("id", *(F.round(c, 5).alias(c) for c in names), "eligible")


@query(f"""WITH {DECISIONS_SQL}, t AS (SELECT *, target_h - pred_a AS r FROM dec WHERE price > 100000), f AS (SELECT DISTINCT fold FROM dec), g AS (SELECT f.fold AS gf, median(r) AS g FROM f JOIN t ON t.fold <> f.fold GROUP BY 1), d AS (SELECT f.fold AS df, destination AS k, median(r) AS m, count(*) AS n FROM f JOIN t ON t.fold <> f.fold GROUP BY 1, 2)
 SELECT key, round(greatest(0, pred_a + coalesce(w * m, 0) + (1 - w) * coalesce(g, 0)), 5) AS corrected FROM dec LEFT JOIN g ON gf = fold LEFT JOIN d ON df = fold AND k = destination, LATERAL (SELECT CASE WHEN n >= 3 THEN n / (n + 10.0) ELSE 0 END AS w)""")
def residual_correction(spark, sf):
    rows = decisions(spark, sf).withColumn("eligible", F.col("price") > 100_000)
    return experts.residual_corrected(rows, "pred_a", "target_h", "eligible", "destination").select("key", F.round("corrected", 5).alias("corrected"))


@query()
def route_analogue(spark, sf):
    """Resampled tracks of owners whose id is divisible by 100, against those of all; the last value stands for the target."""
    p = positions(spark, sf)
    target = p.groupBy("owner").agg(F.max_by("sog_raw", F.struct("recorded_at", "id")).alias("target"), (F.max("owner") % 6).alias("gate"))
    x = experts.trajectories(p, "owner", "recorded_at", ["lon", "lat"], 12).join(target, "owner")
    q = x.where("owner % 100 = 0").select(*(F.col(a).alias(b) for a, b in (("owner", "q_id"), ("owner", "q_owner"), ("gate", "q_gate"), ("points", "q_points"))))
    m = x.select(*(F.col(a).alias(f"m_{a}") for a in ("owner", "gate", "points", "target")))
    return experts.analogues(q, m, "gate", 5)


_ROUTES = [(0, 0, 36.6, 14.6), (0, 1, 36.9, 14.8), (0, 2, 37.1, 15.2), (1, 0, 37.4, 15.4), (1, 1, 37.2, 15.1), (1, 2, 37.0, 15.05), (1, 3, 36.8, 14.9)]
_ROUTE_SQL = "routes(route, seq, lat, lon) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}, {c}e0, {d}e0)" for a, b, c, d in _ROUTES) + ")"


@query(f"""WITH {POSITIONS_SQL}, {_ROUTE_SQL}, r1 AS (SELECT *, (lon - 0.0) * 111.32 * cos(radians(37.0)) AS ax, (lat - 37.0) * 111.32 AS ay FROM routes), r2 AS (SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS by_ FROM r1 WINDOW w AS (PARTITION BY route ORDER BY seq)),
 r3 AS (SELECT *, sqrt((bx - ax)**2 + (by_ - ay)**2) AS len FROM r2 WHERE bx IS NOT NULL), r4 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY route ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, max_by(bx, seq) OVER (PARTITION BY route) AS zx, max_by(by_, seq) OVER (PARTITION BY route) AS zy FROM r3),
 p AS (SELECT id, (lon - 0.0) * 111.32 * cos(radians(37.0)) AS x, (lat - 37.0) * 111.32 AS y FROM pos), j AS (SELECT *, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / len**2)) AS t FROM p, r4),
 k AS (SELECT *, sqrt((x - ax - t * (bx - ax))**2 + (y - ay - t * (by_ - ay))**2) AS c FROM j) SELECT id, route, round(c, 5) AS cross_km, round(greatest(sqrt((x - zx)**2 + (y - zy)**2), c + (1 - t) * len + rest), 5) AS remaining_km
 FROM (SELECT *, row_number() OVER (PARTITION BY id, route ORDER BY c, seq) AS n FROM k) WHERE n = 1""")
def polyline_projection(spark, sf):
    lines = spark.createDataFrame(_ROUTES, "route bigint, seq int, lat double, lon double")
    x = experts.along_route(positions(spark, sf).select("id", "lat", "lon"), lines, "id", 37.0)
    return x.withColumns({"cross_km": F.round("cross_km", 5), "remaining_km": F.round("remaining_km", 5)})


@query()
def corridor_paths(spark, sf):
    """Least-time paths from where each owner's first transition began to where its last one ended, over the transitions seen before the last one."""
    p, t = states.clean(positions(spark, sf)), transition_rows(spark, sf)
    w = Window.partitionBy("owner").orderBy("recorded_at", "id")
    places = p.select("id", F.lag("lat").over(w).alias("lat"), F.lag("lon").over(w).alias("lon"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    x, at = t.join(places, "id"), F.struct("recorded_at", "id")
    first, last = (lambda c: F.min_by(c, at).alias(c)), (lambda c: F.max_by(c, at).alias(c))
    ends = x.groupBy(F.col("owner").alias("q_id")).agg(first("lat"), first("lon"), last("to_lat"), last("to_lon"), F.max_by("speed", at).alias("recent_kn"), F.max("recorded_at").alias("asked_at"))
    edges = t.select("from_cell", "to_cell", F.col("recorded_at").alias("seen_at"), F.col("step_nm").alias("nm"), F.col("speed").alias("kn"))
    return experts.shortest_paths(ends, edges)


@query()
def stop_clusters(spark, sf):
    shared_folder(spark)
    p = positions(spark, sf).where("sog_raw < 12").groupBy(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).agg(F.min("id").alias("id"))
    return experts.stop_clusters(p, "id", 250.0, 3, EARTH_M)


@query()
def error_mixture(spark, sf):
    x = decisions(spark, sf).select("key", (F.col("pred_a") - F.col("target_h")).alias("e"))
    return spark.createDataFrame(experts.mixture(x, "key", "e", 2))


@query("""SELECT owner, id FROM (SELECT user_id AS owner, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), (SELECT 1) WHERE list_contains([CAST(floor(i * (n - 1) / 7) AS BIGINT) FOR i IN range(8)], r)""")
def window_sampler(spark, sf):
    x = table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("recorded_at"))
    return experts.window_sampler(x, "owner", "recorded_at").select("owner", "id")


@query(f"""WITH {POSITIONS_SQL}, l AS (SELECT owner, max(recorded_at) AS last_at FROM pos GROUP BY 1), g AS (SELECT *, date_trunc('hour', last_at) - INTERVAL (hour(last_at) % 6) HOUR AS top FROM l),
 h AS (SELECT owner, last_at, unnest(generate_series(top - INTERVAL 90 HOUR, top, INTERVAL 6 HOUR)) AS tick FROM g)
 SELECT h.owner, tick, count(p.id) AS n, round((epoch_us(max(p.recorded_at)) - epoch_us(min(p.recorded_at))) / 3.6e9, 5) AS span_h, round((epoch_us(last_at) - epoch_us(tick)) / 3.6e9, 5) AS label_h
 FROM h JOIN pos p ON p.owner = h.owner AND p.recorded_at > tick - INTERVAL 48 HOUR AND p.recorded_at <= tick GROUP BY h.owner, tick, last_at HAVING count(p.id) >= 3 AND epoch_us(max(p.recorded_at)) - epoch_us(min(p.recorded_at)) >= 43200e6""")
def memory_snapshots(spark, sf):
    x = experts.memory_snapshots(positions(spark, sf).select("owner", "id", "recorded_at"), 6, 16, 48, 3, 12.0)
    return x.select("owner", "tick", "n", F.round("span_h", 5).alias("span_h"), F.round("label_h", 5).alias("label_h"))


@query()
def route_model(spark, sf):
    """Where owners were last, by prototypes and paths that the other owners' crossings of rings make."""
    gate, p = (37.0, 15.0), positions(spark, sf)
    crossings = sessions.ring_crossings(p, *gate, [10.0, 20.0, 30.0, 40.0, 50.0], 5 * 86_400).withColumnRenamed("owner", "call")
    prototypes, paths = routes.fit(written(crossings.select("call", "level_km", "lat", "lon")), gate)
    at = F.struct("recorded_at", "id")
    last = p.groupBy("owner").agg(F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon")).select(F.col("owner").alias("key"), F.col("owner").alias("call"), "lat", "lon")
    x = routes.predict(written(last), written(prototypes), written(paths), gate)
    return x.select("key", "family", "kind", *(F.round(c, 5).alias(c) for c in ("prototype_km", "prototype_cross_km", "knn_km", "knn_cross_km")), "knn_used", "knn_calls")


@query("""SELECT key, owner, round(hours_since_last, 5) AS hours_since_last, n_before, round(spent_before, 2) AS spent_before, part FROM (SELECT o_orderkey AS key, o_custkey AS owner, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w)) / 3.6e9 AS hours_since_last, row_number() OVER w - 1 AS n_before,
  coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'calibration' ELSE 'final' END AS part
  FROM orders, LATERAL (SELECT CAST(('0x' || substr(sha256('ref:' || o_custkey), 1, 8)) AS BIGINT) % 100 AS b) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def reference_rows(spark, sf):
    from tidelog.functions import hashing, times

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("owner"), F.round(times.hours_between(F.lag("o_orderdate").over(w), F.col("o_orderdate")), 5).alias("hours_since_last"),
        (F.row_number().over(w) - 1).cast("bigint").alias("n_before"), F.round(F.coalesce(before, F.lit(0.0)), 2).alias("spent_before"), hashing.split("ref", F.col("o_custkey")).alias("part"),
    )
