"""Queries over ordered observations of owners: states, episodes, sessions, crossings, folds by time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.config import CrossingConfig, StateConfig
from tidelog.operators import folds, quantiles, sessions, states
from tidelog.plans.registry import query
from tidelog.plans.scalars import _hav, CLEAN_SQL
from tidelog.config import EARTH_KM, EARTH_M, EARTH_NM
from tidelog.sources.domain import POSITIONS_SQL, positions
from tidelog.sources.tables import table

#: The test log has hours, not seconds, between observations.
SLOW = StateConfig(gap_s=43_200, turn_max_gap_s=43_200, jump_max_gap_s=43_200, jump_kn=40, stale_medium_s=1800, stale_high_s=3600, conflict_step_kn=1.0, slow_kn=20, stop_enter_kn=5)

_DT = "(epoch_us(recorded_at) - epoch_us(lag(recorded_at) OVER w)) / 1e6"
_STEP = _hav(EARTH_M, "plat", "plon", "lat", "lon")
STATES_SQL = (
    CLEAN_SQL
    + f""", s1 AS (SELECT *, {_DT} AS dt_s, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(sog_clean) OVER w AS prev_sog,
  abs((cog_clean - lag(cog_clean) OVER w + 540.0) % 360.0 - 180.0) AS cog_delta, row_number() OVER w = 1 AS is_first,
  (row(lat, lon, sog_clean, cog_clean, heading_clean, nav_clean) IS NOT DISTINCT FROM lag(row(lat, lon, sog_clean, cog_clean, heading_clean, nav_clean)) OVER w) AS same
  FROM cl WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 s2 AS (SELECT *, {_STEP} AS step_m, is_first OR NOT same AS changed FROM s1),
 s3 AS (SELECT *, CASE WHEN dt_s > 0 THEN step_m / dt_s * 1.9438444924406 END AS implied_kn,
  (epoch_us(recorded_at) - epoch_us(max(CASE WHEN changed THEN recorded_at END) OVER w)) / 1e6 AS state_age_s FROM s2 WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 s4 AS (SELECT *, coalesce(step_m <= 1.0, false) AND NOT is_first AS repeated, coalesce(sog_clean >= 2 AND implied_kn <= 1.0 AND dt_s > 0 AND dt_s <= 43200, false) AS conflict,
  coalesce(implied_kn > 40 AND dt_s > 0 AND dt_s <= 43200, false) AS jump, coalesce(dt_s > 43200, false) AS gap FROM s3),
 s5 AS (SELECT *, coalesce(sog_clean <= 5 AND implied_kn <= 5 AND dt_s > 0 AND NOT jump, false) AS stopped,
  coalesce(sog_clean > 5 AND sog_clean < 20 AND implied_kn < 20 AND dt_s > 0 AND NOT jump, false) AS slow,
  coalesce(sog_clean >= 3 AND implied_kn >= 0.5 AND dt_s > 0 AND NOT jump, false) AS moving,
  coalesce(cog_delta >= 25 AND sog_clean >= 1.5 AND prev_sog >= 1.5 AND dt_s > 0 AND NOT jump AND dt_s <= 43200, false) AS turning FROM s4),
 s6 AS (SELECT *, stopped AND (NOT lag(stopped, 1, false) OVER w OR gap) AS stopped_start, NOT stopped AND lag(stopped, 1, false) OVER w AS stopped_end,
  slow AND (NOT lag(slow, 1, false) OVER w OR gap) AS slow_start, NOT slow AND lag(slow, 1, false) OVER w AS slow_end FROM s5 WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 s7 AS (SELECT *, CASE WHEN stopped THEN coalesce((epoch_us(recorded_at) - epoch_us(max(CASE WHEN stopped_start THEN recorded_at END) OVER w)) / 1e6, 0) ELSE 0 END AS stopped_s,
  CASE WHEN slow THEN coalesce((epoch_us(recorded_at) - epoch_us(max(CASE WHEN slow_start THEN recorded_at END) OVER w)) / 1e6, 0) ELSE 0 END AS slow_s,
  coalesce(sog_clean <= 5 AND nav_clean IN (1, 5), false) AS stationary FROM s6 WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 st AS (SELECT *, CASE WHEN NOT stationary AND (conflict OR coalesce(state_age_s >= 3600 AND sog_clean > 1, false)) THEN 'HIGH'
  WHEN NOT stationary AND ((NOT changed AND state_age_s >= 1800) OR (repeated AND coalesce(sog_clean > 5, false))) THEN 'MEDIUM' ELSE 'LOW' END AS stale_risk,
  CASE WHEN jump THEN 'POSITION_JUMP' WHEN conflict THEN 'KINEMATIC_CONFLICT' WHEN stopped THEN 'STOPPED' WHEN slow THEN 'SLOW_MOTION' WHEN moving THEN 'MOVING' ELSE 'UNKNOWN' END AS motion_state,
  concat_ws(';', CASE WHEN stopped_start THEN 'STOP_START' END, CASE WHEN stopped_end THEN 'STOP_END' END, CASE WHEN slow_start THEN 'SLOW_START' END, CASE WHEN slow_end THEN 'SLOW_END' END,
  CASE WHEN turning THEN 'TURN' END, CASE WHEN gap THEN 'OBS_GAP' END, CASE WHEN conflict THEN 'KIN_CONFLICT' END, CASE WHEN jump THEN 'POS_JUMP' END) AS events FROM s7)"""
)


def state_rows(spark, sf):
    return states.states(positions(spark, sf), SLOW)


@query(STATES_SQL + " SELECT id, motion_state, stale_risk, events, round(stopped_s, 3) AS stopped_s, round(slow_s, 3) AS slow_s, round(state_age_s, 3) AS age_s, round(implied_kn, 4) AS implied_kn FROM st")
def causal_states(spark, sf):
    return state_rows(spark, sf).select("id", "motion_state", "stale_risk", "events", F.round("stopped_s", 3).alias("stopped_s"), F.round("slow_s", 3).alias("slow_s"), F.round("state_age_s", 3).alias("age_s"), F.round("implied_kn", 4).alias("implied_kn"))


@query(STATES_SQL + " SELECT motion_state, stale_risk, count(*) AS n, count(DISTINCT owner) AS owners, round(avg(sog_clean), 6) AS mean_sog FROM st GROUP BY 1, 2")
def causal_states_summary(spark, sf):
    return state_rows(spark, sf).groupBy("motion_state", "stale_risk").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"), F.round(F.avg("sog_clean"), 6).alias("mean_sog"))


@query(CLEAN_SQL + " SELECT count(*) AS n, round(avg((sog_clean IS NOT NULL)::INT), 6) AS sog_valid, round(avg((cog_clean IS NOT NULL)::INT), 6) AS cog_valid, sum((heading_clean IS NULL)::INT)::BIGINT AS heading_missing, sum((nav_clean IS NULL)::INT)::BIGINT AS nav_missing, sum((sog_raw > 102.2)::INT)::BIGINT AS sog_over FROM cl")
def sentinel_shares(spark, sf):
    x = states.clean(positions(spark, sf))
    valid = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 6)
    return x.agg(F.count("*").alias("n"), valid("sog_clean").alias("sog_valid"), valid("cog_clean").alias("cog_valid"), F.count_if(F.col("heading_clean").isNull()).alias("heading_missing"), F.count_if(F.col("nav_clean").isNull()).alias("nav_missing"), F.count_if(F.col("sog_raw") > 102.2).alias("sog_over"))


@query(STATES_SQL + """ SELECT owner, run, n, started_at, ended_at, seconds FROM (SELECT owner, run, count(*) AS n, min(recorded_at) AS started_at, max(recorded_at) AS ended_at,
  round((epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 1e6, 3) AS seconds FROM (SELECT *, sum(edge) OVER (PARTITION BY owner ORDER BY recorded_at, id)::BIGINT AS run FROM
  (SELECT *, (moving AND NOT lag(moving, 1, false) OVER (PARTITION BY owner ORDER BY recorded_at, id))::INT AS edge FROM st)) WHERE moving GROUP BY 1, 2) WHERE n >= 2""")
def run_islands(spark, sf):
    return states.islands(state_rows(spark, sf), "moving", 2).withColumn("seconds", F.round("seconds", 3))


@query(f"""WITH {POSITIONS_SQL} SELECT owner, session, count(*) AS n, min(recorded_at) AS started_at, max(recorded_at) AS ended_at FROM (SELECT *, sum(n) OVER (PARTITION BY owner ORDER BY recorded_at, id)::BIGINT AS session
  FROM (SELECT *, CASE WHEN (epoch_us(recorded_at) - epoch_us(lag(recorded_at) OVER (PARTITION BY owner ORDER BY recorded_at, id))) / 3.6e9 <= 6 THEN 0 ELSE 1 END AS n FROM pos)) GROUP BY 1, 2""")
def gap_sessions(spark, sf):
    return sessions.gap_sessions(positions(spark, sf), 6.0)


_PAIRS = """pairs AS (SELECT owner, session, min(CASE WHEN o THEN recorded_at END) AS inbound_at, max(CASE WHEN c THEN recorded_at END) AS outbound_at FROM
  (SELECT *, sum(o::INT) OVER (PARTITION BY owner ORDER BY recorded_at, id)::BIGINT AS session FROM (SELECT *, i AND NOT coalesce(p, false) AS o, NOT i AND coalesce(p, false) AS c FROM
  (SELECT *, lag(i) OVER (PARTITION BY owner ORDER BY recorded_at, id) AS p FROM (SELECT *, event_type = 'signup' AS i FROM pos WHERE event_type IN ('signup', 'purchase')))) WHERE o OR c) GROUP BY 1, 2)"""


@query(f"WITH {POSITIONS_SQL}, {_PAIRS} SELECT * FROM pairs")
def session_pairing(spark, sf):
    return sessions.pair_sessions(positions(spark, sf))


_VISITS = """visits AS (SELECT owner, visit, min(inbound_at) AS inbound_at, max_by(outbound_at, session) AS o, arg_max_null(outbound_at, session) AS outbound_at, count(*) - 1 AS merges FROM
  (SELECT *, sum(n) OVER (PARTITION BY owner ORDER BY session)::BIGINT AS visit FROM (SELECT *, CASE WHEN g >= 0 AND g <= 24 THEN 0 ELSE 1 END AS n FROM
  (SELECT *, (epoch_us(inbound_at) - epoch_us(lag(outbound_at) OVER (PARTITION BY owner ORDER BY session))) / 3.6e9 AS g FROM pairs))) GROUP BY 1, 2)"""


@query(f"WITH {POSITIONS_SQL}, {_PAIRS}, {_VISITS} SELECT owner, visit, inbound_at, outbound_at, merges FROM visits")
def hysteresis_merge(spark, sf):
    return sessions.merge_sessions(sessions.pair_sessions(positions(spark, sf)), 24.0)


@query(f"""WITH {POSITIONS_SQL}, {_PAIRS}, {_VISITS}, seen AS (SELECT owner, max(recorded_at) AS seen_at FROM pos GROUP BY 1) SELECT owner, visit, coalesce(outbound_at IS NULL
  AND (epoch_us((SELECT max(recorded_at) FROM pos)) - epoch_us(seen_at)) / 1e6 <= 43200, false) AS right_censored, CASE WHEN outbound_at IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status FROM visits JOIN seen USING (owner)""")
def censored_visits(spark, sf):
    p = positions(spark, sf)
    seen = p.groupBy("owner").agg(F.max("recorded_at").alias("seen_at"))
    end = seen.agg(F.max("seen_at").alias("end"))
    visits = sessions.merge_sessions(sessions.pair_sessions(p), 24.0).crossJoin(F.broadcast(end))
    x = sessions.censored(visits, seen, F.col("end"), 720)
    return x.select("owner", "visit", "right_censored", F.when(F.col("outbound_at").isNull(), "OPEN").otherwise("CLOSED").alias("status"))


GATE = CrossingConfig(14.7013, 37.0031, 15.3017, 37.0211, 15.0, 38.0, max_gap_s=86_400, good_gap_s=14_400, fair_gap_s=43_200)
_SIDE = "((15.3017 - 14.7013) * ({y} - 37.0031) - (37.0211 - 37.0031) * ({x} - 14.7013))"
_DEN = "(dx * (37.0211 - 37.0031) - dy * (15.3017 - 14.7013))"


@query(f"""WITH {POSITIONS_SQL}, g AS (SELECT *, {_SIDE.format(x="lon", y="lat")} AS s, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(recorded_at) OVER w AS pat FROM pos WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 h AS (SELECT *, {_SIDE.format(x="plon", y="plat")} AS ps, lon - plon AS dx, lat - plat AS dy, (epoch_us(recorded_at) - epoch_us(pat)) AS us FROM g WHERE pat IS NOT NULL),
 i AS (SELECT *, ((14.7013 - plon) * (37.0211 - 37.0031) - (37.0031 - plat) * (15.3017 - 14.7013)) / nullif({_DEN}, 0) AS t, {_DEN} AS den FROM h),
 j AS (SELECT *, plon + t * dx AS x, plat + t * dy AS y FROM i)
 SELECT owner, id, CASE WHEN s > 0 THEN 'INBOUND' ELSE 'OUTBOUND' END AS direction, date_add(pat, to_microseconds(CAST(floor(us / 2) AS BIGINT))) AS crossed_at,
  CASE WHEN us <= 14400e6 THEN 'A' WHEN us <= 43200e6 THEN 'B' ELSE 'C' END AS quality, round(x, 6) AS x, round(y, 6) AS y FROM j WHERE sign(s) <> sign(ps) AND us > 0 AND us <= 86400e6 AND abs(den) >= 1e-14
  AND x BETWEEN least(plon, lon) - 1e-8 AND greatest(plon, lon) + 1e-8 AND y BETWEEN least(plat, lat) - 1e-8 AND greatest(plat, lat) + 1e-8
  AND x BETWEEN 14.7013 - 1e-8 AND 15.3017 + 1e-8 AND y BETWEEN 37.0031 - 1e-8 AND 37.0211 + 1e-8""")
def gate_crossings(spark, sf):
    return sessions.crossings(positions(spark, sf), GATE).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


_D = _hav(EARTH_KM, "lat", "lon", "37.0", "15.0")


@query(f"""WITH {POSITIONS_SQL}, d AS (SELECT *, {_D} AS d, lead(recorded_at) OVER w AS nat, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM pos WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 e AS (SELECT *, {_hav(EARTH_KM, "nlat", "nlon", "37.0", "15.0")} AS dn, epoch_us(nat) - epoch_us(recorded_at) AS us FROM d WHERE nat IS NOT NULL),
 f AS (SELECT e.*, l.level_km FROM e, (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (45.0::DOUBLE)) l(level_km) WHERE d >= level_km AND dn < level_km AND us > 0 AND us <= 86400e6)
 SELECT owner, level_km, id, round(d, 4) AS d, round(dn, 4) AS d_next FROM (SELECT *, row_number() OVER (PARTITION BY owner, level_km ORDER BY recorded_at DESC, id DESC) AS r FROM f) WHERE r = 1""")
def ring_crossings(spark, sf):
    x = sessions.ring_crossings(positions(spark, sf), 37.0, 15.0, [10.0, 25.0, 45.0], 86_400)
    return x.select("owner", "level_km", "id", F.round("d", 4).alias("d"), F.round("d_next", 4).alias("d_next"))


@query(f"""WITH {POSITIONS_SQL} SELECT id, round(quantile_cont(sog_raw, 0.5) OVER (PARTITION BY owner ORDER BY recorded_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS median_24h FROM pos""")
def rolling_median(spark, sf):
    w = "PARTITION BY owner ORDER BY recorded_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW"
    return positions(spark, sf).select("id", F.round(F.expr(f"percentile(sog_raw, 0.5) OVER ({w})"), 6).alias("median_24h"))


TRANSITIONS_SQL = (
    CLEAN_SQL
    + f""", t1 AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(recorded_at) OVER w AS pat, lag(sog_clean) OVER w AS psog FROM cl WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 t2 AS (SELECT *, CAST(floor(plat / 0.2) AS BIGINT) || ':' || CAST(floor(plon / 0.2) AS BIGINT) AS from_cell, CAST(floor(lat / 0.2) AS BIGINT) || ':' || CAST(floor(lon / 0.2) AS BIGINT) AS to_cell,
  (epoch_us(recorded_at) - epoch_us(pat)) / 3.6e9 AS hours, {_hav(EARTH_NM, "plat", "plon", "lat", "lon")} AS step_nm,
  (coalesce(psog, 0) + coalesce(sog_clean, 0)) / nullif((psog IS NOT NULL)::INT + (sog_clean IS NOT NULL)::INT, 0) AS speed FROM t1 WHERE pat IS NOT NULL),
 tr AS (SELECT * FROM t2 WHERE from_cell <> to_cell AND hours > 0 AND hours <= 24 AND step_nm BETWEEN 0.01 AND 30 AND speed BETWEEN 1 AND 30)"""
)


def transition_rows(spark, sf):
    return sessions.transitions(states.clean(positions(spark, sf)), 0.2, 1440, (0.01, 30.0), (1.0, 30.0))


@query(TRANSITIONS_SQL + " SELECT from_cell, to_cell, count(*) AS n, count(DISTINCT owner) AS owners, round(median(speed), 6) AS median_speed, round(median(step_nm), 6) AS median_nm FROM tr GROUP BY 1, 2")
def cell_transitions(spark, sf):
    return transition_rows(spark, sf).groupBy("from_cell", "to_cell").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"), F.round(F.median("speed"), 6).alias("median_speed"), F.round(F.median("step_nm"), 6).alias("median_nm"))


@query(TRANSITIONS_SQL + " SELECT date_trunc('day', recorded_at) AS day, CAST(hour(recorded_at) // 6 AS INTEGER) AS bin, count(*) AS n, count(DISTINCT owner) AS owners, round(median(speed), 6) AS median_speed FROM tr GROUP BY 1, 2")
def transition_audit(spark, sf):
    x = transition_rows(spark, sf).select(F.date_trunc("day", "recorded_at").cast("timestamp_ntz").alias("day"), F.floor(F.hour("recorded_at") / 6).cast("int").alias("bin"), "owner", "speed")
    return x.groupBy("day", "bin").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"), F.round(F.median("speed"), 6).alias("median_speed"))


@query(f"""WITH RECURSIVE {POSITIONS_SQL}, o AS (SELECT owner, id, recorded_at, sog_raw, row_number() OVER w AS r, coalesce((epoch_us(recorded_at) - epoch_us(lag(recorded_at) OVER w)) / 3.6e9 <= 12, false) AS near FROM pos WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 e AS (SELECT owner, r, id, sog_raw AS f FROM o WHERE r = 1 UNION ALL SELECT o.owner, o.r, o.id, CASE WHEN o.near THEN 0.4 * o.sog_raw + 0.6 * e.f ELSE o.sog_raw END FROM e JOIN o ON o.owner = e.owner AND o.r = e.r + 1) SELECT id, round(f, 6) AS smooth FROM e""")
def causal_ewma(spark, sf):
    x = sessions.smoothed(positions(spark, sf).select("owner", "id", "recorded_at", "sog_raw"), "sog_raw", 0.4, 12.0)
    return x.select("id", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {POSITIONS_SQL} SELECT count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90 FROM (SELECT abs(sog_raw - lag(sog_raw) OVER w) AS d,
  (epoch_us(recorded_at) - epoch_us(lag(recorded_at) OVER w)) / 3.6e9 AS h FROM pos WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)) WHERE h <= 12""")
def revision_metrics(spark, sf):
    from tidelog.functions import times

    w = sessions.by_owner()
    x = positions(spark, sf).select(F.abs(F.col("sog_raw") - F.lag("sog_raw").over(w)).alias("d"), times.hours_between(F.lag("recorded_at").over(w), F.col("recorded_at")).alias("h")).where("h <= 12")
    return quantiles.summary(x, [], "d", [F.count("d").alias("n"), F.round(F.avg("d"), 6).alias("mean")], {"median": 0.5, "p90": 0.9})


@query("""WITH o AS (SELECT o_orderkey AS key, c_mktsegment AS port, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
 p AS (SELECT *, n - 20 - 50 AS m, r - 50 AS k FROM o) SELECT key, CASE WHEN r > n - 20 THEN 'FINAL' WHEN r <= 50 THEN 'WARMUP' ELSE 'FOLD_' || CAST(CASE WHEN k <= (m % 5) * (m // 5 + 1) THEN (k - 1) // (m // 5 + 1)
  ELSE m % 5 + (k - 1 - (m % 5) * (m // 5 + 1)) // (m // 5) END + 1 AS BIGINT) END AS part FROM p""")
def holdout_folds(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("port"))
    x = table(spark, sf, "orders").join(customer, "o_custkey").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"), "port")
    return folds.chronological(x, "port", ["at", "key"], final=20, warmup=50, blocks=5).select("key", "part")


@query("""WITH c AS (SELECT o_orderdate AS t, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT t, n, sum(n) OVER (ORDER BY t) AS upto, sum(n) OVER () AS total FROM c),
 b AS (SELECT k, min(t) AS edge FROM r, (VALUES (1), (2), (3), (4)) v(k) WHERE upto >= k * total / 5.0 GROUP BY 1)
 SELECT block, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM (SELECT o_orderdate, (SELECT count(*) FROM b WHERE edge < o_orderdate) AS block FROM orders) GROUP BY 1""")
def temporal_blocks(spark, sf):
    x = folds.temporal_blocks(table(spark, sf, "orders").select(F.col("o_orderdate").alias("at")), "at", 5)
    return x.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("""WITH c AS (SELECT o_orderdate AS t, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT t, n, sum(n) OVER (ORDER BY t) AS upto, sum(n) OVER () AS total FROM c),
 b AS (SELECT k, min(t) AS edge FROM r, (VALUES (1), (2), (3), (4)) v(k) WHERE upto >= k * total / 5.0 GROUP BY 1), x AS (SELECT o_orderdate AS t, (SELECT count(*) FROM b WHERE edge < o_orderdate) AS block FROM orders),
 f AS (SELECT block AS fold, min(t) AS test_start FROM x WHERE block > 0 GROUP BY 1)
 SELECT fold, CASE WHEN block = fold THEN 'TEST' WHEN block > fold THEN 'FUTURE' WHEN t < test_start - INTERVAL 6 HOUR THEN 'TRAIN' ELSE 'PURGED' END AS role, count(*) AS n FROM x, f GROUP BY 1, 2""")
def forward_embargo(spark, sf):
    x = folds.temporal_blocks(table(spark, sf, "orders").select(F.col("o_orderdate").alias("at")), "at", 5)
    return folds.forward_roles(x, "at", 6.0).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey % 5 AS fold, o_orderstatus AS status, count(*) AS own, sum(count(*)) OVER (PARTITION BY o_orderstatus)::BIGINT - count(*) AS others, round(1.0 / count(*), 9) AS weight FROM orders GROUP BY 1, 2""")
def leave_out_support(spark, sf):
    x = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("own"))
    return x.select("fold", "status", "own", (F.sum("own").over(Window.partitionBy("status")) - F.col("own")).alias("others"), F.round(1.0 / F.col("own"), 9).alias("weight"))


@query("""WITH RECURSIVE o AS (SELECT owner, n, row_number() OVER (ORDER BY n DESC, owner) AS i FROM (SELECT o_custkey AS owner, count(*) AS n FROM orders GROUP BY 1)),
 g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS owner, NULL::BIGINT AS n, NULL::INTEGER AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
  SELECT o.i, o.owner, o.n, k - 1, [CASE WHEN j = k THEN loads[j] + o.n ELSE loads[j] END FOR j IN range(1, 6)] FROM g JOIN o ON o.i = g.i + 1, LATERAL (SELECT list_position(loads, list_min(loads))::INTEGER AS k))
 SELECT owner, n, fold FROM g WHERE i > 0""")
def greedy_folds(spark, sf):
    """Owners dealt largest first to the least loaded fold; sequential by nature, over the number of rows of each owner."""
    x = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.count("*").alias("n"))
    return folds.greedy_balanced(x, "owner", "n", 5)


@query("SELECT c_nationkey AS owner, round(sum(1.0 / n), 6) AS weight, count(*) AS rows FROM (SELECT c_nationkey, count(*) OVER (PARTITION BY c_nationkey, c_acctbal > 5000) AS n FROM customer) GROUP BY 1")
def group_weights(spark, sf):
    x = table(spark, sf, "customer").select(F.col("c_nationkey").alias("owner"), (F.col("c_acctbal") > 5000).alias("band"))
    x = x.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("owner", "band")))
    return x.groupBy("owner").agg(F.round(F.sum("w"), 6).alias("weight"), F.count("*").alias("rows"))
