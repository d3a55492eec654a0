"""Queries over joins: as-of, interval, nearest, gated, snapped, semi, anti and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.config import EARTH_NM
from tidelog.functions import arrays, geo
from tidelog.operators import contracts, joins, sessions
from tidelog.plans.registry import query
from tidelog.plans.scalars import _hav
from tidelog.plans.temporal import TRANSITIONS_SQL, _PAIRS, transition_rows
from tidelog.sources.domain import POSITIONS_SQL, positions
from tidelog.sources.tables import table


@query("SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def validated_chain(spark, sf):
    orders, customer, nation, region = (table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    x = contracts.validated_join(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), customer.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_custkey"])
    x = x.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return x.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts = b.ts")
def exact_time_join(spark, sf):
    a = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return a.join(a.withColumnRenamed("event_id", "other"), ["user_id", "ts"]).select("event_id", "other")


@query("""SELECT a.event_id, b.ts AS seen_at, b.event_id AS seen_id, round(b.value, 6) AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_latest(spark, sf):
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("seen_id"), F.col("ts").alias("seen_at"), "value")
    x = joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "seen_at", ["seen_id", "value"], "seen_id")
    return x.select("event_id", "seen_at", "seen_id", F.round("value", 6).alias("value"))


@query("""SELECT a.event_id, b.event_id AS seen_id, round((epoch_us(a.ts) - epoch_us(b.ts)) / 3.6e9, 6) AS hours FROM (SELECT *, ts - INTERVAL 12 HOUR AS l FROM events WHERE event_type = 'purchase') a
  ASOF LEFT JOIN events b ON a.user_id = b.user_id AND a.l >= b.ts""")
def asof_lagged(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.timestamp_add("HOUR", F.lit(-12), F.col("ts")).alias("l"))
    x = joins.asof(left, e.select("user_id", F.col("event_id").alias("seen_id"), F.col("ts").alias("seen_at")), "user_id", "l", "seen_at", ["seen_id"], "seen_id")
    return x.select("event_id", "seen_id", F.round(F.timestamp_diff("MICROSECOND", F.col("seen_at"), F.col("ts")) / F.lit(3.6e9), 6).alias("hours"))


@query("""SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""")
def latest_previous_event(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "events").select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w).alias("last_purchase"))


@query(f"""WITH {POSITIONS_SQL}, {_PAIRS} SELECT p.owner, p.session, count(e.id) AS n, round(max(e.sog_raw), 6) AS fastest, sum(CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors
  FROM pairs p LEFT JOIN pos e ON e.owner = p.owner AND e.recorded_at >= p.inbound_at AND e.recorded_at <= p.outbound_at WHERE p.outbound_at IS NOT NULL GROUP BY 1, 2""")
def interval_stats(spark, sf):
    p = positions(spark, sf)
    closed = sessions.pair_sessions(p).where("outbound_at is not null")
    aggs = [F.count("id").alias("n"), F.round(F.max("sog_raw"), 6).alias("fastest"), F.count_if(F.col("event_type") == "error").alias("errors")]
    return joins.in_windows(p.select("owner", "id", "recorded_at", "sog_raw", "event_type"), closed, "owner", "recorded_at", "inbound_at", "outbound_at", 48, aggs, ["owner", "session"])


@query("""SELECT user_id, event_id, x.t AS nearest_at, round(x.off / 3.6e9, 6) AS off_h, n_after FROM (SELECT a.user_id, a.event_id, min({'off': abs(epoch_us(b.ts) - epoch_us(a.ts)), 't': b.ts}) AS x,
  count(*) FILTER (b.ts >= a.ts) AS n_after FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' WHERE a.event_type = 'signup' GROUP BY 1, 2)""")
def nearest_event(spark, sf):
    e = table(spark, sf, "events")
    calls = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("call_at"))
    return joins.nearest_event(e.where("event_type = 'signup'").select("user_id", "event_id", "ts"), calls, "user_id", "event_id", "ts", "call_at").withColumn("off_h", F.round("off_h", 6))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_and_anti(spark, sf):
    customer, orders = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    calm = customer.join(orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")
    with_f = orders.where("o_orderstatus = 'F'").select("c_custkey").distinct().withColumn("_f", F.lit(True))
    return calm.join(with_f, "c_custkey", "left").select("c_custkey", F.coalesce("_f", F.lit(False)).alias("has_f"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right only' ELSE 'left only' END AS found_in FROM (SELECT DISTINCT user_id AS k FROM events) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def coverage_full_outer(spark, sf):
    return contracts.coverage(table(spark, sf, "events").select(F.col("user_id").alias("k")), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


_KNN = """WITH m AS (SELECT vec_id, vec_id % 50 AS owner, label AS gate, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM m WHERE vec_id % 100 = 0),
 g AS (SELECT gate, count(DISTINCT owner) >= 4 AS gated FROM m GROUP BY 1), p AS (SELECT q.vec_id AS q_id, gated, m.owner AS m_owner, m.vec_id AS m_id,
  greatest(0.0, least(2.0, 1 - list_dot_product(q.e, m.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(m.e, m.e))))) AS d FROM q JOIN g USING (gate) JOIN m ON m.owner <> q.owner AND (NOT gated OR m.gate = q.gate)),
 b AS (SELECT q_id, gated, m_owner, d, m_id, row_number() OVER (PARTITION BY q_id, m_owner ORDER BY d, m_id) AS r FROM p),
 k AS (SELECT q_id, gated, m_owner, m_id, d, row_number() OVER (PARTITION BY q_id ORDER BY d, m_id) AS rank FROM b WHERE r = 1)"""


def knn_rows(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("owner"), F.col("label").alias("gate"), "embedding")
    q = x.where("vec_id % 100 = 0").select(*(F.col(a).alias(b) for a, b in (("vec_id", "q_id"), ("owner", "q_owner"), ("gate", "q_gate"), ("embedding", "q_e"))))
    m = x.select(*(F.col(a).alias(f"m_{b}") for a, b in (("vec_id", "id"), ("owner", "owner"), ("gate", "gate"), ("embedding", "e"))))
    return joins.gated_knn(q, m, "gate", "owner", arrays.cosine_distance(F.col("q_e"), F.col("m_e")), 5)


@query(_KNN + " SELECT q_id, gated, CAST(rank AS INTEGER) AS rank, m_owner, m_id, round(d, 5) AS distance FROM k WHERE rank <= 5")
def gated_knn(spark, sf):
    return knn_rows(spark, sf).withColumn("distance", F.round("distance", 5))


@query(TRANSITIONS_SQL + """, e AS (SELECT from_cell, to_cell, CAST(hour(recorded_at) // 6 AS INTEGER) AS bin, owner % 3 AS kind, speed FROM tr)
 SELECT from_cell, to_cell, bin, kind, CASE WHEN nb >= 2 THEN 'time+type' WHEN nk >= 2 THEN 'type' WHEN nt >= 2 THEN 'time' WHEN n >= 2 THEN 'base' ELSE 'none' END AS level,
  round(least(30, greatest(1, CASE WHEN nb >= 2 THEN mb WHEN nk >= 2 THEN mk WHEN nt >= 2 THEN mt ELSE m END)), 6) AS speed FROM
  (SELECT DISTINCT from_cell, to_cell, bin, kind, count(*) OVER a AS n, median(speed) OVER a AS m, count(*) OVER t AS nt, median(speed) OVER t AS mt, count(*) OVER k AS nk, median(speed) OVER k AS mk, count(*) OVER b AS nb, median(speed) OVER b AS mb
   FROM e WINDOW a AS (PARTITION BY from_cell, to_cell), t AS (PARTITION BY from_cell, to_cell, bin), k AS (PARTITION BY from_cell, to_cell, kind), b AS (PARTITION BY from_cell, to_cell, bin, kind))""")
def fallback_edges(spark, sf):
    e = transition_rows(spark, sf).select("from_cell", "to_cell", F.floor(F.hour("recorded_at") / 6).cast("int").alias("bin"), (F.col("owner") % 3).alias("kind"), "speed")
    # One pass for all four levels; the finest level with support wins.
    levels = e.groupingSets([["from_cell", "to_cell"], ["from_cell", "to_cell", "bin"], ["from_cell", "to_cell", "kind"], ["from_cell", "to_cell", "bin", "kind"]], "from_cell", "to_cell", "bin", "kind").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.median("speed").alias("m")
    )
    pick = lambda g, name: levels.where(F.col("g") == g).select("from_cell", "to_cell", *{0: ["bin", "kind"], 1: ["bin"], 2: ["kind"], 3: []}[g], F.col("n").alias(f"n_{name}"), F.col("m").alias(f"m_{name}"))
    x = pick(0, "both").join(pick(1, "time"), ["from_cell", "to_cell", "bin"]).join(pick(2, "type"), ["from_cell", "to_cell", "kind"]).join(pick(3, "base"), ["from_cell", "to_cell"])
    order = ["both", "type", "time", "base"]
    level = speed = None
    for name, label in zip(order, ["time+type", "type", "time", "base"], strict=True):
        test = F.col(f"n_{name}") >= 2
        level = F.when(test, label) if level is None else level.when(test, label)
        speed = F.when(test, F.col(f"m_{name}")) if speed is None else speed.when(test, F.col(f"m_{name}"))
    return x.select("from_cell", "to_cell", "bin", "kind", level.otherwise("none").alias("level"), F.round(F.least(F.lit(30.0), F.greatest(F.lit(1.0), speed.otherwise(F.col("m_base")))), 6).alias("speed"))


@query(f"""WITH {POSITIONS_SQL}, n AS (SELECT CAST(floor(lat / 0.2) AS BIGINT) AS i, CAST(floor(lon / 0.2) AS BIGINT) AS j FROM pos GROUP BY 1, 2 HAVING median(sog_raw) > 35),
 m AS (SELECT i || ':' || j AS node, (i + 0.5) * 2e-1 AS nlat, (j + 0.5) * 2e-1 AS nlon FROM n), p AS (SELECT id, lat, lon FROM pos),
 d AS (SELECT id, node, {_hav(EARTH_NM, "lat", "lon", "nlat", "nlon")} AS d FROM p, m) SELECT id, node, round(d, 5) AS snap_nm FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, node) AS r FROM d WHERE d <= 40) WHERE r = 1""")
def snap_to_cells(spark, sf):
    p = positions(spark, sf)
    nodes = p.groupBy(geo.cell(F.col("lat"), 0.2).alias("node_i"), geo.cell(F.col("lon"), 0.2).alias("node_j")).agg(F.median("sog_raw").alias("m")).where("m > 35")
    nodes = nodes.select("node_i", "node_j", F.concat_ws(":", "node_i", "node_j").alias("node"), geo.centre(F.col("node_i"), 0.2).alias("node_lat"), geo.centre(F.col("node_j"), 0.2).alias("node_lon"))
    return joins.snap(p.select("id", "lat", "lon"), nodes, 0.2, 40.0, EARTH_NM, "id").withColumn("snap_nm", F.round("snap_nm", 5))


@query(f"""WITH {POSITIONS_SQL}, {_PAIRS}, t AS (SELECT owner, session, inbound_at, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, inbound_at + INTERVAL 21599999999 MICROSECOND), outbound_at - INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)) AS tick FROM pairs WHERE outbound_at IS NOT NULL),
 a AS (SELECT t.*, p.recorded_at AS seen_at, p.sog_raw FROM t ASOF LEFT JOIN pos p ON t.owner = p.owner AND t.tick >= p.recorded_at), b AS (SELECT a.*, a.tick - INTERVAL 720 MINUTE AS lt FROM a),
 c AS (SELECT b.*, p.recorded_at AS lseen, p.sog_raw AS lsog FROM b ASOF LEFT JOIN pos p ON b.owner = p.owner AND b.lt >= p.recorded_at)
 SELECT owner, session, tick, CASE WHEN seen_at >= inbound_at THEN round(sog_raw, 6) END AS sog, CASE WHEN lseen >= inbound_at THEN round(lsog, 6) END AS lag_sog,
  CASE WHEN seen_at >= inbound_at THEN round((epoch_us(tick) - epoch_us(seen_at)) / 1e6, 3) END AS age_s, coalesce(seen_at >= inbound_at AND (epoch_us(tick) - epoch_us(seen_at)) / 1e6 <= 10800, false) AS fresh FROM c""")
def decision_panel(spark, sf):
    p = positions(spark, sf)
    calls = sessions.pair_sessions(p).where("outbound_at is not null")
    x = joins.decision_panel(calls, p.select("owner", "id", "recorded_at", "sog_raw"), "owner", "session", "inbound_at", "outbound_at", 360, 720, 10_800, ["sog_raw"])
    return x.select("owner", "session", "tick", F.round("sog_raw", 6).alias("sog"), F.round("lag_sog_raw", 6).alias("lag_sog"), F.round("age_s", 3).alias("age_s"), "fresh")


@query("SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey) - 1 AS others, greatest(0, (sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) - (l_returnflag = 'R')::INT))::BIGINT AS other_returns FROM lineitem")
def self_exclusion(spark, sf):
    w = Window.partitionBy("l_orderkey")
    returned = (F.col("l_returnflag") == "R").cast("bigint")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.count("*").over(w) - 1).alias("others"), F.greatest(F.lit(0).cast("bigint"), F.sum(returned).over(w) - returned).alias("other_returns"))
