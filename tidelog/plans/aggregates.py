"""Queries over aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import times
from tidelog.operators import aggregates, joins, quantiles
from tidelog.plans.registry import query
from tidelog.plans.scalars import _hav
from tidelog.plans.temporal import STATES_SQL, state_rows
from tidelog.config import EARTH_KM, EARTH_NM
from tidelog.functions import geo
from tidelog.sources.domain import DECISIONS_SQL, POSITIONS_SQL, decisions, positions
from tidelog.sources.tables import table

_ERR = "abs(pred_a - target_h)"
_METRICS = f"count(*) AS n, round(avg({_ERR}), 6) AS mae, round(quantile_cont({_ERR}, 0.5), 6) AS medae, round(sqrt(avg({_ERR} * {_ERR})), 6) AS rmse, round(quantile_cont({_ERR}, 0.9), 6) AS p90, round(quantile_cont({_ERR}, 0.95), 6) AS p95, round(avg(({_ERR} <= 24)::INT), 6) AS within_24, round(max({_ERR}), 6) AS worst"


def error():
    return F.col("pred_a") - F.col("target_h")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS owners, min(ts) AS first_at, max(ts) AS last_at, round(median(value), 6) AS med, round(avg(value), 6) AS mean, max_by(event_id, {'t': ts, 'i': event_id}) AS last_id FROM events GROUP BY 1""")
def group_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("owners"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        F.round(F.median("value"), 6).alias("med"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"),
    )


@query("""SELECT 'value' AS name, q, round(v, 6) AS v FROM (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q, unnest(quantile_cont(value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS v FROM events)
  UNION ALL SELECT event_type, 0, round(count(*) / (SELECT count(*) FROM events), 6) FROM events GROUP BY 1""")
def distribution_summary(spark, sf):
    e = table(spark, sf, "events")
    qs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    found = quantiles.quantiles(e, [], "value", qs).select(F.inline(F.arrays_zip(F.array(*map(F.lit, qs)).alias("p"), F.col("q").alias("v")))).toDF("q", "v")
    shares = e.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("v", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return found.select(F.lit("value").alias("name"), "q", F.round("v", 6).alias("v")).unionAll(shares.select("event_type", F.lit(0.0), F.round("v", 6)))


_W = [6, 24, 72]
_TRAIL = ", ".join(
    f"round(median(CASE WHEN h <= {w} THEN sog_clean END), 6) AS med_{w}, round(avg(CASE WHEN h <= {w} THEN sog_clean END), 6) AS mean_{w}, round(coalesce(stddev_samp(CASE WHEN h <= {w} THEN sog_clean END), CASE WHEN count(CASE WHEN h <= {w} THEN sog_clean END) = 1 THEN 0.0 END), 6) AS std_{w}, round(avg(CASE WHEN h <= {w} THEN moving::INT END), 6) AS moving_{w}, count(CASE WHEN h <= {w} AND turning THEN 1 END) AS turns_{w}, round(coalesce(sum(CASE WHEN h <= {w} THEN step_m END), 0), 2) AS path_{w}"
    for w in _W
)


@query(STATES_SQL + f""" SELECT d.event_id, {_TRAIL}, round({_hav(EARTH_KM, "min_by(lat, {'t': recorded_at, 'i': id}) FILTER (h <= 72)", "min_by(lon, {'t': recorded_at, 'i': id}) FILTER (h <= 72)", "max_by(lat, {'t': recorded_at, 'i': id}) FILTER (h <= 72)", "max_by(lon, {'t': recorded_at, 'i': id}) FILTER (h <= 72)")}, 4) AS net_72
  FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') d LEFT JOIN (SELECT * FROM st) s ON s.owner = d.user_id AND s.recorded_at <= d.ts AND s.recorded_at >= d.ts - INTERVAL 72 HOUR, LATERAL (SELECT (epoch_us(d.ts) - epoch_us(s.recorded_at)) / 3.6e9 AS h) GROUP BY 1""")
def trailing_windows(spark, sf):
    d = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("owner"), "ts", F.timestamp_add("HOUR", F.lit(-72), F.col("ts")).alias("since"))
    s = state_rows(spark, sf).select("owner", "id", "recorded_at", "sog_clean", "moving", "turning", "step_m", "lat", "lon")
    h = times.hours_between(F.col("recorded_at"), F.col("ts"))
    aggs = []
    for w in _W:
        inside = lambda c, w=w: F.when(h <= w, F.col(c))
        aggs += [
            F.round(F.median(inside("sog_clean")), 6).alias(f"med_{w}"),
            F.round(F.avg(inside("sog_clean")), 6).alias(f"mean_{w}"),
            F.round(F.when(F.count(inside("sog_clean")) == 1, 0.0).otherwise(F.stddev_samp(inside("sog_clean"))), 6).alias(f"std_{w}"),
            F.round(F.avg(inside("moving").cast("int")), 6).alias(f"moving_{w}"),
            F.count_if((h <= w) & F.col("turning")).alias(f"turns_{w}"),
            F.round(F.coalesce(F.sum(inside("step_m")), F.lit(0.0)), 2).alias(f"path_{w}"),
        ]
    place = F.when(h <= 72, F.struct("recorded_at", "id", "lat", "lon"))
    aggs += [F.min(place).alias("_a"), F.max(place).alias("_z")]
    x = joins.in_windows(s, d, "owner", "recorded_at", "since", "ts", 72, aggs, ["event_id"])
    return x.withColumn("net_72", F.round(geo.haversine(F.col("_a.lat"), F.col("_a.lon"), F.col("_z.lat"), F.col("_z.lon"), EARTH_KM), 4)).drop("_a", "_z")


@query(f"WITH {DECISIONS_SQL} SELECT status, {_METRICS} FROM dec GROUP BY 1")
def metric_bundle(spark, sf):
    return aggregates.metric_table(decisions(spark, sf), ["status"], error())


@query(f"WITH {DECISIONS_SQL} SELECT status, round(sum(w * e) / sum(w), 6) AS w_mae, round(sqrt(sum(w * e * e) / sum(w)), 6) AS w_rmse FROM (SELECT status, {_ERR} AS e, 1.0 / count(*) OVER (PARTITION BY owner) AS w FROM dec) GROUP BY 1")
def weighted_metrics(spark, sf):
    x = decisions(spark, sf).withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("owner")))
    return x.groupBy("status").agg(*aggregates.weighted(error(), F.col("w")))


@query("""WITH x AS (SELECT l_returnflag AS flag, l_extendedprice AS v, l_quantity AS w, l_orderkey * 100 + l_linenumber AS t FROM lineitem), c AS (SELECT flag, v, sum(w) OVER (PARTITION BY flag ORDER BY v, t, w ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY flag) AS cdf FROM x)
  SELECT flag, min(v) FILTER (cdf >= 0.25 - 1e-12) AS q25, min(v) FILTER (cdf >= 0.5 - 1e-12) AS q50, min(v) FILTER (cdf >= 0.9 - 1e-12) AS q90 FROM c GROUP BY 1""")
def weighted_quantiles(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("t"))
    return aggregates.weighted_quantiles(x, ["flag"], "v", "w", {"q25": 0.25, "q50": 0.5, "q90": 0.9})


@query(f"WITH {DECISIONS_SQL} SELECT destination, count(*) AS owners, round(avg(m), 6) AS balanced_mae, round(max(m), 6) AS worst FROM (SELECT destination, owner, avg({_ERR}) AS m FROM dec GROUP BY 1, 2) GROUP BY 1")
def balanced_mae(spark, sf):
    x = decisions(spark, sf).groupBy("destination", "owner").agg(F.avg(F.abs(error())).alias("m"))
    return x.groupBy("destination").agg(F.count("*").alias("owners"), F.round(F.avg("m"), 6).alias("balanced_mae"), F.round(F.max("m"), 6).alias("worst"))


@query(f"WITH {DECISIONS_SQL} SELECT owner, round(max({_ERR}), 6) AS score, min_by(key, {{'t': decided_at, 'k': key}}) AS first_key, bool_and({_ERR} < 5000) AS covered, round(avg(({_ERR} < 1000)::INT), 6) AS share FROM dec GROUP BY 1")
def grouped_scores(spark, sf):
    e = F.abs(error())
    return decisions(spark, sf).groupBy("owner").agg(F.round(F.max(e), 6).alias("score"), F.min_by("key", F.struct("decided_at", "key")).alias("first_key"), F.bool_and(e < 5000).alias("covered"), F.round(F.avg((e < 1000).cast("int")), 6).alias("share"))


@query(f"""WITH {DECISIONS_SQL} SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(ship_type) = 0 THEN 'ship_type' ELSE 'region' END AS slice_family, coalesce(status, ship_type, region::VARCHAR) AS slice_value, {_METRICS} FROM dec GROUP BY GROUPING SETS ((status), (ship_type), (region))""")
def metric_slices(spark, sf):
    return aggregates.metric_slices(decisions(spark, sf), ["status", "ship_type", "region"], error())


@query(f"""WITH {DECISIONS_SQL}, e AS (SELECT {_ERR} AS e, row_number() OVER (ORDER BY {_ERR} DESC, key) AS r FROM dec) SELECT CAST(k AS INTEGER) AS k, round(sum(e) FILTER (r <= k) / sum(e), 6) AS share FROM e, (VALUES (1), (5), (20), (100)) v(k) GROUP BY 1""")
def error_concentration(spark, sf):
    return aggregates.concentration(decisions(spark, sf), error(), [1, 5, 20, 100], "key")


@query("""WITH r AS (SELECT c_mktsegment AS seg, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS x, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS y FROM customer)
  SELECT seg, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark, sf):
    x = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), "c_acctbal", "c_nationkey")
    return aggregates.spearman(x, ["seg"], "c_acctbal", "c_nationkey").withColumn("rho", F.round("rho", 6))


@query("""SELECT o_orderstatus AS status, round(avg(o_totalprice) FILTER (o_orderkey % 3 = 0), 4) AS f0, round(avg(o_totalprice) FILTER (o_orderkey % 3 = 1), 4) AS f1, round(avg(o_totalprice) FILTER (o_orderkey % 3 = 2), 4) AS f2 FROM orders GROUP BY 1""")
def pivot_folds(spark, sf):
    x = table(spark, sf, "orders").withColumn("f", F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")))
    return x.groupBy(F.col("o_orderstatus").alias("status")).pivot("f", ["f0", "f1", "f2"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("SELECT user_id, event_type AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1")
def mode_smallest(spark, sf):
    return aggregates.mode_smallest(table(spark, sf, "events"), ["user_id"], "event_type")


@query("SELECT c_nationkey, c_custkey, c_acctbal, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def topk_per_group(spark, sf):
    return aggregates.top_per_group(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def dedupe_first(spark, sf):
    return aggregates.first_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'left', count(*) FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  UNION ALL SELECT 'union', count(*) FROM (SELECT n_nationkey FROM nation UNION SELECT r_regionkey FROM region)""")
def set_operations(spark, sf):
    e, c = table(spark, sf, "events"), table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    nodes = table(spark, sf, "nation").select("n_nationkey").union(table(spark, sf, "region").select("r_regionkey")).distinct()
    return n(e.where("event_type = 'view'").select("user_id").intersect(c), "both").unionAll(n(e.select("user_id").distinct().join(c, F.col("user_id") == F.col("c_custkey"), "left_anti"), "left")).unionAll(n(nodes, "union"))


@query("SELECT name, kind, n FROM (SELECT s_name AS name, 'supplier' AS kind, s_nationkey::BIGINT AS n FROM supplier UNION ALL BY NAME SELECT c_name AS name, 'customer' AS kind FROM customer)")
def union_by_name(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("bigint").alias("n"))
    return s.unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")), allowMissingColumns=True)


@query("""WITH e AS (SELECT list_distinct(quantile_cont(c_acctbal, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM customer) SELECT bin, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM
  (SELECT c_acctbal, CAST(greatest(len(list_filter(edges, lambda x: x < c_acctbal)) - 1, 0) AS INTEGER) AS bin FROM customer, e) GROUP BY 1""")
def quantile_bins(spark, sf):
    c = table(spark, sf, "customer").select("c_acctbal")
    x = c.crossJoin(F.broadcast(aggregates.quantile_edges(c, "c_acctbal", 5))).withColumn("bin", aggregates.quantile_bin(F.col("c_acctbal"), F.col("edges")))
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query(f"""WITH {POSITIONS_SQL} SELECT date_trunc('hour', recorded_at) AS hour, sum((d <= 20)::INT)::BIGINT AS near, sum((d <= 60)::INT)::BIGINT AS wide, sum((d <= 60 AND sog_raw < 20)::INT)::BIGINT AS slow, round(sum((d <= 60 AND sog_raw < 20)::INT) / greatest(sum((d <= 60)::INT), 1), 6) AS pressure
  FROM (SELECT *, {_hav(EARTH_NM, "lat", "lon", "37e0", "15e0")} AS d FROM pos) GROUP BY 1""")
def snapshot_traffic(spark, sf):
    x = positions(spark, sf).withColumn("d", geo.haversine(F.col("lat"), F.col("lon"), F.lit(37.0), F.lit(15.0), EARTH_NM))
    slow = F.count_if((F.col("d") <= 60) & (F.col("sog_raw") < 20))
    return x.groupBy(F.date_trunc("hour", "recorded_at").cast("timestamp_ntz").alias("hour")).agg(
        F.count_if(F.col("d") <= 20).alias("near"), F.count_if(F.col("d") <= 60).alias("wide"), slow.alias("slow"), F.round(slow / F.greatest(F.count_if(F.col("d") <= 60), F.lit(1)), 6).alias("pressure")
    )


@query(f"""WITH {POSITIONS_SQL} SELECT kind, level, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon, count(DISTINCT owner) AS support FROM (SELECT owner, lat, lon, owner % 4 AS kind, CAST(floor({_hav(EARTH_KM, "lat", "lon", "37e0", "15e0")} / 10) AS INTEGER) * 10 AS level FROM pos) GROUP BY 1, 2 HAVING count(DISTINCT owner) >= 3""")
def prototype_medians(spark, sf):
    x = positions(spark, sf).select("owner", "lat", "lon", (F.col("owner") % 4).alias("kind"), (F.floor(geo.haversine(F.col("lat"), F.col("lon"), F.lit(37.0), F.lit(15.0), EARTH_KM) / 10).cast("int") * 10).alias("level"))
    return x.groupBy("kind", "level").agg(F.round(F.median("lat"), 6).alias("lat"), F.round(F.median("lon"), 6).alias("lon"), F.countDistinct("owner").alias("support")).where("support >= 3")


@query(f"""WITH {DECISIONS_SQL}, m AS (SELECT model, round(avg(e), 6) AS mae, round(quantile_cont(e, 0.9), 6) AS p90 FROM (SELECT unnest(['a', 'b', 'c']) AS model, unnest([abs(pred_a - target_h), abs(pred_b - target_h), abs(pred_c - target_h)]) AS e FROM dec) GROUP BY 1)
  SELECT model, mae, p90 FROM m ORDER BY mae, p90, model LIMIT 1""")
def model_selection(spark, sf):
    stacked = decisions(spark, sf).select(F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.abs(F.col(f"pred_{m}") - F.col("target_h")).alias("e")) for m in "abc"))))
    m = quantiles.summary(stacked, ["model"], "e", [F.round(F.avg("e"), 6).alias("mae")], {"p90": 0.9})
    return aggregates.selected(m, ["mae", "p90"], "model")


@query("""WITH x AS (SELECT *, sha256('scan|' || c_custkey) AS h, c_acctbal > 0 AND c_nationkey < 15 AS ok, CASE WHEN c_acctbal <= 0 THEN 'no balance' ELSE 'elsewhere' END AS why FROM customer), l AS (SELECT max(h) AS h FROM (SELECT h FROM x WHERE ok ORDER BY h LIMIT 200))
  SELECT why AS reason, count(*) AS n FROM x WHERE NOT ok AND h < (SELECT h FROM l) GROUP BY 1""")
def first_accepted(spark, sf):
    from tidelog.functions import hashing

    x = table(spark, sf, "customer").withColumn("h", hashing.digest("scan", F.col("c_custkey")))
    return aggregates.first_accepted(x, "h", (F.col("c_acctbal") > 0) & (F.col("c_nationkey") < 15), F.when(F.col("c_acctbal") <= 0, "no balance").otherwise("elsewhere"), 200)[1]


@query("""SELECT user_id AS owner, min({'h': sha256('pick|' || event_id), 't': ts, 'i': event_id}).i AS event_id FROM events WHERE event_type = 'click' AND value BETWEEN 5 AND 80 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1""")
def hash_selected_decision(spark, sf):
    from tidelog.functions import hashing

    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-25 00:00:00"))
    x = table(spark, sf, "events").where((F.col("event_type") == "click") & F.col("value").between(5, 80) & (F.col("ts") >= start) & (F.col("ts") < end))
    return x.groupBy(F.col("user_id").alias("owner")).agg(F.min(F.struct(hashing.digest("pick", F.col("event_id")).alias("h"), "ts", "event_id")).alias("x")).select("owner", "x.event_id")
