"""Queries that compose operators: quality tracks, visits, diagnostics, audits and the whole scoring chain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.config import EARTH_KM, EARTH_NM
from tidelog.functions import geo, hashing, numeric, times
from tidelog.operators import evaluation, experts, joins, scoring, sessions
from tidelog.plans.experts import catalog
from tidelog.plans.registry import query
from tidelog.plans.scalars import _hav
from tidelog.plans.temporal import STATES_SQL, _PAIRS, state_rows
from tidelog.session import shared_folder
from tidelog.sources.domain import DECISIONS_SQL, POSITIONS_SQL, decisions, positions
from tidelog.sources.tables import table


@query(STATES_SQL + """ SELECT owner, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT *, lag(lat) OVER w AS qlat, lag(lon) OVER w AS qlon FROM st WHERE NOT jump AND stale_risk <> 'HIGH' WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id))
 WHERE qlat IS NULL OR qlat <> lat OR qlon <> lon GROUP BY 1""")
def quality_track(spark, sf):
    """Valid rows without jumps or stale ones, and without repeats of the place before."""
    w = sessions.by_owner()
    x = state_rows(spark, sf).where("position_valid and not jump and stale_risk <> 'HIGH'")
    x = x.withColumns({"qlat": F.lag("lat").over(w), "qlon": F.lag("lon").over(w)}).where("qlat is null or qlat <> lat or qlon <> lon")
    return x.groupBy("owner").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(STATES_SQL + """ SELECT tier, count(*) AS n FROM (SELECT CASE WHEN c = 4 AND nm <= 40 THEN 'HIGH' WHEN c >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM (SELECT (sog_clean IS NOT NULL)::INT + (NOT gap)::INT + (stale_risk = 'LOW')::INT + (motion_state <> 'UNKNOWN')::INT AS c, """ + _hav(EARTH_NM, "lat", "lon", "37.5e0", "15.1e0") + " AS nm FROM st)) GROUP BY 1")
def reliability_tiers(spark, sf):
    x = state_rows(spark, sf)
    checks = [F.col("sog_clean").isNotNull(), ~F.col("gap"), F.col("stale_risk") == "LOW", F.col("motion_state") != "UNKNOWN"]
    c = sum((t.cast("int") for t in checks), F.lit(0))
    nm = geo.haversine(F.col("lat"), F.col("lon"), F.lit(37.5), F.lit(15.1), EARTH_NM)
    return x.groupBy(F.when((c == 4) & (nm <= 40), "HIGH").when(c >= 3, "MEDIUM").otherwise("LOW").alias("tier")).agg(F.count("*").alias("n"))


_NM = _hav(EARTH_NM, "lat", "lon", "37e0", "15e0")


@query(f"""WITH {POSITIONS_SQL}, d AS (SELECT *, {_NM} AS nm FROM pos), e AS (SELECT *, CASE WHEN (epoch_us(recorded_at) - epoch_us(lag(recorded_at) OVER w)) / 3.6e9 <= 24 THEN 0 ELSE 1 END AS fresh FROM d WHERE nm <= 25 WINDOW w AS (PARTITION BY owner ORDER BY recorded_at, id)),
 f AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY recorded_at, id)::BIGINT AS visit FROM e) SELECT owner, visit, count(*) AS n, min(recorded_at) AS arrived_at, max(recorded_at) AS left_at, round(avg((sog_raw <= 20)::INT), 6) AS slow_share FROM f GROUP BY 1, 2
 HAVING epoch_us(max(recorded_at)) - epoch_us(min(recorded_at)) >= 1800e6 AND (avg((sog_raw <= 20)::INT) >= 0.25 OR median(sog_raw) <= 10)""")
def port_visits(spark, sf):
    """Runs of rows within a radius, without long breaks, that last and are slow."""
    x = positions(spark, sf).withColumn("nm", geo.haversine(F.col("lat"), F.col("lon"), F.lit(37.0), F.lit(15.0), EARTH_NM)).where("nm <= 25")
    w = sessions.by_owner()
    gap = times.hours_between(F.lag("recorded_at").over(w), F.col("recorded_at"))
    x = x.withColumn("fresh", F.when(gap <= 24, 0).otherwise(1)).withColumn("visit", F.sum("fresh").over(w))
    slow = F.avg((F.col("sog_raw") <= 20).cast("int"))
    v = x.groupBy("owner", "visit").agg(F.count("*").alias("n"), F.min("recorded_at").alias("arrived_at"), F.max("recorded_at").alias("left_at"), slow.alias("s"), F.median("sog_raw").alias("m"))
    return v.where((times.seconds_between(F.col("arrived_at"), F.col("left_at")) >= 1800) & ((F.col("s") >= 0.25) | (F.col("m") <= 10))).select("owner", "visit", "n", "arrived_at", "left_at", F.round("s", 6).alias("slow_share"))


@query(f"""WITH {POSITIONS_SQL}, {_PAIRS}, c AS (SELECT * FROM pairs WHERE outbound_at IS NOT NULL) SELECT c.owner, c.session, count(*) FILTER (p.recorded_at BETWEEN inbound_at AND outbound_at) AS inside, count(*) FILTER (p.recorded_at < inbound_at) AS before,
  count(*) FILTER (p.recorded_at > outbound_at) AS after, round(count(*) FILTER (p.recorded_at BETWEEN inbound_at AND outbound_at) / ((epoch_us(outbound_at) - epoch_us(inbound_at)) / 3.6e9 / 7.2), 5) AS coverage
  FROM c LEFT JOIN pos p ON p.owner = c.owner AND p.recorded_at >= inbound_at - INTERVAL 24 HOUR AND p.recorded_at <= outbound_at + INTERVAL 6 HOUR GROUP BY c.owner, c.session, inbound_at, outbound_at""")
def session_diagnostics(spark, sf):
    p = positions(spark, sf)
    c = sessions.pair_sessions(p).where("outbound_at is not null")
    c = c.withColumns({"since": F.timestamp_add("HOUR", F.lit(-24), F.col("inbound_at")), "until": F.timestamp_add("HOUR", F.lit(6), F.col("outbound_at"))})
    at = F.col("recorded_at")
    inside = F.count_if(at.between(F.col("inbound_at"), F.col("outbound_at")))
    aggs = [inside.alias("inside"), F.count_if(at < F.col("inbound_at")).alias("before"), F.count_if(at > F.col("outbound_at")).alias("after")]
    x = joins.in_windows(p.select("owner", "recorded_at"), c, "owner", "recorded_at", "since", "until", 72, aggs, ["owner", "session", "inbound_at", "outbound_at"])
    expected = times.hours_between(F.col("inbound_at"), F.col("outbound_at")) / 7.2
    return x.select("owner", "session", "inside", "before", "after", F.round(F.col("inside") / expected, 5).alias("coverage"))


@query(f"""WITH {POSITIONS_SQL}, {_PAIRS} SELECT status, reason, count(*) AS n FROM (SELECT CASE WHEN reason = '' THEN 'INCLUDED' ELSE 'EXCLUDED' END AS status, reason FROM (SELECT concat_ws(';', CASE WHEN outbound_at IS NULL THEN 'OPEN' END, CASE WHEN c_custkey IS NULL THEN 'NO_ROLE' END, CASE WHEN c_acctbal < 0 THEN 'ROLE_REJECTED' END) AS reason
  FROM pairs LEFT JOIN customer ON owner = c_custkey AND c_mktsegment <> 'MACHINERY')) GROUP BY 1, 2""")
def audited_truth(spark, sf):
    """Sessions with their owner's role; those that an audit leaves out, with all reasons."""
    from tidelog.functions import text

    roles = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("owner"), "c_acctbal", F.lit(True).alias("known"))
    x = sessions.pair_sessions(positions(spark, sf)).join(roles, "owner", "left")
    reason = text.labels({"OPEN": F.col("outbound_at").isNull(), "NO_ROLE": F.col("known").isNull(), "ROLE_REJECTED": F.col("c_acctbal") < 0})
    return x.groupBy(F.when(reason == "", "INCLUDED").otherwise("EXCLUDED").alias("status"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {DECISIONS_SQL}, g AS (SELECT owner, sum(abs(pred_b - target_h) - abs(pred_a - target_h)) AS gain FROM dec GROUP BY 1) SELECT count(*) AS owners, sum((gain > 0)::INT)::BIGINT AS better, round(max(gain) / sum(gain) FILTER (gain > 0), 6) AS top_share FROM g""")
def gain_diagnostics(spark, sf):
    g = decisions(spark, sf).groupBy("owner").agg(F.sum(F.abs(F.col("pred_b") - F.col("target_h")) - F.abs(F.col("pred_a") - F.col("target_h"))).alias("gain"))
    return g.agg(F.count("*").alias("owners"), F.count_if(F.col("gain") > 0).alias("better"), F.round(F.max("gain") / F.sum(F.when(F.col("gain") > 0, F.col("gain"))), 6).alias("top_share"))


@query(f"""WITH {DECISIONS_SQL} SELECT regime, grade, count(*) AS n, round(sum(target_h) / (SELECT sum(target_h) FROM dec), 6) AS share FROM (SELECT target_h, CASE WHEN target_h < 24 THEN 'NEAR' WHEN target_h < 720 THEN 'MID' WHEN target_h < 8760 THEN 'FAR' ELSE 'IMPLAUSIBLE' END AS regime,
  CASE WHEN n >= 160 THEN 'A' WHEN n >= 140 THEN 'B' ELSE 'C' END AS grade FROM (SELECT *, count(*) OVER (PARTITION BY destination) AS n FROM dec)) GROUP BY 1, 2""")
def label_forensics(spark, sf):
    x = decisions(spark, sf)
    n = x.groupBy("destination").agg(F.count("*").alias("n"))
    x = x.join(F.broadcast(n), "destination").select(
        "target_h",
        numeric.bands(F.col("target_h"), [24, 720, 8760], ["NEAR", "MID", "FAR", "IMPLAUSIBLE"]).alias("regime"),
        F.when(F.col("n") >= 160, "A").when(F.col("n") >= 140, "B").otherwise("C").alias("grade"),
    )
    g = x.groupBy("regime", "grade").agg(F.count("*").alias("n"), F.sum("target_h").alias("t"))
    return g.select("regime", "grade", "n", F.round(F.col("t") / F.sum("t").over(Window.partitionBy()), 6).alias("share"))


_GATES = [(14.9, 36.9), (15.2, 37.2)]
_GATE_NM = "least(" + ", ".join(_hav(EARTH_NM, "lat", "lon", f"{b}e0", f"{a}e0") for a, b in _GATES) + ")"


@query(f"""WITH {POSITIONS_SQL}, n AS (SELECT *, {_GATE_NM} AS nm, lon BETWEEN 14.8 AND 15.3 AND lat BETWEEN 36.8 AND 37.3 AS inside FROM pos) SELECT inside, approach, count(*) AS n, round(avg(nm), 5) AS mean_nm FROM
 (SELECT inside, nm, coalesce(nm < lag(nm) OVER (PARTITION BY owner ORDER BY recorded_at, id) AND NOT inside, false) AS approach FROM n) GROUP BY 1, 2""")
def geometry_labels(spark, sf):
    """Envelope, distance to the nearest gate, and approach: nearer than before and outside."""
    nm = F.least(*(geo.haversine(F.col("lat"), F.col("lon"), F.lit(b), F.lit(a), EARTH_NM) for a, b in _GATES))
    x = positions(spark, sf).withColumns({"nm": nm, "inside": geo.in_box(F.col("lon"), F.col("lat"), 14.8, 36.8, 15.3, 37.3)})
    x = x.withColumn("approach", F.coalesce((F.col("nm") < F.lag("nm").over(sessions.by_owner())) & ~F.col("inside"), F.lit(False)))
    return x.groupBy("inside", "approach").agg(F.count("*").alias("n"), F.round(F.avg("nm"), 5).alias("mean_nm"))


@query("SELECT event_id FROM events WHERE event_type = 'signup' AND CAST(json_extract(props, '$.k') AS INTEGER) BETWEEN 1 AND 31 AND value BETWEEN 0 AND 59 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def candidate_mask(spark, sf):
    """A conjunctive mask; the parts on plain columns are pushed to the scan."""
    start, end = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in (10, 20))
    x = table(spark, sf, "events").where((F.col("event_type") == "signup") & F.col("value").between(0, 59) & (F.col("ts") >= start) & (F.col("ts") < end))
    return x.where(F.get_json_object("props", "$.k").cast("int").between(1, 31)).select("event_id")


def scored_rows(spark, sf):
    """Decisions with a destination's text resolved, the way of their owner before them, and physics: what experts read."""
    names = table(spark, sf, "nation").select("n_name", "n_nationkey")
    n = F.col("n_nationkey")
    places = catalog(spark, sf).withColumns({"lat": 36.0 + F.substring("code", 3, 3).cast("int") / 10, "lon": F.lit(15.0)})
    raw = F.when(F.col("key") % 7 == 0, F.concat(F.lit("home > "), F.col("destination"))).when(F.col("key") % 11 == 0, "FOR ORDERS").otherwise(F.col("destination"))
    x = decisions(spark, sf).join(names, F.col("destination") == F.col("n_name")).drop("n_name").withColumn("text", raw)
    known = experts.resolve(x, places, fuzzy=False).select("text", "canonical", F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), F.col("confidence").alias("confidence_text"), "is_resolved")
    x = x.join(known, "text").drop("destination", "text").withColumnRenamed("canonical", "destination").withColumn("destination_type", F.concat_ws("\u001f", "destination", "ship_type"))
    # The log lies years after the decisions; each owner's is taken for its way before all of them.
    points = positions(spark, sf)
    motion = joins.trailing_motion(points, "owner", "recorded_at", {"180": 18_000, "360": 36_000}, EARTH_KM)
    at, columns = F.struct("recorded_at", "id"), ["lat", "lon", "cog_raw", *(f"{c}_{w}" for c in ("speed", "travelled_km", "net_km") for w in (180, 360))]
    last = motion.groupBy("owner").agg(F.max_by(F.struct(*columns), at).alias("m")).select("owner", "m.*").withColumnRenamed("cog_raw", "cog")
    tracks = experts.trajectories(points, "owner", "recorded_at", ["lon", "lat"], 12).withColumnRenamed("points", "track")
    x = x.join(last, "owner", "left").join(tracks, "owner", "left").withColumn("confidence", F.col("confidence_text"))
    x = experts.physics_features(x, EARTH_NM)
    hours = experts.physics(F.col("distance_nm"), F.col("speed_180"), F.col("speed_360"), F.coalesce("sinuosity_180", F.lit(1.0)))
    return x.withColumn("physics_h", hours)


@query()
def scoring_chain(spark, sf):
    """Owners of the final part by a mixture that the other owners taught: resolver, physics, analogues, gate, risk, interval."""
    shared_folder(spark)
    rows = scored_rows(spark, sf).withColumns({"part": hashing.split("chain", F.col("owner")), "fold": hashing.bucket("chain-fold", F.col("owner"), 2)}).checkpoint()
    x = scoring.mixture(rows.where("part <> 'final'").drop("part"), rows.where("part = 'final'").drop("part"), "target_h", [0, 1])
    return x.select("key", "expert", "tier", "action", *(F.round(c, 3).alias(c) for c in ("hours", "risk_h", "low", "high", *scoring.EXPERTS)))


_ABS = "abs(pred_a - target_h)"


def nested_sql() -> str:
    """For each outer fold: key medians of inner folds' rows outside both, the expert with the least error there, its refit."""
    return f"""WITH {DECISIONS_SQL}, o AS (SELECT unnest(range(5)) AS f), tr AS (SELECT o.f, dec.* FROM o JOIN dec ON fold <> f),
 ig AS (SELECT a.f, a.fold AS g, median(b.target_h) AS m FROM (SELECT DISTINCT f, fold FROM tr) a JOIN tr b ON b.f = a.f AND b.fold <> a.fold GROUP BY 1, 2),
 ik AS (SELECT a.f, a.fold AS g, b.destination AS d, median(b.target_h) AS m FROM (SELECT DISTINCT f, fold FROM tr) a JOIN tr b ON b.f = a.f AND b.fold <> a.fold GROUP BY 1, 2, 3),
 e AS (SELECT tr.f, avg(abs(ig.m - target_h)) AS e0, avg(abs(coalesce(ik.m, ig.m) - target_h)) AS e1, avg({_ABS}) AS e2, avg(abs(pred_b - target_h)) AS e3 FROM tr JOIN ig ON ig.f = tr.f AND ig.g = tr.fold LEFT JOIN ik ON ik.f = tr.f AND ik.g = tr.fold AND ik.d = destination GROUP BY 1),
 w AS (SELECT f, CASE least(e0, e1, e2, e3) WHEN e0 THEN 'global' WHEN e1 THEN 'by_key' WHEN e2 THEN 'pred_a' ELSE 'pred_b' END AS expert FROM e), g AS (SELECT f, median(target_h) AS m FROM tr GROUP BY 1), k AS (SELECT f, destination AS d, median(target_h) AS m FROM tr GROUP BY 1, 2)
 SELECT key, expert, round(CASE expert WHEN 'global' THEN g.m WHEN 'by_key' THEN coalesce(k.m, g.m) WHEN 'pred_a' THEN pred_a ELSE pred_b END, 5) AS hours FROM dec JOIN w ON w.f = fold JOIN g ON g.f = fold LEFT JOIN k ON k.f = fold AND k.d = destination"""


@query(nested_sql())
def nested_selection(spark, sf):
    """The expert of each outer fold, chosen by answers that were fitted inside the other folds only."""
    x = evaluation.nested_selection(decisions(spark, sf), "target_h", "destination", ["pred_a", "pred_b"], "fold", [0, 1, 2, 3, 4])
    return x.select("key", "expert", F.round("hours", 5).alias("hours"))


@query(f"""WITH {DECISIONS_SQL}, s AS (SELECT *, abs(pred_a - pred_b) AS gap, {_ABS} AS ea, abs(pred_b - target_h) AS eb FROM dec), t AS (SELECT unnest([0.0, 100.0, 200.0, 400.0, 800.0, 1600.0])::DOUBLE AS cut),
 m AS (SELECT f, cut, avg(CASE WHEN gap <= cut THEN ea ELSE eb END) AS mae FROM (SELECT unnest(range(5)) AS f) JOIN s ON fold <> f, t GROUP BY 1, 2), b AS (SELECT f, min({{'mae': mae, 'cut': cut}}).cut AS cut FROM m GROUP BY 1)
 SELECT fold, any_value(cut) AS threshold, count(*) AS n, round(avg(CASE WHEN gap <= cut THEN ea ELSE eb END), 5) AS mae FROM s JOIN b ON f = fold GROUP BY 1""")
def threshold_gate(spark, sf):
    """One expert up to a threshold of a score, another beyond it; the threshold is the best of a grid on the other folds."""
    x = decisions(spark, sf).withColumn("gap", F.abs(F.col("pred_a") - F.col("pred_b")))
    x = evaluation.threshold_gated(x, "gap", "pred_a", "pred_b", "target_h", [0.0, 100.0, 200.0, 400.0, 800.0, 1600.0], "fold")
    return x.groupBy("fold").agg(F.first("threshold").alias("threshold"), F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("hours") - F.col("target_h"))), 5).alias("mae"))
