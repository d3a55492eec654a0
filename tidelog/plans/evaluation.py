"""Queries over ensembles, intervals, selective prediction, stress, gates and fitted models."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.config import EARTH_KM
from tidelog.functions import numeric
from tidelog.operators import evaluation, external, quantiles
from tidelog.plans.registry import query
from tidelog.plans.scalars import _hav
from tidelog.plans.temporal import STATES_SQL, state_rows
from tidelog.sources.domain import DECISIONS_SQL, decisions
from tidelog.sources.tables import table

_A = "abs(pred_a - target_h)"
_RISK = "(1 + abs(pred_a - pred_b))"


def scored(spark, sf):
    x = decisions(spark, sf)
    return x.withColumns({"error": F.abs(F.col("pred_a") - F.col("target_h")), "risk": 1 + F.abs(F.col("pred_a") - F.col("pred_b"))})


@query(f"""WITH {DECISIONS_SQL}, f AS (SELECT DISTINCT fold FROM dec), g AS (SELECT f.fold AS gf, median(target_h) AS m FROM f JOIN dec d ON d.fold <> f.fold GROUP BY 1), k AS (SELECT f.fold AS kf, destination AS kd, median(target_h) AS km FROM f JOIN dec d ON d.fold <> f.fold GROUP BY 1, 2)
 SELECT key, round(m, 5) AS global_median, round(coalesce(km, m), 5) AS key_median FROM dec JOIN g ON gf = fold LEFT JOIN k ON kf = fold AND kd = destination""")
def oof_median_baselines(spark, sf):
    return evaluation.median_baselines(decisions(spark, sf), "target_h", "destination").select("key", F.round("global_median", 5).alias("global_median"), F.round("key_median", 5).alias("key_median"))


@query()
def nnls_blend(spark, sf):
    x = decisions(spark, sf)
    names = ["pred_a", "pred_b", "pred_c"]
    return evaluation.blended(x, names, evaluation.blend_weights(x, names, "target_h", "fold"), "fold").select("key", F.round("blend", 4).alias("blend"))


@query(f"""WITH {DECISIONS_SQL} SELECT best, count(*) AS n, round(avg(chosen - least(a, b, c)), 6) AS regret, round(avg(m), 6) AS median_blend FROM (SELECT *, CASE least(a, b, c) WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'c' END AS best, a AS chosen, list_sort([pred_a, pred_b, pred_c])[2] AS m
  FROM (SELECT *, {_A} AS a, abs(pred_b - target_h) AS b, abs(pred_c - target_h) AS c FROM dec)) GROUP BY 1""")
def oracle_expert(spark, sf):
    x = decisions(spark, sf)
    e = [F.abs(F.col(f"pred_{m}") - F.col("target_h")) for m in "abc"]
    x = x.select(numeric.argmin(e, list("abc")).alias("best"), (e[0] - F.least(*e)).alias("r"), numeric.row_median(*(F.col(f"pred_{m}") for m in "abc")).alias("m"))
    return x.groupBy("best").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("regret"), F.round(F.avg("m"), 6).alias("median_blend"))


_INTERVAL = f"""WITH {DECISIONS_SQL}, s AS (SELECT *, {_A} AS error, {_RISK} AS risk FROM dec), f AS (SELECT DISTINCT fold FROM dec), o AS (SELECT f.fold AS wf, error / risk AS q, row_number() OVER (PARTITION BY f.fold ORDER BY error / risk) AS r, count(*) OVER (PARTITION BY f.fold) AS n FROM f JOIN s ON s.fold <> f.fold),
 w AS (SELECT wf, n, q AS width FROM o WHERE r = least(n, greatest(1, ceil((n + 1) * 8e-1)))), i AS (SELECT s.*, greatest(0, pred_a - width * risk) AS low, pred_a + width * risk AS high FROM s JOIN w ON wf = fold)"""


@query(_INTERVAL + " SELECT key, round(low, 4) AS low, round(high, 4) AS high FROM i")
def conformal_interval(spark, sf):
    return evaluation.intervals(scored(spark, sf), "pred_a", "risk", "error", "fold").select("key", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(_INTERVAL + " SELECT status, count(*) AS n, round(avg((target_h BETWEEN low AND high)::INT), 6) AS coverage, round(avg(high - low), 4) AS mean_width, round(quantile_cont(high - low, 0.9), 4) AS p90_width FROM i GROUP BY 1")
def interval_metrics(spark, sf):
    x = evaluation.intervals(scored(spark, sf), "pred_a", "risk", "error", "fold").select("status", "target_h", "low", "high", (F.col("high") - F.col("low")).alias("width"))
    inside = F.avg(F.col("target_h").between(F.col("low"), F.col("high")).cast("int"))
    return quantiles.summary(x, ["status"], "width", [F.count("*").alias("n"), F.round(inside, 6).alias("coverage"), F.round(F.avg("width"), 4).alias("mean_width")], {"p90_width": 0.9}, 4)


@query(f"""WITH {DECISIONS_SQL}, s AS (SELECT *, {_A} AS error, {_RISK} AS risk FROM dec), q AS (SELECT f.fold AS qf, quantile_cont(risk, 1 / 3::DOUBLE) AS a, quantile_cont(risk, 2 / 3::DOUBLE) AS b FROM (SELECT DISTINCT fold FROM dec) f JOIN s ON s.fold <> f.fold GROUP BY 1)
 SELECT confidence, count(*) AS n, round(avg(error), 5) AS mae FROM (SELECT *, CASE WHEN risk <= a THEN 'HIGH' WHEN risk <= b THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s JOIN q ON qf = fold) GROUP BY 1""")
def confidence_terciles(spark, sf):
    return evaluation.terciles(scored(spark, sf), "risk", "fold").groupBy("confidence").agg(F.count("*").alias("n"), F.round(F.avg("error"), 5).alias("mae"))


@query(f"""WITH {DECISIONS_SQL}, s AS (SELECT {_A} AS error, {_RISK} AS risk FROM dec), o AS (SELECT risk, row_number() OVER (ORDER BY risk) AS r, count(*) OVER () AS n FROM s), t AS (SELECT coverage, risk AS threshold FROM o, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) v(coverage) WHERE r = ceil(coverage * (n - 1)) + 1)
 SELECT coverage, threshold, count(*) AS retained, round(avg(error), 5) AS mae FROM t JOIN s ON risk <= threshold GROUP BY 1, 2""")
def risk_coverage_curve(spark, sf):
    x = evaluation.risk_coverage(scored(spark, sf), "risk", "error", [0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
    return x.select("coverage", "threshold", "retained", F.round("mae", 5).alias("mae"))


@query(f"""WITH {DECISIONS_SQL}, s AS (SELECT *, {_A} AS e FROM dec), q AS (SELECT quantile_cont(e, 0.95) AS edge FROM s) SELECT round(avg(e), 5) AS mae, round(avg(CASE WHEN e <= edge THEN e END), 5) AS trimmed, round(avg(least(e, edge)), 5) AS winsorised FROM s, q""")
def trim_winsor_stress(spark, sf):
    x = scored(spark, sf)
    edge = quantiles.quantiles(x, [], "error", [0.95]).select(F.col("q")[0].alias("edge"))
    out = evaluation.stressed(F.col("error"), F.col("edge"))
    return x.crossJoin(F.broadcast(edge)).agg(F.round(F.avg("error"), 5).alias("mae"), *(F.round(v, 5).alias(k) for k, v in out.items()))


@query(f"""WITH {DECISIONS_SQL}, s AS (SELECT destination, sum({_A}) AS e, count(*) AS n FROM dec GROUP BY 1) SELECT destination, round((sum(e) OVER () - e) / (sum(n) OVER () - n), 5) AS mae_without FROM s""")
def leave_one_out(spark, sf):
    w = Window.partitionBy()
    x = scored(spark, sf).groupBy("destination").agg(F.sum("error").alias("e"), F.count("*").alias("n"))
    return x.select("destination", F.round((F.sum("e").over(w) - F.col("e")) / (F.sum("n").over(w) - F.col("n")), 5).alias("mae_without"))


@query(f"""WITH {DECISIONS_SQL} SELECT status, count(*) AS n, round(avg(abs((pred_b + pred_c) / 2 - target_h)), 5) AS without_a, round(avg(abs((pred_a + pred_c) / 2 - target_h)), 5) AS without_b FROM dec GROUP BY 1""")
def structural_counterfactual(spark, sf):
    x = decisions(spark, sf)
    e = lambda *ps: F.round(F.avg(F.abs(numeric.row_median(*(F.col(p) for p in ps)) - F.col("target_h"))), 5)
    return x.groupBy("status").agg(F.count("*").alias("n"), e("pred_b", "pred_c").alias("without_a"), e("pred_a", "pred_c").alias("without_b"))


@query(f"""WITH {DECISIONS_SQL}, m AS (SELECT avg({_A}) AS a, avg(abs(pred_b - target_h)) AS b, quantile_cont({_A}, 0.9) AS p90, count(*) AS n FROM dec) SELECT a < b AS beats, p90 < 1e5 AS tail, n >= 20 AS enough, a < b AND p90 < 1e5 AND n >= 20 AS promoted FROM m""")
def promotion_gate(spark, sf):
    x = decisions(spark, sf)
    ea, eb = (F.abs(F.col(p) - F.col("target_h")) for p in ("pred_a", "pred_b"))
    m = quantiles.summary(x.select(ea.alias("e"), eb.alias("f")), [], "e", [F.avg("e").alias("a"), F.avg("f").alias("b"), F.count("*").alias("n")], {"p90": 0.9}, 12)
    return evaluation.gate(m, {"beats": F.col("a") < F.col("b"), "tail": F.col("p90") < 1e5, "enough": F.col("n") >= 20})


@query(f"""WITH {DECISIONS_SQL}, s AS (SELECT ship_type, count(*) AS n, avg({_A}) AS a, avg(abs(pred_b - target_h)) AS b FROM dec GROUP BY 1) SELECT ship_type, n, round(a / nullif(b, 0), 6) AS ratio, n >= 20 AND a > 1.10 * b AS regressed FROM s""")
def slice_regression_audit(spark, sf):
    x = decisions(spark, sf)
    a, b = (F.avg(F.abs(F.col(p) - F.col("target_h"))) for p in ("pred_a", "pred_b"))
    return x.groupBy("ship_type").agg(F.count("*").alias("n"), F.round(F.try_divide(a, b), 6).alias("ratio"), ((F.count("*") >= 20) & (a > 1.10 * b)).alias("regressed"))


_DRAW = "(CAST('0x' || substr(sha256(owner || '|' || rep || '|20260918'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


def _draws() -> str:
    cdf, p, out = 0.0, math.exp(-1), []
    for k in range(1, 9):
        cdf += p
        out.append(f"(u > {cdf!r}::DOUBLE)::INT")
        p /= k
    return " + ".join(out)


def _bootstrap_sql(strata: str) -> str:
    return f"""WITH {DECISIONS_SQL}, un AS (SELECT owner, {strata} AS s, sum(abs(pred_b - target_h) - {_A}) AS d, count(*) AS n FROM dec GROUP BY ALL), x AS (SELECT *, {_DRAW} AS u FROM un, (SELECT unnest(range(500)) AS rep)),
 p AS (SELECT rep, s, sum(w * d) / nullif(sum(w * n), 0) AS g, sum(n) AS n FROM (SELECT *, {_draws()} AS w FROM x) GROUP BY ALL), q AS (SELECT rep, sum(g * n) / sum(n) FILTER (g IS NOT NULL) AS gain FROM p GROUP BY 1)
 SELECT round(avg(gain), 4) AS mean, round(quantile_cont(gain, 0.025), 4) AS low, round(quantile_cont(gain, 0.975), 4) AS high, round(avg((gain > 0)::INT), 6) AS share_positive FROM q"""


def bootstrapped(spark, sf, strata: str | None):
    x = decisions(spark, sf).select("owner", "fold", (F.col("pred_b") - F.col("target_h")).alias("b"), (F.col("pred_a") - F.col("target_h")).alias("a"))
    found = evaluation.bootstrap(x, "b", "a", "owner", 500, 20260918, strata)
    return found.select(*(F.round(c, 4).alias(c) for c in ("mean", "low", "high")), F.round("share_positive", 6).alias("share_positive"))


@query(_bootstrap_sql("0"))
def bootstrap_ci(spark, sf):
    return bootstrapped(spark, sf, None)


@query(_bootstrap_sql("fold"))
def bootstrap_by_fold(spark, sf):
    """The same with the rows of each fold resampled among themselves."""
    return bootstrapped(spark, sf, "fold")


@query()
def tabular_oof(spark, sf):
    x = decisions(spark, sf).select("key", "fold", "price", "balance", "pred_a", "status", "ship_type", "target_h")
    return evaluation.out_of_fold(x, evaluation.models("target_h")["ridge"], ["price", "balance", "pred_a"], ["status", "ship_type"], "fold", [0, 1, 2, 3, 4]).select("key", F.round("prediction", 3).alias("prediction"))


@query()
def risk_model(spark, sf):
    x = scored(spark, sf).select("key", "fold", "price", "balance", "risk", "status", F.log1p("error").alias("log_error"))
    model = evaluation.models("log_error")["boosted"]
    return evaluation.out_of_fold(x, model, ["price", "balance", "risk"], ["status"], "fold", [0, 1, 2, 3, 4]).select("key", F.round(F.greatest(F.lit(0.0), F.expm1("prediction")), 3).alias("risk_h"))


@query()
def soft_gate(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double"), F.length(F.regexp_replace("text", "[^.]", "")).cast("double").alias("dots"), F.col("quality").cast("double"))
    x = evaluation.soft_gate(evaluation.balanced_weights(docs, "quality"), ["n_chars", "dots"], "quality", "weight")
    return x.select("doc_id", F.round(F.col("probability")[1], 4).alias("p"))


@query()
def linear_embedding(spark, sf):
    x = evaluation.embedded(table(spark, sf, "embeddings"), "embedding", 8)
    return x.select("vec_id", F.transform("components", lambda v: F.round(v, 5)).alias("components"))


@query(f"""WITH c AS (SELECT user_id AS owner, min({{'h': sha256('cohort|' || event_id), 't': ts, 'i': event_id}}) AS x FROM events WHERE event_type = 'click' GROUP BY 1), d AS (SELECT owner, x.t AS decided_at, x.i AS id FROM c WHERE x.t >= TIMESTAMP '2024-01-03')
 SELECT sha256(d.owner || '|' || strftime(decided_at, '%Y-%m-%dT%H:%M:%S')) AS sample_key, count(h.event_id) AS history, round(avg(h.value), 5) AS mean_value,
  round((SELECT min(epoch_us(l.ts) - epoch_us(d.decided_at)) FROM events l WHERE l.user_id = d.owner AND l.event_type = 'purchase' AND l.ts > d.decided_at) / 3.6e9, 5) AS label_h FROM d
 LEFT JOIN events h ON h.user_id = d.owner AND h.ts <= decided_at AND h.ts >= decided_at - INTERVAL 48 HOUR GROUP BY d.owner, d.decided_at""")
def external_cohort(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type", "value")
    cohort = external.cohort(e.where("event_type = 'click'"), "cohort", "2024-01-03 00:00:00")
    features = external.history(cohort, e, 48)
    labels = external.reveal(cohort, e.where("event_type = 'purchase'"))
    return features.join(labels, "sample_key").select("sample_key", "history", F.round("mean_value", 5).alias("mean_value"), F.round("label_h", 5).alias("label_h"))


def _window_sql(name: str, minutes: int) -> str:
    inside = f"age <= {minutes}"
    first, last = (f"{pick}({{{{'lat': lat, 'lon': lon}}}}, epoch_us(recorded_at)) FILTER ({inside})" for pick in ("arg_min", "arg_max"))
    return (
        f"round(median(sog_clean) FILTER ({inside}), 5) AS speed_{name}, round(coalesce(stddev_samp(sog_clean) FILTER ({inside}), CASE WHEN count(sog_clean) FILTER ({inside}) = 1 THEN 0 END), 5) AS speed_std_{name}, "
        f"round(avg(moving::INT) FILTER ({inside}), 5) AS moving_share_{name}, round(avg(stopped::INT) FILTER ({inside}), 5) AS stopped_share_{name}, count(*) FILTER ({inside} AND turning) AS turns_{name}, "
        f"round(sum(coalesce(step_m, 0)) FILTER ({inside}) / 1000, 4) AS travelled_km_{name}, {first} AS first_{name}, {last} AS last_{name}, count(*) FILTER ({inside} AND id IS NOT NULL) AS n_{name}"
    ).replace("{{", "{").replace("}}", "}")


def _net_sql(name: str) -> str:
    return f"CASE WHEN n_{name} >= 2 THEN round({_hav(EARTH_KM, f'first_{name}.lat', f'first_{name}.lon', f'last_{name}.lat', f'last_{name}.lon')}, 4) END AS net_km_{name}"


_FEATURES = [f"{c}_{w}" for w in ("short", "long") for c in ("speed", "speed_std", "moving_share", "stopped_share", "turns", "travelled_km")]


@query(
    STATES_SQL
    + f""", c AS (SELECT user_id AS owner, min({{'h': sha256('holdout|' || event_id), 't': ts, 'i': event_id}}) AS x FROM events WHERE event_type = 'click' AND value <= 40 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1),
 d AS (SELECT sha256(owner || '|' || strftime(x.t, '%Y-%m-%dT%H:%M:%S')) AS sample_key, owner, x.t AS decided_at FROM c WHERE x.t >= TIMESTAMP '2024-01-03' ORDER BY 1 LIMIT 1000),
 j AS (SELECT sample_key, st.*, (epoch_us(decided_at) - epoch_us(recorded_at)) / 6e7 AS age FROM d LEFT JOIN st ON st.owner = d.owner AND recorded_at BETWEEN decided_at - INTERVAL 96 HOUR AND decided_at),
 g AS (SELECT sample_key, count(DISTINCT recorded_at) AS points, round(min(age), 4) AS age_min, count(*) FILTER (gap) AS gaps, {_window_sql("short", 1440)}, {_window_sql("long", 4320)} FROM j GROUP BY 1)
 SELECT sample_key, points, age_min, gaps, {", ".join(_FEATURES)}, {_net_sql("short")}, {_net_sql("long")}, CASE WHEN points < 3 THEN 'INSUFFICIENT_HISTORY' WHEN age_min > 30 THEN 'STALE' ELSE '' END AS reason FROM g"""
)
def external_features(spark, sf):
    """A cohort without labels, and what was known of it beforehand; windows of a day and of three, as the events lie that far apart."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type", "value")
    blocked = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("owner"))
    cohort = external.candidates(e, (F.col("event_type") == "click") & (F.col("value") <= 40), blocked, "holdout", "2024-01-03 00:00:00", 1000)
    states = state_rows(spark, sf).withColumn("sog", F.col("sog_clean"))
    x = external.window_features(cohort, states, 96, {"short": 1440, "long": 4320}, 3, 30.0, EARTH_KM)
    counts = {"sample_key", "points", "gaps", "reason", "turns_short", "turns_long"}
    digits = lambda c: 4 if c == "age_min" or "_km_" in c else 5
    return x.drop("valid_share").select(*(F.col(c) if c in counts else F.round(c, digits(c)).alias(c) for c in x.columns if c != "valid_share"))
