"""Queries over retrieval with a recall gate, route neighbours, configuration grids and importances."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import arrays
from tidelog.operators import aggregates, evaluation, experts, joins, quantiles, retrieval
from tidelog.plans import experts as routes
from tidelog.plans.registry import ORACLES, query
from tidelog.sources.domain import DECISIONS_SQL, decisions, positions
from tidelog.sources.tables import table


@query()
def lsh_recall(spark, sf):
    """The share of every row's true neighbours that the buckets find."""
    x = table(spark, sf, "embeddings")
    q, m = x.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_v")), x.select(F.col("vec_id").alias("m_id"), F.col("embedding").alias("m_v"))
    return retrieval.recall(retrieval.approximate(q, m, 10, 1.5), retrieval.exact(q, m, 10), 0.95).withColumn("recall", F.round("recall", 4))


@query(f"""WITH p AS ({ORACLES["polyline_projection"]}) SELECT id, count(*) AS routes, round(median(remaining_km), 6) AS remaining_km, round(min(cross_km), 6) AS cross_km FROM p GROUP BY 1""")
def route_neighbours(spark, sf):
    r = spark.createDataFrame(routes._ROUTES, "route bigint, seq int, lat double, lon double")
    x = experts.along_route(positions(spark, sf).select("id", "lat", "lon"), r, "id", 37.0).withColumns({"cross_km": F.round("cross_km", 5), "remaining_km": F.round("remaining_km", 5)})
    x = retrieval.by_routes(x, "id", 3)
    return x.select("id", "routes", F.round("remaining_km", 6).alias("remaining_km"), F.round("cross_km", 6).alias("cross_km"))


_BANDS = [("A", 0.0, 24.0), ("B", 24.0, 168.0), ("C", 168.0, 720.0), ("D", 720.0, 8760.0), ("E", 8760.0, 87600.0), ("F", 87600.0, 876000.0)]
_BAND_SQL = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in _BANDS)


@query(f"""WITH {DECISIONS_SQL}, b(band, low, high) AS (VALUES {_BAND_SQL}), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY owner) AS w FROM dec) SELECT band, count(key) AS n, round(sum(w * abs(pred_a - target_h)) / sum(w), 5) AS w_mae, round(sum(w * (abs(pred_a - target_h) <= 24)::INT) / sum(w), 6) AS w_hit
  FROM b LEFT JOIN w ON target_h >= low AND target_h < high GROUP BY 1""")
def horizon_metrics(spark, sf):
    """Weighted metrics by horizon; bands without rows stay, with none."""
    x = decisions(spark, sf).withColumns({"w": 1.0 / F.count("*").over(Window.partitionBy("owner")), "e": F.abs(F.col("pred_a") - F.col("target_h"))})
    band = F.coalesce(*(F.when((F.col("target_h") >= a) & (F.col("target_h") < b), F.lit(n)) for n, a, b in _BANDS))
    got = x.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("e")) / F.sum("w"), 5).alias("w_mae"), F.round(F.sum(F.col("w") * (F.col("e") <= 24).cast("int")) / F.sum("w"), 6).alias("w_hit"))
    bands = spark.createDataFrame([(n,) for n, _, _ in _BANDS], "band string")
    return bands.join(got, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), "w_mae", "w_hit")


@query(f"""WITH {DECISIONS_SQL}, f AS (SELECT DISTINCT fold FROM dec), g AS (SELECT f.fold AS gf, median(target_h) AS gm FROM f JOIN dec d ON d.fold <> f.fold GROUP BY 1), s AS (SELECT f.fold AS sf, destination AS sk, median(target_h) AS m, count(*) AS n FROM f JOIN dec d ON d.fold <> f.fold GROUP BY 1, 2),
 c(alpha, least_n) AS (VALUES (0::DOUBLE, 1), (0::DOUBLE, 100), (10::DOUBLE, 1), (10::DOUBLE, 100), (50::DOUBLE, 1), (50::DOUBLE, 100)), p AS (SELECT alpha, least_n, abs(target_h - CASE WHEN n >= least_n THEN n / (n + alpha) * m + alpha / (n + alpha) * gm ELSE gm END) AS e FROM dec JOIN g ON gf = fold LEFT JOIN s ON sf = fold AND sk = destination, c),
 m AS (SELECT 'a' || alpha::INT || '_n' || least_n AS config, round(avg(e), 5) AS mae, round(quantile_cont(e, 0.9), 5) AS p90, round(quantile_cont(e, 0.5), 5) AS medae FROM p GROUP BY alpha, least_n) SELECT config, mae, p90, medae FROM m ORDER BY mae, p90, medae, config LIMIT 1""")
def config_grid(spark, sf):
    """The best of a grid of shrinkages: statistics are made once, configurations are a table."""
    x = decisions(spark, sf)
    top, own = quantiles.by_levels(x, [None, "destination"], "target_h", [0.5], "fold")
    top = top.select(F.col("_f").alias("fold"), F.col("q")[0].alias("gm"))
    own = own.select(F.col("_f").alias("fold"), F.col("_k").alias("destination"), F.col("q")[0].alias("m"), "n")
    grid = spark.createDataFrame([(float(a), n) for a in (0, 10, 50) for n in (1, 100)], "alpha double, least_n int")
    rows = x.join(F.broadcast(top), "fold").join(own, ["fold", "destination"], "left").crossJoin(F.broadcast(grid))
    w = F.col("n") / (F.col("n") + F.col("alpha"))
    p = F.when(F.col("n") >= F.col("least_n"), w * F.col("m") + (1 - w) * F.col("gm")).otherwise(F.col("gm"))
    e = F.abs(F.col("target_h") - p)
    config = F.concat(F.lit("a"), F.col("alpha").cast("int").cast("string"), F.lit("_n"), F.col("least_n").cast("string"))
    m = quantiles.summary(rows.select(config.alias("config"), e.alias("e")), ["config"], "e", [F.round(F.avg("e"), 5).alias("mae")], {"p90": 0.9, "medae": 0.5}, 5)
    return aggregates.selected(m, ["mae", "p90", "medae"], "config")


@query()
def graph_recall(spark, sf):
    """Owners found by graphs against those of the exact comparison, and what share of the rows a search met."""
    x = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("owner"), F.col("label").alias("gate"), "embedding")
    q = x.where("vec_id % 100 = 0").select(*(F.col(a).alias(b) for a, b in (("vec_id", "q_id"), ("owner", "q_owner"), ("gate", "q_gate"), ("embedding", "q_v"))))
    m = x.select(*(F.col(a).alias(f"m_{b}") for a, b in (("vec_id", "id"), ("owner", "owner"), ("gate", "gate"), ("embedding", "v"))))
    found = retrieval.graph_neighbours(q, m, 5)
    pairs = joins.all_pairs(q, m, "m_id", [("q_gate", "m_gate")]).where("q_owner <> m_owner")
    best = pairs.groupBy("q_id", "m_owner").agg(F.min(arrays.cosine_distance(F.col("q_v"), F.col("m_v"))).alias("d"))
    truth = best.withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy("d", "m_owner"))).where("r <= 5")
    hit = truth.join(found.select("q_id", "m_owner", F.lit(1).alias("hit")), ["q_id", "m_owner"], "left")
    gates = m.groupBy(F.col("m_gate").alias("q_gate")).agg(F.count("*").alias("rows"))
    met = found.select("q_id", "evaluated").distinct().join(q.select("q_id", "q_gate"), "q_id").join(gates, "q_gate").agg(F.avg(F.col("evaluated") / F.col("rows")).alias("met"))
    x = hit.agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return x.crossJoin(met).select("n", F.round("recall", 4).alias("recall"), F.round("met", 4).alias("met"), (F.col("recall") >= 0.9).alias("passed"))


@query()
def support_vectors(spark, sf):
    """Out-of-fold answers of a support-vector regression with a radial kernel."""
    x = decisions(spark, sf).select("key", "fold", "price", "balance", "pred_a", "target_h")
    x = evaluation.support_vectors(x, ["price", "balance", "pred_a"], "target_h", "fold", [0, 1, 2, 3, 4])
    return x.select("key", F.round("prediction", 3).alias("prediction"))


@query()
def feature_importance(spark, sf):
    x = decisions(spark, sf).select("price", "balance", "pred_a", "status", "target_h")
    fitted = Pipeline(stages=[*evaluation.preprocessing(["price", "balance", "pred_a"], ["status"]), evaluation.models("target_h")["forest"]]).fit(x)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(fitted.stages[-1].featureImportances.toArray())], "feature int, importance double")


@query()
def feature_attribution(spark, sf):
    """How far each feature moves a ridge regression's answers."""
    measures, categories = ["price", "balance", "pred_a"], ["status", "ship_type"]
    x = decisions(spark, sf).select("key", *measures, *categories, "target_h")
    fitted = Pipeline(stages=[*evaluation.preprocessing(measures, categories), evaluation.models("target_h")["ridge"]]).fit(x)
    found = evaluation.attributions(x, fitted, measures, categories)
    return found.select("key", *(F.round(c, 4).alias(c) for c in ("prediction", "base", *(f"by_{c}" for c in [*measures, *categories]))))
