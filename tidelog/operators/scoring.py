"""A mixture of experts, fitted on a development set without looking at what it is to score."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.config import IntervalConfig, PriorConfig
from tidelog.functions import numeric
from tidelog.operators import contracts, evaluation, experts, quantiles
from tidelog.session import shared_folder

EXPERTS = ("prior", "route", "physics", "tabular")
#: Columns that experts and gates read; none may tell the target.
NUMERIC, CATEGORIES = ["distance_nm", "recent_kn", "alignment_deg", "sinuosity_180", "confidence_text", "price", "balance"], ["status"]
#: Shares of a risk below which an answer is given by itself.
FLOOR_H = 1.0


def base_experts(rows: DataFrame, train: DataFrame, target: str, neighbours: int = 5) -> DataFrame:
    """rows with what each expert says who knows train only: the prior, analogues of the track, physics with the median
    residual (the analogues where it isn't eligible), and a ridge over the features.

    rows and train: key, owner, destination, destination_type, track (points or null), eligible, physics_h and the features;
    train also has the target. An owner without a track has the prior's prediction in place of its analogues'.
    """
    x = experts.hierarchical_prior(rows, target, PriorConfig(), train=train)
    x = x.withColumnsRenamed({"prediction": "prior", "support": "prior_support", "weight": "prior_weight"}).drop("level", "level_name")
    tracks = lambda df: df.where("track is not null").groupBy("owner")
    memory = tracks(train).agg(F.first("track").alias("m_points"), F.median(target).alias("m_target"), F.min("destination").alias("m_gate")).withColumnRenamed("owner", "m_owner")
    asked = tracks(rows).agg(F.first("track").alias("q_points"), F.min("destination").alias("q_gate")).select(F.col("owner").alias("q_id"), F.col("owner").alias("q_owner"), "q_gate", "q_points")
    near = experts.analogues(asked, memory, "m_gate", neighbours).select(F.col("q_id").alias("owner"), F.col("prediction").alias("_route"), F.col("gap").alias("route_gap"), F.size("neighbours").alias("route_neighbours"))
    x = x.join(near, "owner", "left").withColumn("route", F.coalesce("_route", "prior")).drop("_route")
    x = experts.residual_corrected(x, "physics_h", target, "eligible", "destination", train=train)
    x = x.withColumn("physics", F.when(F.col("eligible") & F.col("corrected").isNotNull(), F.col("corrected")).otherwise(F.col("route"))).drop("corrected")
    model = evaluation.models(target)["ridge"]
    fitted = Pipeline(stages=[*evaluation.preprocessing(contracts.forbid_leakage(NUMERIC), CATEGORIES), model]).fit(train.select(*NUMERIC, *CATEGORIES, target))
    made = [f"{c}_imp" for c in NUMERIC] + [f"{c}_{end}" for c in CATEGORIES for end in ("ix", "hot")] + ["_num", "_scaled", "features", "prediction"]
    return fitted.transform(x).withColumn("tabular", F.greatest(F.lit(0.0), F.col("prediction"))).drop(*made)


def gating(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """rows with the features that tell which expert to trust, and their names: the experts' answers, how far they lie apart,
    and how well each is supported."""
    answers = [F.col(c) for c in EXPERTS]
    new = {f"g_{c}": F.log1p(F.greatest(F.lit(0.0), F.col(c))) for c in EXPERTS}
    new |= {"g_mean": F.log1p(numeric.row_mean(*answers)), "g_std": F.log1p(numeric.row_std(*answers)), "g_spread": F.log1p(numeric.row_spread(*answers))}
    new |= {"g_support": F.log1p("prior_support"), "g_weight": F.col("prior_weight"), "g_neighbours": F.col("route_neighbours"), "g_gap": F.col("route_gap"), "g_eligible": F.col("eligible").cast("double"), "g_text": F.col("confidence_text")}
    return rows.withColumns({name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in new.items()}), list(new)


def chosen(which: Column) -> Column:
    return F.element_at(F.array(*(F.col(c) for c in EXPERTS)), which.cast("int") + 1)


def mixture(development: DataFrame, fresh: DataFrame, target: str, folds: list[int], cfg: IntervalConfig = IntervalConfig(), seed: int = 7) -> DataFrame:
    """What the mixture says of fresh rows: key, hours, expert, risk_h, low, high, tier, action, and each expert's answer.

    Each development row is answered by experts fitted on the other folds; which of them was nearest is what the gate
    learns, a balanced logistic model over features known beforehand, and the logarithm of the chosen one's error what the
    risk model learns, again from answers of gates that other folds taught. The interval is a conformal share of floor and
    risk; tiers are terciles of the development's risks; the lowest tier defers. Fresh rows are answered by experts fitted
    on the whole development set, and no column of theirs that could tell the target is read.
    """
    # Answers are written out: the plans of what they feed would else hold all of these.
    shared_folder(development.sparkSession)
    parts = [base_experts(development.where(F.col("fold") == f), development.where(F.col("fold") != f), target).checkpoint() for f in folds]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    known, names = gating(whole)
    errors = [F.abs(F.col(c) - F.col(target)) for c in EXPERTS]
    label = F.array_position(F.array(*errors), F.array_min(F.array(*errors))) - 1
    known = known.withColumn("_label", label.cast("double"))
    new, _ = gating(base_experts(fresh.drop(target), development, target).checkpoint())

    def gate(train: DataFrame, *rows: DataFrame) -> list[DataFrame]:
        stages = [VectorAssembler(inputCols=names, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_s", withMean=True)]
        logistic = LogisticRegression(featuresCol="_s", labelCol="_label", weightCol="weight", predictionCol="_which", rawPredictionCol="_raw", probabilityCol="_p", family="multinomial", maxIter=30, regParam=0.01)
        fitted = Pipeline(stages=[*stages, logistic]).fit(evaluation.balanced_weights(train, "_label"))
        return [fitted.transform(x).drop("_x", "_s", "_raw", "_p").withColumn("hours", chosen(F.col("_which"))) for x in rows]

    taught = None
    for f in folds:
        (part,) = gate(known.where(F.col("fold") != f), known.where(F.col("fold") == f))
        taught = part if taught is None else taught.unionByName(part)
    taught = taught.withColumns({"_error": F.abs(F.col("hours") - F.col(target)), "log_hours": F.log1p("hours")}).withColumn("_log", F.log1p("_error")).checkpoint()
    (new,) = gate(known, new)
    new = new.withColumn("log_hours", F.log1p("hours"))
    features = [*names, "log_hours"]
    risk = lambda x: F.greatest(F.lit(0.0), F.expm1(x))
    model = evaluation.models("_log", seed)["boosted"]
    measured = evaluation.out_of_fold(taught.select("key", "fold", "_error", "_log", *features), model, features, [], "fold", folds).withColumn("risk_h", risk(F.col("prediction")))
    fitted = Pipeline(stages=[*evaluation.preprocessing(features, []), model]).fit(taught.select("_log", *features))
    made = [f"{c}_imp" for c in features] + ["_num", "_scaled", "features", "prediction"]
    new = fitted.transform(new).withColumn("risk_h", risk(F.col("prediction"))).drop(*made)
    measured = measured.withColumn("_score", F.col("_error") / (FLOOR_H + F.col("risk_h")))
    scale = evaluation.conformal(measured, "_score", [], cfg.coverage).select(F.col("width").alias("_scale"))
    edges = quantiles.quantiles(measured, [], "risk_h", list(cfg.terciles)).select(F.col("q").alias("_q"))
    x = new.crossJoin(F.broadcast(scale)).crossJoin(F.broadcast(edges))
    half = F.col("_scale") * (FLOOR_H + F.col("risk_h"))
    tier = F.when(F.col("risk_h") <= F.col("_q")[0], "HIGH").when(F.col("risk_h") <= F.col("_q")[1], "MEDIUM").otherwise("LOW")
    x = x.withColumns({"low": F.greatest(F.lit(0.0), F.col("hours") - half), "high": F.col("hours") + half, "tier": tier})
    expert = F.element_at(F.array(*map(F.lit, EXPERTS)), F.col("_which").cast("int") + 1)
    action = F.when(F.col("tier") == "LOW", "DEFER").otherwise("REPORT")
    return x.select("key", "hours", expert.alias("expert"), "risk_h", "low", "high", "tier", action.alias("action"), *EXPERTS)
