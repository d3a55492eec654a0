"""Ensembles and their evaluation: blends, intervals, selective prediction, bootstrap, gates, MLlib panels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.config import IntervalConfig
from tidelog.functions import hashing, numeric
from tidelog.operators import quantiles
from tidelog.session import written


def median_baselines(rows: DataFrame, target: str, key: str, fold: str = "fold") -> DataFrame:
    """Out-of-fold global and per-key medians with fallback: all folds in one plan."""
    top, own = quantiles.by_levels(rows, [None, key], target, [0.5], fold)
    top, own = top.select("_f", F.col("q")[0].alias("global_median")), own.select(F.col("_f").alias("_f2"), "_k", F.col("q")[0].alias("_m"))
    x = rows.join(F.broadcast(top), F.col(fold) == F.col("_f"), "left").drop("_f")
    x = x.join(own, (F.col(fold) == F.col("_f2")) & (F.col(key).cast("string") == F.col("_k")), "left")
    return x.withColumn("key_median", F.coalesce("_m", "global_median")).drop("_f2", "_k", "_m")


def nested_selection(rows: DataFrame, target: str, key: str, given: list[str], fold: str, folds: list[int]) -> DataFrame:
    """expert and hours of each row: for its fold, the expert that did best on the other folds, where medians were fitted
    without the fold and without the fold of the row they answered; then the medians are fitted on all other folds.

    Experts: the global median, the key's median (the global one where it is unknown), and given columns.
    """
    names = ["global", "by_key", *given]
    rows = written(rows)
    out = None
    for f in folds:
        train, test = rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)
        inner = median_baselines(train, target, key, fold).withColumnsRenamed({"global_median": "global", "key_median": "by_key"})
        errors = [F.avg(F.abs(F.col(c) - F.col(target))) for c in names]
        best = inner.agg(numeric.argmin(errors, names).alias("expert"))
        top, own = quantiles.by_levels(train, [None, key], target, [0.5])
        top, own = top.select(F.col("q")[0].alias("global")), own.select("_k", F.col("q")[0].alias("_own"))
        x = test.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(top)).join(own, F.col(key).cast("string") == F.col("_k"), "left").withColumn("by_key", F.coalesce("_own", "global"))
        hours = F.coalesce(*(F.when(F.col("expert") == c, F.col(c)) for c in names))
        x = x.withColumn("hours", hours).select(*rows.columns, "expert", "hours")
        out = x if out is None else out.unionByName(x)
    return out


def threshold_gated(rows: DataFrame, score: str, below: str, above: str, target: str, grid: list[float], fold: str) -> DataFrame:
    """threshold and hours: `below` up to a threshold of the score and `above` beyond it; a fold's threshold is that of the
    grid with the least mean error on the other folds, the lowest on ties. One aggregation serves all folds and thresholds."""
    error = lambda c: F.abs(F.col(c) - F.col(target))
    sums = rows.groupBy(fold).agg(F.count(target).alias("n"), *(F.sum(F.when(F.col(score) <= t, error(below)).otherwise(error(above))).alias(f"_{i}") for i, t in enumerate(grid)))
    cells = sums.select(fold, "n", F.posexplode(F.array(*(f"_{i}" for i in range(len(grid))))).alias("i", "e"))
    every = Window.partitionBy("i")
    rest = cells.withColumn("mae", (F.sum("e").over(every) - F.col("e")) / (F.sum("n").over(every) - F.col("n")))
    best = rest.groupBy(fold).agg(F.min(F.struct("mae", "i")).alias("b")).select(fold, F.element_at(F.array(*map(F.lit, grid)), F.col("b.i") + 1).alias("threshold"))
    return rows.join(best, fold).withColumn("hours", F.when(F.col(score) <= F.col("threshold"), F.col(below)).otherwise(F.col(above)))


def nnls(gram: np.ndarray, moment: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights of at least 0 that minimise w'Gw - 2 m'w, then made to sum to 1; by active sets on a small matrix."""
    n = len(moment)
    passive, w = np.zeros(n, bool), np.zeros(n)
    for _ in range(rounds):
        slope = moment - gram @ w
        if passive.all() or slope[~passive].max() <= 1e-9 * max(1.0, np.abs(moment).max()):
            break
        passive[np.flatnonzero(~passive)[np.argmax(slope[~passive])]] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(gram[np.ix_(passive, passive)], moment[passive], rcond=None)[0]
            if z[passive].min() > 0:
                break
            bad = passive & (z <= 0)
            part = (w[bad] / np.maximum(w[bad] - z[bad], 1e-300)).min()
            w = w + part * (z - w)
            passive &= w > 1e-12
            w[~passive] = 0
            if not passive.any():
                return np.full(n, 1 / n)
        w = z
    total = w.sum()
    return w / total if total > 0 else np.full(n, 1 / n)


def blend_weights(rows: DataFrame, experts: list[str], target: str, fold: str) -> dict[int, np.ndarray]:
    """For each fold, weights fitted on the other folds. One aggregation of the products of columns by fold is all that is read."""
    cols = [*experts, target]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    parts = {x[fold]: x for x in rows.groupBy(fold).agg(*sums).collect()}
    n = len(experts)
    full = {f: np.array([[x[f"{min(i, j)}_{max(i, j)}"] for j in range(n + 1)] for i in range(n + 1)], float) for f, x in parts.items()}
    out = {}
    for f in full:
        rest = sum((m for g, m in full.items() if g != f), np.zeros((n + 1, n + 1)))
        out[f] = nnls(rest[:n, :n], rest[:n, n])
    return out


def blended(rows: DataFrame, experts: list[str], weights: dict[int, np.ndarray], fold: str) -> DataFrame:
    expr = None
    for f, w in weights.items():
        value = sum((F.col(c) * float(x) for c, x in zip(experts, w, strict=True)), F.lit(0.0))
        expr = F.when(F.col(fold) == f, value) if expr is None else expr.when(F.col(fold) == f, value)
    return rows.withColumn("blend", expr)


def conformal_place(n: Column, coverage: float) -> Column:
    """k = ceil((n + 1) * coverage) within 1..n."""
    return F.least(n, F.greatest(F.lit(1), F.ceil((n + 1) * coverage))).cast("bigint")


def conformal(rows: DataFrame, score: str, by: list[str], coverage: float) -> DataFrame:
    """(by, n, width): the k-th smallest score of each group."""
    return quantiles.statistics(rows, by, score, lambda n: F.array(conformal_place(n, coverage))).select(*by, "n", F.col(score).alias("width"))


def intervals(rows: DataFrame, prediction: str, risk: str, score: str, fold: str, cfg: IntervalConfig = IntervalConfig()) -> DataFrame:
    """low and high for each row from the scaled scores of the other folds: |error| / risk, times the row's own risk."""
    x = rows.withColumn("_s", F.col(score) / F.greatest(F.col(risk), F.lit(1e-6)))
    width = quantiles.statistics(x, [], "_s", lambda n: F.array(conformal_place(n, cfg.coverage)), fold).select("_f", F.col("_s").alias("width"))
    x = rows.join(F.broadcast(width), F.col(fold) == F.col("_f")).drop("_f")
    half = F.col("width") * F.greatest(F.col(risk), F.lit(1e-6))
    return x.withColumns({"low": F.greatest(F.lit(0.0), F.col(prediction) - half), "high": F.col(prediction) + half}).drop("width")


def terciles(rows: DataFrame, risk: str, fold: str, cfg: IntervalConfig = IntervalConfig()) -> DataFrame:
    """confidence HIGH, MEDIUM or LOW by the tercile edges of the other folds' risks."""
    edges = quantiles.quantiles(rows, [], risk, list(cfg.terciles), fold).select("_f", F.col("q").alias("_q"))
    x = rows.join(F.broadcast(edges), F.col(fold) == F.col("_f"))
    level = F.when(F.col(risk) <= F.col("_q")[0], "HIGH").when(F.col(risk) <= F.col("_q")[1], "MEDIUM").otherwise("LOW")
    return x.withColumn("confidence", level).drop("_f", "_q")


def risk_coverage(rows: DataFrame, risk: str, error: str, coverages: list[float]) -> DataFrame:
    """(coverage, retained, threshold, mae) at the risk quantile `higher` for each target coverage.

    The thresholds are order statistics; then all coverages are conditional aggregates of one pass.
    """
    place = lambda n, c: (F.ceil(F.lit(c) * (n - 1)) + 1).cast("bigint")
    edges = quantiles.statistics(rows, [], risk, lambda n: F.array(*(place(n, c) for c in coverages)))
    row = edges.agg(*(F.max(F.when(F.col("place") == place(F.col("n"), c), F.col(risk))).alias(f"_t{i}") for i, c in enumerate(coverages)))
    x = rows.select(F.col(risk).alias("_r"), F.abs(error).alias("_e")).crossJoin(F.broadcast(row))
    inside = [F.col("_r") <= F.col(f"_t{i}") for i in range(len(coverages))]
    found = x.agg(*(F.struct(F.lit(c).alias("coverage"), F.count_if(t).alias("retained"), F.max(f"_t{i}").alias("threshold"), F.avg(F.when(t, F.col("_e"))).alias("mae")).alias(f"_{i}") for i, (c, t) in enumerate(zip(coverages, inside, strict=True))))
    return found.select(F.inline(F.array(*(f"_{i}" for i in range(len(coverages))))))


def stressed(error: Column, edges: Column) -> dict[str, Column]:
    """Mean errors after trimming and after winsorising at an upper edge."""
    return {"trimmed": F.avg(F.when(error <= edges, error)), "winsorised": F.avg(F.least(error, edges))}


def gate(metrics: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: each pre-declared test, and `promoted` if all hold. A test on a missing metric fails."""
    flags = {name: F.coalesce(t, F.lit(False)) for name, t in tests.items()}
    return metrics.select(*(t.alias(name) for name, t in flags.items()), F.forall(F.array(*flags.values()), lambda t: t).alias("promoted"))


def bootstrap(rows: DataFrame, a: str, b: str, unit: str, reps: int, seed: int, strata: str | None = None) -> DataFrame:
    """Paired differences of mean absolute errors (a - b) over resampled units: mean, low and high of 95 %, share_positive.

    Units are summed first, within each of the strata if given; strata keep their shares of the rows. Each unit is drawn a
    Poisson(1) number of times in each repetition, from the digest of unit|rep|seed: the same on every run and whatever the
    partitions, so repetitions are one aggregation with map-side sums.
    """
    units = rows.groupBy(unit, (F.col(strata) if strata else F.lit(0)).alias("_s")).agg(F.sum(F.abs(F.col(a)) - F.abs(F.col(b))).alias("_d"), F.count("*").alias("_n"))
    x = units.select(unit, "_s", "_d", "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    # 52 bits of the digest as a number in (0, 1).
    u = (F.conv(F.substring(hashing.digest(F.col(unit), F.col("rep"), F.lit(seed)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    cdf, p, draws = 0.0, float(np.exp(-1)), F.lit(0)
    for k in range(1, 9):
        cdf += p
        draws = draws + (u > cdf).cast("int")
        p /= k
    x = x.withColumn("_w", draws)
    part = x.groupBy("rep", "_s").agg((F.sum(F.col("_w") * F.col("_d")) / F.sum(F.col("_w") * F.col("_n"))).alias("_gain"), F.sum("_n").alias("_n"))
    per = part.groupBy("rep").agg((F.sum(F.col("_gain") * F.col("_n")) / F.sum(F.when(F.col("_gain").isNotNull(), F.col("_n")))).alias("gain"))
    return per.agg(F.avg("gain").alias("mean"), F.percentile("gain", F.lit(0.025)).alias("low"), F.percentile("gain", F.lit(0.975)).alias("high"), F.avg((F.col("gain") > 0).cast("int")).alias("share_positive"))


def preprocessing(measures: list[str], categories: list[str]) -> list:
    """Median imputation, scaling, and one-hot categories; unseen ones get a place of their own."""
    imputed = [f"{c}_imp" for c in measures]
    stages: list = [Imputer(strategy="median", inputCols=measures, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep", stringOrderType="frequencyDesc") for c in categories]
    stages += [OneHotEncoder(inputCols=[f"{c}_ix" for c in categories], outputCols=[f"{c}_hot" for c in categories], handleInvalid="keep")] if categories else []
    return [*stages, VectorAssembler(inputCols=["_scaled", *(f"{c}_hot" for c in categories)], outputCol="features")]


def rare_folded(rows: DataFrame, column: str, least: int) -> DataFrame:
    """Categories with fewer rows become OTHER."""
    n = rows.groupBy(F.col(column).alias("_c")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    x = rows.join(n, F.col(column) == F.col("_c"), "left")
    return x.withColumn(column, F.when(F.col("_c").isNotNull(), F.col(column)).otherwise("OTHER")).drop("_c", "_n")


def models(target: str, seed: int = 7, weight: str | None = None, held: str | None = None) -> dict[str, object]:
    """Regressors that the engine has an equivalent for, with a column of weights if given. Boosting stops early on the rows
    that a column `held` marks, if given. Not there: support vectors, extremely random trees, the quantile loss."""
    common = {"featuresCol": "features", "labelCol": target, "predictionCol": "prediction"} | ({"weightCol": weight} if weight else {})
    early = {"validationIndicatorCol": held} if held else {}
    return {
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, **common),
        "huber": LinearRegression(loss="huber", regParam=0.1, **common),
        "forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed, **common),
        "boosted": GBTRegressor(lossType="absolute", maxIter=10, maxDepth=4, seed=seed, **common, **early),
    }


def out_of_fold(rows: DataFrame, model: object, measures: list[str], categories: list[str], fold: str, folds: list[int]) -> DataFrame:
    """Predictions of each fold by a model fitted on the others; fits are the only loop."""
    out = None
    for f in folds:
        fitted: PipelineModel = Pipeline(stages=[*preprocessing(measures, categories), model]).fit(rows.where(F.col(fold) != f))
        part = fitted.transform(rows.where(F.col(fold) == f)).select(*rows.columns, "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def support_vectors(
    rows: DataFrame, measures: list[str], target: str, fold: str, folds: list[int], cost: float = 10.0, tube: float = 0.1, gamma: float = 0.1, waves: int = 48, rounds: int = 12, seed: int = 7
) -> DataFrame:
    """Out-of-fold predictions of a support-vector regression: half the squared weights plus cost times the mean of what
    errors are beyond the tube.

    Measures and target are standardised by the training rows; missing ones count as the mean. The radial kernel is that
    of random Fourier features (none if waves is 0: a linear kernel). The loss is lowered by bounds that touch it: each round is
    one pass over the rows for all folds, which sums the normal equations of rows outside the tube in every task, and only those sums
    come to the driver.
    """
    rng = np.random.default_rng(seed)
    direction, phase = rng.normal(size=(len(measures), waves)) * (2 * gamma) ** 0.5, rng.uniform(0, 2 * np.pi, waves)

    def mapped(x: np.ndarray) -> np.ndarray:
        z = np.cos(x @ direction + phase) * (2 / waves) ** 0.5 if waves else x
        return np.column_stack([z, np.ones(len(z))])

    columns, size = [*measures, target], waves + 1 if waves else len(measures) + 1
    # Fits of all folds go on together: a pass over the rows serves each of them.
    known = written(rows.where(F.col(fold).isNotNull() & F.col(target).isNotNull()).select(F.col(fold).alias("_fold"), *(F.col(c).cast("double").alias(c) for c in columns)))
    apart = lambda f, c: F.when(F.col("_fold") != f, F.col(c))
    stats = known.agg(*(g(apart(f, c)).alias(f"{name}{k}_{c}") for k, f in enumerate(folds) for c in columns for name, g in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count)))).first()
    middle = [np.array([stats[f"m{k}_{c}"] or 0.0 for c in columns]) for k in range(len(folds))]
    spread = [np.array([stats[f"s{k}_{c}"] or 1.0 for c in columns]) for k in range(len(folds))]
    n = [stats[f"n{k}_{target}"] for k in range(len(folds))]
    betas, least, going = [np.zeros(size) for _ in folds], [None] * len(folds), [k for k in range(len(folds)) if n[k]]
    for _ in range(rounds):

        def sums(batches, betas=betas, going=going):
            total, moment, loss = ({k: np.zeros(shape) for k in going} for shape in ((size, size), size, ()))
            for batch in batches:
                at = batch.column(0).to_numpy(zero_copy_only=False)
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
                for k in going:
                    scaled = np.nan_to_num((values[at != folds[k]] - middle[k]) / spread[k], nan=0.0, posinf=np.inf, neginf=-np.inf)
                    z, y = mapped(scaled[:, :-1]), scaled[:, -1]
                    error = y - z @ betas[k]
                    beyond = np.abs(error) - tube
                    loss[k] += float(np.maximum(beyond, 0).sum())
                    weighted = z * np.where(beyond > 0, 1 / np.maximum(beyond, 1e-3), 0.0)[:, None]
                    total[k] += weighted.T @ z
                    moment[k] += weighted.T @ (y - np.sign(error) * tube)
            for k in going:
                x = np.concatenate([total[k].ravel(), moment[k], loss[k][None]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], names=["k", "i", "x"])

        found = known.mapInArrow(sums, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas().sort_values(["k", "i"])
        ahead = []
        for k, got in ((k, found.x[found.k == k].to_numpy()) for k in going):
            beta, share = betas[k], cost / n[k]
            objective = 0.5 * float(beta[:-1] @ beta[:-1]) + share * got[-1]
            if least[k] is not None and objective > least[k][0] * (1 - 1e-4):
                continue
            least[k] = (objective, beta)
            penalty = np.eye(size)
            penalty[-1, -1] = 1e-9
            ahead.append((k, np.linalg.solve(share * got[: size * size].reshape(size, size) + penalty, share * got[size * size : -1])))
        betas, going = [dict(ahead).get(k, beta) for k, beta in enumerate(betas)], [k for k, _ in ahead]
        if not going:
            break
    best = {f: (middle[k], spread[k], least[k][1] if least[k] else betas[k]) for k, f in enumerate(folds)}

    def answer(batches):
        for batch in batches:
            x, prediction = np.column_stack([batch[c].astype(float) for c in measures]), np.zeros(len(batch))
            for f, (m, s, beta) in best.items():
                here = (batch[fold] == f).to_numpy()
                prediction[here] = mapped(np.nan_to_num((x[here] - m[:-1]) / s[:-1], nan=0.0, posinf=np.inf, neginf=-np.inf)) @ beta * s[-1] + m[-1]
            yield batch.assign(prediction=prediction)

    test = rows.where(F.col(fold).isin(list(folds)))
    return test.mapInPandas(answer, T.StructType([*test.schema.fields, T.StructField("prediction", T.DoubleType())]))


def soft_gate(rows: DataFrame, features: list[str], label: str, weight: str) -> DataFrame:
    """Probabilities of each class (array) by a balanced multinomial logistic regression."""
    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), StandardScaler(inputCol="_x", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol=label, weightCol=weight, family="multinomial", maxIter=30, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows).transform(rows).withColumn("probability", vector_to_array("probability"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """weight: rows over classes times the rows of the class, from a table of counts that is joined back."""
    counts = rows.groupBy(F.col(label).alias("_of_class")).agg(F.count("*").alias("_in_class"))
    whole = counts.agg(F.sum("_in_class").alias("_in_all"), F.count("*").alias("_classes"))
    weights = counts.crossJoin(whole).select("_of_class", (F.col("_in_all") / (F.col("_classes") * F.col("_in_class"))).alias("weight"))
    return rows.join(weights, F.col(label).eqNullSafe(F.col("_of_class"))).drop("_of_class")


def embedded(rows: DataFrame, array: str, k: int) -> DataFrame:
    """The k principal components of an array column: the linear control of learned encoders."""
    x = rows.withColumn("_v", array_to_vector(F.col(array).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(x).transform(x).withColumn("components", vector_to_array("_p")).drop("_v", "_p")


def attributions(rows: DataFrame, fitted: PipelineModel, measures: list[str], categories: list[str]) -> DataFrame:
    """rows with prediction, base and a column by_<feature>: how far each feature moves a linear model's answer from that for
    the mean row. They add up to the prediction, and are the Shapley values where features are independent."""
    model = fitted.stages[-1]
    sizes = [1] * len(measures) + [len(indexed.labels) + 1 for indexed in fitted.stages if isinstance(indexed, StringIndexerModel)]
    x = fitted.transform(rows)
    means = x.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    x = x.withColumn("_f", vector_to_array("features"))
    names, at, out = [*measures, *categories], 0, {}
    for name, size in zip(names, sizes, strict=True):
        terms = [(F.col("_f")[at + k] - float(means[at + k])) * float(model.coefficients[at + k]) for k in range(min(size, len(means) - at))]
        out[f"by_{name}"] = sum(terms[1:], terms[0])
        at += size
    base = float(model.intercept + sum(float(c) * float(m) for c, m in zip(model.coefficients, means, strict=True)))
    return x.withColumns(out).withColumn("base", F.lit(base)).select(*rows.columns, "prediction", "base", *out)


def masking_stress(rows: DataFrame, fitted: PipelineModel, masks: dict[str, object], target: str) -> DataFrame:
    """(masked, mae): the error with each feature replaced by its neutral value in turn."""
    out = None
    for name, neutral in masks.items():
        part = fitted.transform(rows.withColumn(name, F.lit(neutral).cast(rows.schema[name].dataType))).agg(F.lit(name).alias("masked"), F.avg(F.abs(F.col("prediction") - F.col(target))).alias("mae"))
        out = part if out is None else out.unionAll(part)
    return out
