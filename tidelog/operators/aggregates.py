"""Aggregations that recur: metric bundles, weighted quantiles, slices, concentration, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import quantiles


def metric_table(rows: DataFrame, by: list[str], error: Column, digits: int = 6) -> DataFrame:
    """Regression metrics of an error column by group: n, mae, medae, rmse, p90, p95, within_24, worst."""
    e = F.col("_e")
    aggs = {"n": F.count(e), "mae": F.avg(e), "rmse": F.sqrt(F.avg(e * e)), "within_24": F.avg((e <= 24).cast("double")), "worst": F.max(e)}
    rounded = [(x if name == "n" else F.round(x, digits)).alias(name) for name, x in aggs.items()]
    return quantiles.summary(rows.select(*by, F.abs(error).alias("_e")), by, "_e", rounded, {"medae": 0.5, "p90": 0.9, "p95": 0.95}, digits)


def weighted(error: Column, weight: Column, digits: int = 6) -> list[Column]:
    total = F.sum(weight)
    return [F.round(F.sum(weight * F.abs(error)) / total, digits).alias("w_mae"), F.round(F.sqrt(F.sum(weight * error * error) / total), digits).alias("w_rmse")]


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """The first value at which the running weight reaches each share of the whole; rows of no positive weight don't count."""
    return quantiles.weighted(df, by, value, weight, qs)


def metric_slices(rows: DataFrame, families: list[str], error: Column) -> DataFrame:
    """The metrics for each value of each family, as (slice_family, slice_value): a row counts once in each family."""
    of = F.explode(F.array(*(F.struct(F.lit(x).alias("slice_family"), F.col(x).cast("string").alias("slice_value")) for x in families)))
    x = rows.select(error.alias("_error"), of.alias("_s")).select("_error", "_s.*")
    return metric_table(x, ["slice_family", "slice_value"], F.col("_error"))


def concentration(df: DataFrame, error: Column, ks: list[int], tie: str) -> DataFrame:
    """(k, share): what the k largest errors make of the sum. Only the largest of ks rows are ranked."""
    x = df.select(F.abs(error).alias("_e"), tie)
    top = x.orderBy(F.desc("_e"), tie).limit(max(ks)).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_e"), tie)))
    total = x.agg(F.sum("_e").alias("_total"))
    sums = top.agg(*(F.sum(F.when(F.col("_r") <= k, F.col("_e"))).alias(f"_{k}") for k in ks)).crossJoin(F.broadcast(total))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.round(F.col(f"_{k}") / F.col("_total"), 6).alias("share")) for k in ks))))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; NULL for fewer than 3 rows or a constant side."""
    sound = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = quantiles.average_ranks(quantiles.average_ranks(sound, by, x, "_x"), by, y, "_y")
    # Ranks are constant where values are.
    varied = (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & varied, F.corr("_x", "_y")).alias("rho"))


def mode_smallest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties, and how often it occurs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(value).alias("v"))).alias("x")).select(*by, F.col("x.v").alias("mode"), (-F.col("x.m")).alias("n"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order; a survivor of dropDuplicates would be arbitrary."""
    return top_per_group(df, by, order, 1).drop("rank")


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row with the distinct exact quantile edges of a column."""
    return quantiles.quantiles(df, [], value, [k / bins for k in range(bins + 1)]).select(F.array_distinct("q").alias("edges"))


def quantile_bin(value: Column, edges: Column) -> Column:
    """Right-closed bins, from 0; the lowest edge belongs to the first."""
    return F.when(value.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < value)) - 1, F.lit(0)))


def selected(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The name with the least tuple of metrics."""
    return df.agg(F.min_by(name, F.struct(*order, name)).alias(name), F.min(F.struct(*order, name)).alias("_m")).select(name, *(F.col(f"_m.{x}").alias(x) for x in order))


def first_accepted(df: DataFrame, order: str, accepted: Column, reason: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n accepted rows by order, and the counts of reasons for those rejected before the last of them.

    The place of the n-th accepted row is found by a top-n alone, then both sides are filters against it.
    """
    x = df.withColumns({"_ok": F.coalesce(accepted, F.lit(False)), "_why": reason})
    kept = x.where("_ok").orderBy(order).limit(n)
    last = kept.agg(F.max(order).alias("_last"), F.count("*").alias("_k"))
    rejected = x.where("not _ok").crossJoin(F.broadcast(last)).where((F.col("_k") < n) | (F.col(order) < F.col("_last")))
    return kept.drop("_ok", "_why"), rejected.groupBy(F.col("_why").alias("reason")).agg(F.count("*").alias("n"))
