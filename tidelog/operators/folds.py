"""Folds and blocks: by time, by hash, by size."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chronological(df: DataFrame, group: str, order: list[str], final: int, warmup: int, blocks: int) -> DataFrame:
    """part: the last `final` rows of each group, the first `warmup`, and the rest in blocks in time order, larger ones first."""
    w = Window.partitionBy(group)
    x = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    m, k = F.col("_n") - final - warmup, F.col("_r") - warmup
    size, larger = F.floor(m / blocks), m % blocks
    head = larger * (size + 1)
    block = F.when(k <= head, F.floor((k - 1) / (size + 1))).otherwise(larger + F.floor(F.try_divide(k - 1 - head, size)))
    part = F.when(F.col("_r") > F.col("_n") - final, "FINAL").when(F.col("_r") <= warmup, "WARMUP").otherwise(F.concat(F.lit("FOLD_"), (block + 1).cast("bigint").cast("string")))
    return x.withColumn("part", part).drop("_r", "_n")


def temporal_blocks(df: DataFrame, at: str, blocks: int) -> DataFrame:
    """block (from 0): about even in rows, and equal times never part.

    A boundary is the first time by which k / blocks of the rows are past. Distinct times are counted first, so the
    running sum goes over those; day buckets keep it from a single task's sort of all times.
    """
    counts = df.groupBy(at).agg(F.count("*").alias("_n")).withColumn("_day", F.to_date(at))
    days = counts.groupBy("_day").agg(F.sum("_n").alias("_d"))
    before = days.select("_day", (F.sum("_d").over(Window.orderBy("_day")) - F.col("_d")).alias("_before"), F.sum("_d").over(Window.partitionBy()).alias("_total"))
    upto = counts.join(F.broadcast(before), "_day").withColumn("_upto", F.sum("_n").over(Window.partitionBy("_day").orderBy(at)) + F.col("_before"))
    edges = upto.agg(*(F.min(F.when(F.col("_upto") >= F.lit(k) * F.col("_total") / F.lit(float(blocks)), F.col(at))).alias(f"_e{k}") for k in range(1, blocks)))
    x = df.crossJoin(F.broadcast(edges))
    block = sum(((F.col(f"_e{k}") < F.col(at)).cast("bigint") for k in range(1, blocks)), F.lit(0).cast("bigint"))
    return x.withColumn("block", block).drop(*(f"_e{k}" for k in range(1, blocks)))


def forward_roles(df: DataFrame, at: str, embargo_hours: float) -> DataFrame:
    """A row for each fold (block from 1) and row of blocked data, with its role: TRAIN, PURGED, TEST or FUTURE."""
    starts = df.where("block > 0").groupBy(F.col("block").alias("fold")).agg(F.min(at).alias("_start"))
    cut = F.timestamp_add("MICROSECOND", F.lit(-int(embargo_hours * 3.6e9)), F.col("_start"))
    role = F.when(F.col("block") == F.col("fold"), "TEST").when(F.col("block") > F.col("fold"), "FUTURE").when(F.col(at) < cut, "TRAIN").otherwise("PURGED")
    return df.crossJoin(F.broadcast(starts)).withColumn("role", role).drop("_start")


def greedy_balanced(sizes: DataFrame, owner: str, n: str, folds: int) -> DataFrame:
    """(owner, n, fold): largest first to the least loaded fold, the lowest on ties.

    Sequential, so owners stream in order through one task, which keeps only the folds' loads.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [(0, k) for k in range(folds)]
        for batch in batches:
            out = []
            for size in batch[n]:
                load, k = heapq.heappop(loads)
                heapq.heappush(loads, (load + size, k))
                out.append(k)
            yield batch.assign(fold=out)

    ordered = sizes.select(owner, n).repartition(1).sortWithinPartitions(F.desc(n), owner)
    return ordered.mapInPandas(deal, f"{owner} bigint, {n} bigint, fold int")
