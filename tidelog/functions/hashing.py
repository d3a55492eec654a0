"""Splits, folds and keys from SHA-256, so that they never depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts)), 256)


def bucket(salt: str, owner: Column, n: int = 100) -> Column:
    """The first 8 hexadecimal digits of sha256("salt:owner") modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), owner.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(n))


def split(salt: str, owner: Column, train: int = 70, calibration: int = 15) -> Column:
    b = bucket(salt, owner)
    return F.when(b < train, "train").when(b < train + calibration, "calibration").otherwise("final")


def balanced_folds(owners: DataFrame, owner: str, salt: str, folds: int) -> DataFrame:
    """(owner, fold): distinct owners ranked by their digest, dealt in turn, so that sizes differ by one at most.

    The rank is global, as exact balance asks for: range-partitioned digests are counted per partition and only those
    counts are summed in order, so no single task holds all owners.
    """
    ranked = ranks(owners.select(owner).distinct().withColumn("_h", digest(salt, F.col(owner))), ["_h", owner])
    return ranked.select(owner, ((F.col("rank") - 1) % folds).cast("int").alias("fold"))


def ranks(df: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """A global row number (from 1) without a single-task sort: a bucket of leading bits, local ranks and bucket offsets.

    The first column of `by` must be a hexadecimal digest, whose first three digits deal rows evenly into 4096 buckets.
    """
    placed = df.withColumn("_b", F.substring(by[0], 1, 3))
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*by))
    return placed.withColumn("_local", local).join(before, "_b").withColumn(name, F.col("_local") + F.col("_before")).drop("_b", "_local", "_before")
