"""Checks on tables: schemas, keys, domains, leakage, causality."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What marks a column as knowledge of the future.
FORBIDDEN_PREFIXES = ("target_", "label_", "future_", "post_decision_")
FORBIDDEN_SUFFIXES = ("_target",)


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, names: set[str]) -> DataFrame:
    if missing := names - set(df.columns):
        raise ContractError(f"missing columns: {sorted(missing)}")
    return df


def forbid_leakage(names: list[str], banned: set[str] = frozenset(), tokens: set[str] = frozenset()) -> list[str]:
    """The feature names, or an error that lists those that give the target away."""
    bad = [x for x in names if x in banned or x.startswith(FORBIDDEN_PREFIXES) or x.endswith(FORBIDDEN_SUFFIXES) or tokens & set(re.split("[^a-z0-9]+", x.lower()))]
    if bad:
        raise ContractError(f"not known at decision time: {bad}")
    return names


def violations(df: DataFrame, key: list[str], present: list[str] = (), ranges: dict[str, tuple] | None = None) -> DataFrame:
    """(violation, n): repeated keys, missing and out-of-range values. Values are counted in one pass, keys in another."""
    tests = {f"{x} missing": F.col(x).isNull() for x in present}
    tests |= {f"{x} out of range": ~F.col(x).between(*bounds) for x, bounds in (ranges or {}).items()}
    repeated = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate key").alias("violation"), "n")
    if not tests:
        return repeated
    counted = df.agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(f"_{i}") for i, t in enumerate(tests.values())))
    rows = counted.select(F.inline(F.array(*(F.struct(F.lit(name).alias("violation"), F.col(f"_{i}").alias("n")) for i, name in enumerate(tests)))))
    return repeated.unionAll(rows)


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that fails, while it runs, if a key occurs twice on the right: no second pass over the table."""
    rest = [x for x in right.columns if x not in on]
    one = right.groupBy(*on).agg(F.count("*").alias("_n"), *(F.first(x).alias(x) for x in rest))
    checked = one.select(*on, *(F.when(F.col("_n") == 1, F.col(x)).otherwise(F.raise_error(F.lit("key isn't unique"))).alias(x) for x in rest))
    return left.join(checked, on, how)


def causal(rows: DataFrame, cutoffs: DataFrame, owner: str, at: str, cutoff: str) -> DataFrame:
    """The rows of owners with a cut-off; the plan fails, while it runs, at a row that lies after it."""
    late = F.concat(F.lit("a row after the cut-off of "), F.col(owner).cast("string"))
    x = rows.join(cutoffs.select(owner, F.col(cutoff).alias("_cut")), owner)
    return x.withColumn(at, F.when(F.col(at) <= F.col("_cut"), F.col(at)).when(F.col(at).isNotNull(), F.raise_error(late).cast(x.schema[at].dataType))).drop("_cut")


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, found_in) of keys that only one side has."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full").where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "right only").otherwise("left only").alias("found_in"))
