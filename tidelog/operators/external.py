"""Blind scoring of outside data: a cohort without labels, its history, and labels revealed later by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import geo, hashing
from tidelog.operators import contracts, joins


def cohort(events: DataFrame, salt: str, not_before: str) -> DataFrame:
    """One decision of each owner, that of the least hash, if it isn't too early: sample_key, owner, id, decided_at."""
    pick = F.min(F.struct(hashing.digest(salt, F.col("id")).alias("h"), "at", "id")).alias("x")
    x = events.groupBy("owner").agg(pick).select("owner", F.col("x.id").alias("id"), F.col("x.at").alias("decided_at"))
    x = x.where(F.col("decided_at") >= F.lit(not_before).cast("timestamp_ntz"))
    return x.withColumn("sample_key", hashing.digest(F.col("owner"), F.date_format("decided_at", "yyyy-MM-dd'T'HH:mm:ss")))


def candidates(messages: DataFrame, mask: Column, blocked: DataFrame, salt: str, not_before: str, most: int) -> DataFrame:
    """The cohort of messages that a mask on columns known beforehand lets through, without blocked owners: the `most`
    owners of the least hashes. Whether an outcome exists may be asked by the mask, its size may not."""
    x = messages.where(F.coalesce(mask, F.lit(False))).join(blocked.select("owner").distinct(), "owner", "left_anti")
    return cohort(x, salt, not_before).orderBy("sample_key").limit(most)


def window_features(decisions: DataFrame, states: DataFrame, hours: int, minutes: dict[str, int], least_points: int, max_age_min: float, radius_km: float) -> DataFrame:
    """What is known of each decision's owner from the hours before it: sample_key, points, age_min, gaps, valid_share, and
    for each window speed_, speed_std_, moving_share_, stopped_share_, turns_, travelled_km_, net_km_; and why a decision
    isn't taken (reason: '', INSUFFICIENT_HISTORY or STALE).

    states: owner, id, recorded_at, lat, lon, sog, moving, stopped, turning, gap, position_valid, step_m. One interval join
    serves all windows; a row after the decision fails the plan.
    """
    since = decisions.withColumn("_since", F.timestamp_add("HOUR", F.lit(-hours), F.col("decided_at"))).select("sample_key", "owner", "decided_at", "_since")
    at, cut = F.col("recorded_at"), F.col("decided_at")
    late = F.raise_error(F.lit("a state after its decision")).cast("boolean")
    age = F.timestamp_diff("MICROSECOND", at, cut) / F.lit(6e7)
    valid = F.col("position_valid")
    where = F.struct("recorded_at", "seen_id")
    aggs = [
        F.count_distinct(F.when(valid, at)).alias("points"),
        F.min(F.when(valid, age)).alias("age_min"),
        F.count_if(F.col("gap")).alias("gaps"),
        F.avg(valid.cast("int")).alias("valid_share"),
        F.bool_and(F.when(age < 0, late).otherwise(F.lit(True))).alias("causal"),
    ]
    for name, length in minutes.items():
        inside = age <= length
        place = lambda pick, inside=inside: pick(F.when(inside & valid, F.struct("lat", "lon")), F.when(inside & valid, where))
        first, last = place(F.min_by), place(F.max_by)
        aggs += [
            F.median(F.when(inside, F.col("sog"))).alias(f"speed_{name}"),
            F.coalesce(F.stddev_samp(F.when(inside, F.col("sog"))), F.when(F.count(F.when(inside, F.col("sog"))) == 1, 0.0)).alias(f"speed_std_{name}"),
            F.avg(F.when(inside, F.col("moving").cast("int"))).alias(f"moving_share_{name}"),
            F.avg(F.when(inside, F.col("stopped").cast("int"))).alias(f"stopped_share_{name}"),
            F.count_if(inside & F.col("turning")).alias(f"turns_{name}"),
            F.sum(F.when(inside, F.coalesce("step_m", F.lit(0.0)) / 1000)).alias(f"travelled_km_{name}"),
            F.when(F.count(F.when(inside & valid, 1)) >= 2, geo.haversine(first["lat"], first["lon"], last["lat"], last["lon"], radius_km)).alias(f"net_km_{name}"),
        ]
    seen = states.select("owner", F.col("id").alias("seen_id"), "recorded_at", "lat", "lon", "sog", "moving", "stopped", "turning", "gap", "position_valid", "step_m")
    x = joins.in_windows(seen, since, "owner", "recorded_at", "_since", "decided_at", hours, aggs, ["sample_key", "decided_at"]).where(F.coalesce("causal", F.lit(True))).drop("decided_at", "causal")
    reason = F.when(F.col("points") < least_points, "INSUFFICIENT_HISTORY").when(F.col("age_min") > max_age_min, "STALE").otherwise("")
    contracts.forbid_leakage(x.columns)
    return x.withColumn("reason", reason)


def history(decisions: DataFrame, events: DataFrame, hours: int) -> DataFrame:
    """What was seen in the hours up to each decision. No label column is read here."""
    windows = decisions.withColumn("_since", F.timestamp_add("HOUR", F.lit(-hours), F.col("decided_at"))).select("sample_key", "owner", "decided_at", "_since")
    seen = events.select("owner", F.col("id").alias("seen_id"), "at", "value")
    # No row after any decision of the owner is read at all; the check fails if one is.
    last = decisions.groupBy("owner").agg(F.max("decided_at").alias("_last"))
    seen = contracts.causal(seen.join(last, "owner").where(F.col("at") <= F.col("_last")).drop("_last"), last, "owner", "at", "_last")
    return joins.in_windows(seen, windows, "owner", "at", "_since", "decided_at", hours, [F.count("seen_id").alias("history"), F.avg("value").alias("mean_value")], ["sample_key"])


def reveal(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Labels by sample_key: hours to the owner's first outcome after the decision; a key with two decisions is an error."""
    x = decisions.select("sample_key", "owner", "decided_at").join(outcomes.select("owner", F.col("at").alias("_at")), "owner", "left")
    hours = F.timestamp_diff("MICROSECOND", F.col("decided_at"), F.col("_at")) / F.lit(3.6e9)
    x = x.groupBy("sample_key").agg(F.min(F.when(F.col("_at") > F.col("decided_at"), hours)).alias("label_h"), F.countDistinct("owner", "decided_at").alias("_n"))
    return x.select("sample_key", F.when(F.col("_n") == 1, F.col("label_h")).otherwise(F.raise_error(F.lit("ambiguous label"))).alias("label_h"))
