"""The causal state layer: every derived column reads rows up to its own only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import EARTH_M, StateConfig
from tidelog.functions import geo, numeric, text, times

#: Fixed value: knots in a metre per second.
KNOTS = 1.9438444924406


def holds(x: Column) -> Column:
    """A flag that is false where it isn't known."""
    return F.coalesce(x, F.lit(False))


def clean(df: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    """Cleaned companions of the raw columns sog_raw, cog_raw, heading_raw, nav_raw, lat and lon; sentinels become NULL."""
    return df.withColumns(
        {
            "sog_clean": numeric.within(numeric.number(F.col("sog_raw")), 0, cfg.sog_cap),
            "sog_capped_high": holds(F.col("sog_raw") == cfg.sog_cap),
            "cog_clean": F.when(F.col("cog_raw") < 360, numeric.within(F.col("cog_raw"), 0)),
            "heading_clean": F.when(F.col("heading_raw") != 511, numeric.within(F.col("heading_raw"), 0, 359)),
            "nav_clean": numeric.within(F.col("nav_raw"), 0, 14),
            "lat_clean": numeric.within(F.col("lat"), -90, 90),
            "lon_clean": numeric.within(F.col("lon"), -180, 180),
        }
    ).withColumn("position_valid", F.col("lat_clean").isNotNull() & F.col("lon_clean").isNotNull())


def states(df: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    """Motion, state age, candidate episodes and stale risk of each observation.

    All windows share one partitioning by owner and one order, so the plan has a single shuffle and a single sort.
    """
    by = Window.partitionBy("owner").orderBy("recorded_at", "id")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lag = lambda name, default=None: F.lag(name, 1, default).over(by)
    dynamic = ["lat_clean", "lon_clean", "sog_clean", "cog_clean", "heading_clean", "nav_clean"]
    x = clean(df, cfg)
    x = x.withColumns(
        {
            "dt_s": times.seconds_between(lag("recorded_at"), F.col("recorded_at")),
            "prev_lat": lag("lat_clean"),
            "prev_lon": lag("lon_clean"),
            "prev_sog": lag("sog_clean"),
            "cog_delta": geo.turn(F.col("cog_clean"), lag("cog_clean")),
            "is_first": F.row_number().over(by) == 1,
            "same_state": F.struct(*dynamic).eqNullSafe(F.lag(F.struct(*dynamic)).over(by)),
        }
    )
    dt = F.col("dt_s")
    x = x.withColumn("step_m", geo.haversine(F.col("prev_lat"), F.col("prev_lon"), F.col("lat_clean"), F.col("lon_clean"), EARTH_M)).drop("prev_lat", "prev_lon")
    x = x.withColumns({"implied_kn": F.when(dt > 0, F.col("step_m") / dt * KNOTS), "sog_delta": F.abs(F.col("sog_clean") - F.col("prev_sog")), "changed": F.col("is_first") | ~F.col("same_state")})
    x = x.withColumn("state_age_s", F.greatest(F.lit(0.0), times.seconds_between(F.last(F.when(F.col("changed"), F.col("recorded_at")), True).over(upto), F.col("recorded_at"))))
    sog, implied = F.col("sog_clean"), F.col("implied_kn")
    x = x.withColumns(
        {
            "position_repeated": holds(F.col("step_m") <= 1.0) & ~F.col("is_first"),
            "conflict": holds((sog >= cfg.conflict_sog_kn) & (implied <= cfg.conflict_step_kn) & (dt > 0) & (dt <= cfg.turn_max_gap_s)),
            "jump": holds((implied > cfg.jump_kn) & (dt > 0) & (dt <= cfg.jump_max_gap_s)),
            "gap": holds(dt > cfg.gap_s),
        }
    )
    calm = (dt > 0) & ~F.col("jump")
    x = x.withColumns(
        {
            "stopped": holds((sog <= cfg.stop_enter_kn) & (implied <= cfg.stop_enter_kn) & calm),
            "slow": holds((sog > cfg.stop_enter_kn) & (sog < cfg.slow_kn) & (implied < cfg.slow_kn) & calm),
            "moving": holds((sog >= cfg.moving_kn) & (implied >= cfg.moving_step_kn) & calm),
            "turning": holds((F.col("cog_delta") >= cfg.turn_deg) & (sog >= cfg.turn_min_kn) & (F.col("prev_sog") >= cfg.turn_min_kn) & calm & (dt <= cfg.turn_max_gap_s)),
        }
    )
    edges = {}
    for name in ("stopped", "slow"):
        before = lag(name, False)
        edges[f"{name}_start"] = F.col(name) & (~before | F.col("gap"))
        edges[f"{name}_end"] = ~F.col(name) & before
    x = x.withColumns(edges)
    x = x.withColumns({f"{name}_s": duration(F.col(name), F.col(f"{name}_start"), upto) for name in ("stopped", "slow")})
    stationary = holds((sog <= cfg.stop_enter_kn) & F.col("nav_clean").isin(*cfg.stationary_codes))
    high = ~stationary & (F.col("conflict") | holds((F.col("state_age_s") >= cfg.stale_high_s) & (sog > 1.0)))
    medium = ~stationary & ((~F.col("changed") & holds(F.col("state_age_s") >= cfg.stale_medium_s)) | (F.col("position_repeated") & holds(sog > cfg.stop_enter_kn)))
    state = F.when(F.col("jump"), "POSITION_JUMP").when(F.col("conflict"), "KINEMATIC_CONFLICT").when(F.col("stopped"), "STOPPED").when(F.col("slow"), "SLOW_MOTION").when(F.col("moving"), "MOVING")
    flags = {"STOP_START": "stopped_start", "STOP_END": "stopped_end", "SLOW_START": "slow_start", "SLOW_END": "slow_end", "TURN": "turning", "OBS_GAP": "gap", "KIN_CONFLICT": "conflict", "POS_JUMP": "jump"}
    return x.withColumns(
        {
            "stale_risk": F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"),
            "motion_state": state.otherwise("UNKNOWN"),
            "events": text.labels({name: F.col(flag) for name, flag in flags.items()}),
        }
    ).drop("is_first", "same_state")


def duration(active: Column, start: Column, upto: Window) -> Column:
    """Seconds since the episode's start; 0 outside of one."""
    since = F.last(F.when(start, F.col("recorded_at")), True).over(upto)
    return F.when(active, F.coalesce(times.seconds_between(since, F.col("recorded_at")), F.lit(0.0))).otherwise(0.0)


def islands(df: DataFrame, active: str, min_rows: int = 1) -> DataFrame:
    """Runs of rows in which a flag holds: owner, run, n, started_at, ended_at, seconds."""
    by = Window.partitionBy("owner").orderBy("recorded_at", "id")
    edge = (F.col(active) & ~F.lag(active, 1, False).over(by)).cast("int")
    runs = df.withColumn("_edge", edge).withColumn("run", F.sum("_edge").over(by)).where(active)
    out = runs.groupBy("owner", "run").agg(F.count("*").alias("n"), F.min("recorded_at").alias("started_at"), F.max("recorded_at").alias("ended_at"))
    return out.where(F.col("n") >= min_rows).withColumn("seconds", times.seconds_between(F.col("started_at"), F.col("ended_at")))
