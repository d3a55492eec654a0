"""Sessions, crossings and smoothing over ordered events of an owner."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import CrossingConfig, SessionConfig
from tidelog.functions import geo, times


def by_owner() -> Window:
    return Window.partitionBy("owner").orderBy("recorded_at", "id")


def gap_sessions(df: DataFrame, hours: float) -> DataFrame:
    """Rows of an owner at most that far apart: owner, session, n, started_at, ended_at."""
    gap = times.hours_between(F.lag("recorded_at").over(by_owner()), F.col("recorded_at"))
    x = df.withColumn("_new", F.when(gap <= hours, 0).otherwise(1)).withColumn("session", F.sum("_new").over(by_owner()))
    return x.groupBy("owner", "session").agg(F.count("*").alias("n"), F.min("recorded_at").alias("started_at"), F.max("recorded_at").alias("ended_at"))


def pair_sessions(events: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Inbound events open a session, the next outbound closes it; further inbounds inside and lone outbounds are ignored.

    Without a loop: after any event the state equals its direction, so an inbound opens if the event before it was
    outbound or there was none, and an outbound closes if the one before it was inbound.
    """
    w = by_owner()
    x = events.where(F.col("event_type").isin(cfg.inbound, cfg.outbound)).withColumn("_in", F.col("event_type") == cfg.inbound)
    before = F.lag("_in").over(w)
    x = x.withColumns({"_open": F.col("_in") & ~F.coalesce(before, F.lit(False)), "_close": ~F.col("_in") & F.coalesce(before, F.lit(False))})
    x = x.where("_open or _close").withColumn("session", F.sum(F.col("_open").cast("int")).over(w))
    return x.groupBy("owner", "session").agg(F.min(F.when(F.col("_open"), F.col("recorded_at"))).alias("inbound_at"), F.max(F.when(F.col("_close"), F.col("recorded_at"))).alias("outbound_at"))


def merge_sessions(sessions: DataFrame, hours: float) -> DataFrame:
    """Sessions of an owner that follow a closed one within that time are the same visit: first inbound, last outbound."""
    w = Window.partitionBy("owner").orderBy("session")
    gap = times.hours_between(F.lag("outbound_at").over(w), F.col("inbound_at"))
    x = sessions.withColumn("_new", F.when((gap >= 0) & (gap <= hours), 0).otherwise(1)).withColumn("visit", F.sum("_new").over(w))
    return x.groupBy("owner", "visit").agg(
        F.min("inbound_at").alias("inbound_at"),
        F.max_by("outbound_at", "session").alias("outbound_at"),
        (F.count("*") - 1).alias("merges"),
    )


def censored(visits: DataFrame, last_seen: DataFrame, end: Column, minutes: float) -> DataFrame:
    """Open visits whose owner was still seen shortly before the end of the data are right-censored. last_seen: owner, seen_at."""
    x = visits.join(last_seen, "owner", "left")
    near = times.seconds_between(F.col("seen_at"), end) <= minutes * 60
    return x.withColumn("right_censored", F.col("outbound_at").isNull() & F.coalesce(near, F.lit(False)))


def crossings(df: DataFrame, gate: CrossingConfig) -> DataFrame:
    """Directed crossings of a gate between neighbouring positions: owner, id, direction, crossed_at, quality, x, y."""
    a, b = (gate.lon_a, gate.lat_a), (gate.lon_b, gate.lat_b)
    x = df.withColumn("_side", geo.side(a, b, (gate.inside_lon, gate.inside_lat), F.col("lon"), F.col("lat")))
    w = by_owner()
    before = {f"_{c}": F.lag(c).over(w) for c in ("lon", "lat", "recorded_at")} | {"_before": F.lag("_side").over(w)}
    x = x.withColumns(before).withColumn("dt_s", times.seconds_between(F.col("_recorded_at"), F.col("recorded_at")))
    x = x.withColumn("_at", geo.crossing(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"), a, b))
    x = x.where((F.signum("_side") != F.signum("_before")) & (F.col("dt_s") > 0) & (F.col("dt_s") <= gate.max_gap_s) & F.col("_at").isNotNull())
    return x.select(
        "owner",
        "id",
        F.when(F.col("_side") > 0, "INBOUND").otherwise("OUTBOUND").alias("direction"),
        times.midpoint(F.col("_recorded_at"), F.col("recorded_at")).alias("crossed_at"),
        F.when(F.col("dt_s") <= gate.good_gap_s, "A").when(F.col("dt_s") <= gate.fair_gap_s, "B").otherwise("C").alias("quality"),
        F.col("_at.x").alias("x"),
        F.col("_at.y").alias("y"),
    )


def ring_crossings(df: DataFrame, lat0: float, lon0: float, levels_km: list[float], max_gap_s: float) -> DataFrame:
    """The last inward crossing of each ring about a place, interpolated: owner, level_km, crossed_at, lat, lon, distance before
    and after."""
    from tidelog.config import EARTH_KM

    w = by_owner()
    x = df.withColumn("d", geo.haversine(F.col("lat"), F.col("lon"), F.lit(lat0), F.lit(lon0), EARTH_KM))
    x = x.withColumns({"d_next": F.lead("d").over(w), "next_at": F.lead("recorded_at").over(w), "next_lat": F.lead("lat").over(w), "next_lon": F.lead("lon").over(w)})
    x = x.withColumn("dt_s", times.seconds_between(F.col("recorded_at"), F.col("next_at")))
    x = x.withColumn("level_km", F.explode(F.filter(F.array(*map(F.lit, levels_km)), lambda v: (F.col("d") >= v) & (F.col("d_next") < v))))
    x = x.where((F.col("dt_s") > 0) & (F.col("dt_s") <= max_gap_s))
    part = (F.col("d") - F.col("level_km")) / (F.col("d") - F.col("d_next"))
    x = x.withColumn("crossed_at", F.timestamp_add("MICROSECOND", F.floor(part * F.col("dt_s") * 1e6).cast("bigint"), F.col("recorded_at")))
    x = x.withColumns({c: F.col(c) + part * (F.col(f"next_{c}") - F.col(c)) for c in ("lat", "lon")})
    last = F.max_by(F.struct("crossed_at", "lat", "lon", "d", "d_next", "id"), F.struct("recorded_at", "id"))
    return x.groupBy("owner", "level_km").agg(last.alias("x")).select("owner", "level_km", "x.*")


def transitions(df: DataFrame, cell_deg: float, max_gap_min: float, step_nm: tuple[float, float], speed_kn: tuple[float, float]) -> DataFrame:
    """Directed moves between grid cells: owner, id, recorded_at, from_cell, to_cell, hours, step_nm, speed."""
    from tidelog.config import EARTH_NM

    w = by_owner()
    cell = lambda lat, lon: F.concat_ws(":", geo.cell(F.col(lat), cell_deg), geo.cell(F.col(lon), cell_deg))
    x = df.withColumns({f"_{c}": F.lag(c).over(w) for c in ("lat", "lon", "recorded_at", "sog_clean")})
    speeds = [F.col("_sog_clean"), F.col("sog_clean")]
    mean = F.try_divide(sum((F.coalesce(s, F.lit(0.0)) for s in speeds), F.lit(0.0)), sum((s.isNotNull().cast("double") for s in speeds), F.lit(0.0)))
    x = x.withColumns(
        {
            "from_cell": F.when(F.col("_lat").isNotNull(), cell("_lat", "_lon")),
            "to_cell": cell("lat", "lon"),
            "hours": times.hours_between(F.col("_recorded_at"), F.col("recorded_at")),
            "step_nm": geo.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"), EARTH_NM),
            "speed": mean,
        }
    )
    x = x.where((F.col("from_cell") != F.col("to_cell")) & (F.col("hours") > 0) & (F.col("hours") * 60 <= max_gap_min) & F.col("step_nm").between(*step_nm) & F.col("speed").between(*speed_kn))
    return x.select("owner", "id", "recorded_at", "from_cell", "to_cell", "hours", "step_nm", "speed")


def smoothed(df: DataFrame, value: str, alpha: float, reset_hours: float) -> DataFrame:
    """owner, id, recorded_at, value and `smooth`: causal exponential smoothing that starts anew after a gap.

    f = alpha * x + (1 - alpha) * f_before is sequential by nature: an owner's rows arrive in order and pass through as a
    stream of Arrow batches, with one number carried from batch to batch.
    """
    w = by_owner()
    gap = times.hours_between(F.lag("recorded_at").over(w), F.col("recorded_at"))
    rows = df.select("owner", "id", "recorded_at", F.col(value).cast("double").alias(value)).withColumn("_new", ~F.coalesce(gap <= reset_hours, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for batch in batches:
            out = []
            for x, new in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                last = x if new or last is None else last if x is None else alpha * x + (1 - alpha) * last
                out.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.float64())], names=["owner", "id", "recorded_at", value, "smooth"])

    return rows.mapInArrow(run, f"owner bigint, id bigint, recorded_at timestamp_ntz, {value} double, smooth double")
