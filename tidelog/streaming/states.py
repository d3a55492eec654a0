"""The state layer on a stream, and windows and sessions over event time."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.config import EARTH_M, StateConfig
from tidelog.operators.states import KNOTS
from tidelog.session import shared_folder


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The event log as a stream of files, whether it is one file or a folder of part files."""
    at = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return reader.parquet(at) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there, in micro-batches, to a table in the shared folder; the table is read back."""
    at = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4()}"
    query = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def motion(rows: DataFrame, cfg: StateConfig = StateConfig(), silence: str = "30 days") -> DataFrame:
    """id, owner, motion_state and stopped_s of a stream of positions (owner, id, recorded_at, lat, lon, sog).

    The state of an owner is its last row and the start of its stop. Rows must reach it in time order: those of a
    micro-batch are sorted, and a row older than the last one is late; it is put out as LATE and doesn't change the state.
    An owner that is silent for as long as `silence`, by the watermark, is forgotten; its next row is a first one again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, lat, lon, stop, seen = state.get if state.exists else (None, None, None, None, False)
        group = pd.concat(list(batches)).sort_values(["recorded_at", "id"], kind="stable")
        out = []
        for row in group.itertuples(index=False):
            t = row.recorded_at.value // 1000
            if seen and t < at:
                out.append((row.id, key[0], "LATE", 0.0))
                continue
            name, seconds = "UNKNOWN", 0.0
            sog = None if row.sog is None or math.isnan(row.sog) or not 0 <= row.sog <= cfg.sog_cap else row.sog
            dt = (t - at) / 1e6 if seen else None
            stopped = False
            if dt and dt > 0:
                kn = metres(lat, lon, row.lat, row.lon) / dt * KNOTS
                jump = kn > cfg.jump_kn and dt <= cfg.jump_max_gap_s
                stopped = not jump and sog is not None and sog <= cfg.stop_enter_kn and kn <= cfg.stop_enter_kn
                if jump:
                    name = "POSITION_JUMP"
                elif sog is not None and sog >= cfg.conflict_sog_kn and kn <= cfg.conflict_step_kn and dt <= cfg.turn_max_gap_s:
                    name = "KINEMATIC_CONFLICT"
                elif stopped:
                    name = "STOPPED"
                elif sog is not None and cfg.stop_enter_kn < sog < cfg.slow_kn and kn < cfg.slow_kn:
                    name = "SLOW_MOTION"
                elif sog is not None and sog >= cfg.moving_kn and kn >= cfg.moving_step_kn:
                    name = "MOVING"
                if stopped:
                    stop = t if stop is None or dt > cfg.gap_s else stop
                    seconds = (t - stop) / 1e6
            stop = stop if stopped else None
            out.append((row.id, key[0], name, seconds))
            at, lat, lon, seen = t, row.lat, row.lon, True
        state.update((at, lat, lon, stop, seen))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["id", "owner", "motion_state", "stopped_s"])

    timed = rows.withColumn("_at", F.col("recorded_at").cast("timestamp")).withWatermark("_at", silence)
    return timed.groupBy("owner").applyInPandasWithState(
        step, "id bigint, owner bigint, motion_state string, stopped_s double", "at bigint, lat double, lon double, stop bigint, seen boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def metres(lat_a: float, lon_a: float, lat_b: float, lon_b: float) -> float:
    a, b = math.radians(lat_a), math.radians(lat_b)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def windows(rows: DataFrame, at: str, size: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts by window and keys; a window is put out once its end is `late` past."""
    x = rows.withWatermark(at, late).groupBy(F.window(at, size, slide or size), *keys).agg(F.count("*").alias("n"))
    return x.select(F.col("window.start").alias("started_at"), F.col("window.end").alias("ended_at"), *keys, "n")


def sessions(rows: DataFrame, at: str, gap: str, late: str, owner: str) -> DataFrame:
    """Sessions of an owner, put out once no late row can extend them."""
    x = rows.withWatermark(at, late).groupBy(F.session_window(at, gap), owner).agg(F.count("*").alias("n"))
    return x.select(owner, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n")
