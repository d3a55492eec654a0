"""Queries that run as streams until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.plans.registry import query
from tidelog.plans.temporal import SLOW, STATES_SQL
from tidelog.sources.domain import placed
from tidelog.streaming import states


@query(STATES_SQL + " SELECT motion_state, count(*) AS n, round(sum(stopped_s), 1) AS stopped_s FROM st GROUP BY 1")
def stream_states(spark, sf):
    """Equal to the batch layer: the log is one file, or files in time order."""
    x = placed(states.events(spark, sf)).withColumnRenamed("sog_raw", "sog").select("owner", "id", "recorded_at", "lat", "lon", "sog")
    return states.run_once(states.motion(x, SLOW)).groupBy("motion_state").agg(F.count("*").alias("n"), F.round(F.sum("stopped_s"), 1).alias("stopped_s"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS started_at, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def stream_windows(spark, sf):
    x = states.events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    return states.run_once(states.windows(x, "at", "6 hours", "1 day", ["event_type"])).select(F.col("started_at").cast("timestamp_ntz").alias("started_at"), "event_type", "n")


@query("""SELECT user_id, started_at, n FROM (SELECT user_id, s, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS ended_at, count(*) AS n FROM (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS x FROM events)) GROUP BY 1, 2) WHERE ended_at <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions(spark, sf):
    x = states.events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    return states.run_once(states.sessions(x, "at", "6 hours", "1 day", "user_id")).select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "n")
