"""The driver's tables in the roles of the domain, in Spark and, word for word, in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.tables import table

#: Observations: raw values with sentinels and out-of-range entries, from the event log.
POSITIONS_SQL = """pos AS (SELECT event_id AS id, user_id AS owner, ts AS recorded_at, event_type,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k, value AS sog_raw,
  CAST(json_extract(props, '$.k') AS INTEGER) * 37e-1 AS cog_raw, CAST(json_extract(props, '$.k') AS INTEGER) * 52e-1 AS heading_raw,
  CAST(event_id % 17 AS INTEGER) AS nav_raw,
  37e0 + (CAST(json_extract(props, '$.k') AS INTEGER) - 50) * 1e-2 + (event_id % 7) * 1e-4 AS lat,
  15e0 + ((event_id * 37) % 100 - 50) * 1e-2 AS lon FROM events)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "events"))


def placed(events: DataFrame) -> DataFrame:
    """Rows of the event log, batch or stream, as observations."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("owner"),
        F.col("ts").alias("recorded_at"),
        "event_type",
        k.alias("k"),
        F.col("value").alias("sog_raw"),
        (k * 3.7).alias("cog_raw"),
        (k * 5.2).alias("heading_raw"),
        (F.col("event_id") % 17).cast("int").alias("nav_raw"),
        (37.0 + (k - 50) * 0.01 + (F.col("event_id") % 7) * 0.0001).alias("lat"),
        (15.0 + ((F.col("event_id") * 37) % 100 - 50) * 0.01).alias("lon"),
    )


#: Reference rows: an order is a decision, its first shipment the target; two predictions stand beside the truth.
DECISIONS_SQL = """dec AS (SELECT o_orderkey AS key, o_custkey AS owner, o_orderdate AS decided_at, n_name AS destination, c_mktsegment AS ship_type,
  o_orderstatus AS status, n_regionkey AS region, o_totalprice AS price, c_acctbal AS balance, o_orderkey % 5 AS fold, y AS target_h,
  24.0 * (10 + o_orderkey % 53) AS pred_a, 24.0 * (20 + o_custkey % 41) AS pred_b, 24.0 * (5 + (o_orderkey * 7) % 83) AS pred_c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN (SELECT l_orderkey, date_diff('microsecond', TIMESTAMP '1995-01-01', min(l_shipdate)) / 3.6e9 AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey,
  LATERAL (SELECT f - date_diff('microsecond', TIMESTAMP '1995-01-01', o_orderdate) / 3.6e9 AS y) WHERE y > 0)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"))
    x = orders.join(first, "o_orderkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    hours = lambda at: F.timestamp_diff("MICROSECOND", start, F.col(at)) / F.lit(3.6e9)
    return x.select(
        F.col("o_orderkey").alias("key"),
        F.col("o_custkey").alias("owner"),
        F.col("o_orderdate").alias("decided_at"),
        F.col("n_name").alias("destination"),
        F.col("c_mktsegment").alias("ship_type"),
        F.col("o_orderstatus").alias("status"),
        F.col("n_regionkey").alias("region"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"),
        (F.col("o_orderkey") % 5).alias("fold"),
        (hours("first") - hours("o_orderdate")).alias("target_h"),
        (24.0 * (10 + F.col("o_orderkey") % 53)).alias("pred_a"),
        (24.0 * (20 + F.col("o_custkey") % 41)).alias("pred_b"),
        (24.0 * (5 + (F.col("o_orderkey") * 7) % 83)).alias("pred_c"),
    ).where("target_h > 0")
