"""As-of, interval, nearest and gated joins. All are equi-joins on the owner first; ranges only refine them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import geo, times
from tidelog.session import written

#: Candidates of all cells that are sent to every task at most.
SENT_NODES = 100_000


def asof(left: DataFrame, right: DataFrame, owner: str, at: str, right_at: str, keep: list[str], tie: str, strict: bool = False) -> DataFrame:
    """left with the columns `keep` (and right_at) of the latest right row of the owner at or before `at` (before, if strict).

    Both sides are one union, sorted once by owner and time; the last right row is carried forward. Of right rows at one
    time the last by `tie` counts. No range join, so nothing grows with the product of the sides.
    """
    payload = F.struct(F.col(right_at), *(F.col(c) for c in keep))
    rows = left.select(F.col(owner), F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_s"), F.lit(None).cast("bigint").alias("_tie"), F.struct(*left.columns).alias("_left"))
    facts = right.select(F.col(owner), F.col(right_at).alias("_t"), F.lit(1 if strict else 0).alias("_s"), F.col(tie).cast("bigint").alias("_tie"), payload.alias("_right"))
    both = rows.unionByName(facts, allowMissingColumns=True)
    w = Window.partitionBy(owner).orderBy("_t", "_s", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = both.withColumn("_found", F.last("_right", True).over(w)).where("_left is not null")
    return x.select("_left.*", *(F.col(f"_found.{c}").alias(c) for c in [right_at, *keep]))


def in_windows(points: DataFrame, windows: DataFrame, owner: str, at: str, start: str, end: str, bucket_hours: float, aggs: list[Column], keys: list[str], closed: str = "both") -> DataFrame:
    """Aggregates of an owner's points in each window [start, end]; windows without points stay, with the aggregates of none.

    The join key is owner and a time bucket: a window is repeated for the buckets that it meets, so a busy owner is
    spread over tasks and compares only neighbours in time.
    """
    size = int(bucket_hours * 3.6e9)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    bucket = lambda x: F.floor(F.timestamp_diff("MICROSECOND", epoch, x) / size).cast("bigint")
    spread = windows.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), F.greatest(bucket(F.col(end)), bucket(F.col(start))))))
    facts = points.withColumn("_b", bucket(F.col(at))).withColumnRenamed(owner, "_owner").withColumnRenamed("_b", "_b2")
    upper = F.col(at) <= F.col(end) if closed in ("both", "right") else F.col(at) < F.col(end)
    lower = F.col(at) >= F.col(start) if closed in ("both", "left") else F.col(at) > F.col(start)
    joined = spread.join(facts, (F.col(owner) == F.col("_owner")) & (F.col("_b") == F.col("_b2")) & lower & upper, "left")
    return joined.groupBy(*keys).agg(*aggs)


def nearest_event(decisions: DataFrame, events: DataFrame, owner: str, key: str, at: str, event_at: str) -> DataFrame:
    """The event of the owner nearest in time to each decision, the earliest on ties, and how many come at or after it.

    Both sides are one union, sorted once by owner and time: the last event at or before a decision and the first one at or
    after it are carried to it, so nothing grows with the product of an owner's decisions and events. Decisions of owners
    without events are left out.
    """
    rows = decisions.select(owner, F.col(key).alias("_key"), F.col(at).alias("_t"), F.lit(None).cast("timestamp_ntz").alias("_e"))
    facts = events.select(owner, F.lit(None).cast(decisions.schema[key].dataType).alias("_key"), F.col(event_at).alias("_t"), F.col(event_at).alias("_e"))
    w = Window.partitionBy(owner).orderBy("_t")
    # By time alone, rows of one time are peers, and both ranges hold all of them.
    upto, on = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    x = rows.unionByName(facts).withColumns({"_before": F.max("_e").over(upto), "_after": F.min("_e").over(on), "n_after": F.count("_e").over(on)})
    off = lambda c: F.abs(F.timestamp_diff("MICROSECOND", F.col(c), F.col("_t")))
    nearest = F.when(F.col("_after").isNull() | (off("_before") <= off("_after")), F.col("_before")).otherwise(F.col("_after"))
    x = x.where(F.col("_e").isNull() & F.coalesce("_before", "_after").isNotNull()).withColumn("nearest_at", nearest)
    return x.select(owner, F.col("_key").alias(key), "nearest_at", (off("nearest_at") / F.lit(3.6e9)).alias("off_h"), "n_after")


#: Parts into which a memory is dealt for queries: each of them meets every part, by an equal join.
PARTS = 64


def all_pairs(queries: DataFrame, memory: DataFrame, m_key: str, on: list[tuple[str, str]] = ()) -> DataFrame:
    """Each query (a stated set) with every row of the memory, or with those of equal columns `on` (query's, memory's).

    The memory is dealt into PARTS by a hash of its key, and a query goes to each part once: an equal join whose tasks hold a
    share of a gate's rows each, however many they are. Neither side is sent whole to all tasks.
    """
    dealt = memory.withColumn("_part", F.pmod(F.xxhash64(m_key), F.lit(PARTS)).cast("int"))
    asked = queries.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    same = F.col("_part") == F.col("_to")
    for a, b in on:
        same = same & (F.col(a) == F.col(b))
    return dealt.join(asked, same).drop("_part", "_to")


def gated_pairs(queries: DataFrame, memory: DataFrame, gate: str, owner: str, least: int) -> DataFrame:
    """Pairs of queries (with q_owner, q_gate) and memories of other owners: those of the query's gate if it has `least`
    others, else all; with _gated."""
    sizes = memory.groupBy(F.col(gate).alias("q_gate")).agg(F.countDistinct(owner).alias("_owners"))
    q = queries.join(sizes, "q_gate", "left").withColumn("_gated", F.coalesce(F.col("_owners") >= least + 1, F.lit(False))).drop("_owners")
    inside = all_pairs(q.where("_gated"), memory, owner, [("q_gate", gate)])
    return inside.unionByName(all_pairs(q.where("not _gated"), memory, owner)).where(F.col("q_owner") != F.col(owner))


def gated_knn(queries: DataFrame, memory: DataFrame, gate: str, owner: str, distance: Column, k: int, min_owners: int = 3) -> DataFrame:
    """The k nearest owners of each query: among those of its gate if that has min_owners others, else among all.

    queries: q_id, q_owner, q_gate and what distance needs; memory: m_id, m_<owner>, m_<gate> and the same. An owner
    counts once, by its nearest row; ties go to the smaller id. Each task keeps the best row of an owner before anything
    else is shuffled.
    """
    pairs = gated_pairs(queries, memory, f"m_{gate}", f"m_{owner}", min_owners).select("q_id", "_gated", "m_id", F.col(f"m_{owner}").alias("m_owner"), distance.alias("distance"))
    best = pairs.groupBy("q_id", "_gated", "m_owner").agg(F.min(F.struct("distance", "m_id")).alias("x"))
    w = Window.partitionBy("q_id").orderBy("x.distance", "x.m_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", F.col("_gated").alias("gated"), "rank", "m_owner", F.col("x.m_id").alias("m_id"), F.col("x.distance").alias("distance"))


def snap(points: DataFrame, nodes: DataFrame, cell_deg: float, limit_nm: float, radius: float, key: str) -> DataFrame:
    """The nearest node of each point within limit_nm. nodes: node, node_lat, node_lon, node_i, node_j (cell numbers).

    Points of one cell have the same candidates: of the nodes in cells around it that the limit can reach, those that may
    be nearest to some place in it. So only cells are repeated for the cells around them, and a point meets a few nodes.
    """
    import math

    reach_lat = math.ceil(limit_nm / 60 / cell_deg) + 1
    around = lambda c: F.sequence(F.col(c) - reach_lat, F.col(c) + reach_lat)
    own = {"_i": geo.cell(F.col("lat"), cell_deg), "_j": geo.cell(F.col("lon"), cell_deg)}
    cells = points.select(*(c.alias(name) for name, c in own.items())).distinct()
    near = cells.withColumn("node_i", F.explode(around("_i"))).withColumn("node_j", F.explode(around("_j"))).join(nodes, ["node_i", "node_j"])
    # No place in a cell is farther from its centre than half a diagonal at the equator.
    half = radius * math.radians(cell_deg) / 2**0.5 * (1 + 1e-6)
    near = near.withColumn("_d", geo.haversine(geo.centre(F.col("_i"), cell_deg), geo.centre(F.col("_j"), cell_deg), F.col("node_lat"), F.col("node_lon"), radius)).where(F.col("_d") <= limit_nm + half)
    near = near.withColumn("_least", F.min("_d").over(Window.partitionBy("_i", "_j"))).where(F.col("_d") <= F.col("_least") + 2 * half)
    near = written(near.groupBy("_i", "_j").agg(F.collect_list(F.struct("node", "node_lat", "node_lon")).alias("_nodes")))
    sent = near.agg(F.sum(F.size("_nodes"))).first()[0] or 0
    x = points.withColumns(own).join(F.broadcast(near) if sent <= SENT_NODES else near, ["_i", "_j"])
    to = lambda n: F.struct(geo.haversine(F.col("lat"), F.col("lon"), n["node_lat"], n["node_lon"], radius).alias("snap_nm"), n["node"].alias("node"))
    x = x.select(key, F.array_min(F.transform("_nodes", to)).alias("x")).groupBy(key).agg(F.min("x").alias("x"))
    # The limit comes after the minimum: before it, each distance would be computed once more for it.
    return x.where(F.col("x.snap_nm") <= limit_nm).select(key, F.col("x.node").alias("node"), F.col("x.snap_nm").alias("snap_nm"))


def trailing_motion(points: DataFrame, owner: str, at: str, minutes: dict[str, int], radius_km: float) -> DataFrame:
    """points (lat, lon, sog_raw) with the median speed, the way travelled and the net displacement of the minutes up to
    each: speed_, travelled_km_ and net_km_ with each name. One sort by owner and time serves all of them."""
    t = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))
    w = Window.partitionBy(owner).orderBy("_t")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"), radius_km)
    x = points.withColumn("_t", t).withColumn("_km", step)
    for name, length in minutes.items():
        over = w.rangeBetween(-length * 60_000_000, Window.currentRow)
        net = geo.haversine(F.first("lat").over(over), F.first("lon").over(over), F.col("lat"), F.col("lon"), radius_km)
        median = F.percentile("sog_raw", F.lit(0.5)).over(over)
        x = x.withColumns({f"speed_{name}": median, f"travelled_km_{name}": F.sum("_km").over(over), f"net_km_{name}": net})
    return x.drop("_t", "_km")


def decision_panel(sessions: DataFrame, states: DataFrame, owner: str, key: str, start: str, end: str, minutes: int, lag_minutes: int, max_age_s: float, keep: list[str]) -> DataFrame:
    """A row for each session and wall-clock tick in [start, end): the latest state, that of lag_minutes before, age, quality."""
    ticks = sessions.withColumn("tick", F.explode(times.grid(F.col(start), F.col(end), minutes)))
    now = asof(ticks, states, owner, "tick", "recorded_at", keep, "id").withColumnRenamed("recorded_at", "seen_at")
    lagged = now.withColumn("lag_tick", F.timestamp_add("MINUTE", F.lit(-lag_minutes), F.col("tick")))
    past = states.select(owner, "id", "recorded_at", *(F.col(c).alias(f"lag_{c}") for c in keep))
    x = asof(lagged, past, owner, "lag_tick", "recorded_at", [f"lag_{c}" for c in keep], "id").withColumnRenamed("recorded_at", "lag_seen_at")
    # What was seen before the session began doesn't count.
    inside, lag_inside = F.col("seen_at") >= F.col(start), F.col("lag_seen_at") >= F.col(start)
    x = x.withColumns({c: F.when(inside, F.col(c)) for c in ["seen_at", *keep]} | {f"lag_{c}": F.when(lag_inside, F.col(f"lag_{c}")) for c in ["seen_at", *keep]})
    x = x.withColumn("age_s", times.seconds_between(F.col("seen_at"), F.col("tick")))
    return x.withColumn("fresh", F.coalesce(F.col("age_s") <= max_age_s, F.lit(False)))
