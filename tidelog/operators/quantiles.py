"""Exact order statistics of large groups, and of all folds but one, without sorting a group in one task.

A sketch gives each group edges of about equal depth, which cut it into cells; counts by cell tell which cell holds a place,
and only the values of that cell are then put in order. Equal values are one value with a count, so neither an outlier nor
a value that very many rows have makes a cell large. For the rows outside a fold, the counts of a cell are those of all
folds less the fold's own, so rows aren't repeated for each fold, but for those in the cells looked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import written

#: Cells of a group: COARSE * COARSE at most; a group with fewer rows than SMALL is one cell.
COARSE, SMALL, ACCURACY = 16, 50_000, 4096
#: Groups whose edges, of 2 kB each, come to the driver and go to all tasks at most.
SENT = 2000


def celled(rows: DataFrame, group: Column, value: str) -> DataFrame:
    """rows with a value, with _g (the group as a struct), _v and _c: cells in the order of values, equal values in one."""
    x = rows.where(F.col(value).isNotNull()).withColumns({"_g": group, "_v": F.col(value).cast("double")})
    shares = [F.lit(k / COARSE**2) for k in range(1, COARSE**2)]
    edges = x.groupBy("_g").agg(F.count("*").alias("_size"), F.percentile_approx("_v", F.array(*shares), F.lit(ACCURACY)).alias("_edges"))
    edges = edges.where(F.col("_size") >= SMALL).select("_g", "_edges")
    # The edges of few groups are sent to the rows; those of more are joined by a shuffle.
    few = edges.limit(SENT + 1).collect()
    x = x.join(F.broadcast(rows.sparkSession.createDataFrame(few, edges.schema)) if len(few) <= SENT else edges, "_g", "left")
    below = lambda at: F.coalesce((F.get("_edges", at) < F.col("_v")).cast("int"), F.lit(0))
    # The number of edges below the value: by blocks of edges first, then inside the block.
    x = x.withColumn("_block", sum((below(F.lit(k * COARSE - 1)) for k in range(2, COARSE)), below(F.lit(COARSE - 1))))
    fine = sum((below(F.col("_block") * COARSE + k) for k in range(1, COARSE)), below(F.col("_block") * COARSE))
    return x.withColumn("_c", F.when(F.col("_edges").isNull(), 0).otherwise(F.col("_block") * COARSE + fine)).drop("_edges", "_block")


def statistics(rows: DataFrame, by: list[str], value: str, places: Callable[[Column], Column], fold: str | None = None, once: bool = True) -> DataFrame:
    """(by, n, place, value): the values at an array of places (from 1) given in terms of a group's number of rows n. With
    fold also _f: for each fold, the same of the rows of all others. Rows are written out unless once is False, which is for
    rows that come from a table anyway."""
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("_"))
    # A sketch, its edges and two passes over the cells read these rows: three columns, computed once.
    narrow = rows.select(group.alias("_group"), F.col(value).alias("_value"), (F.col(fold) if fold else F.lit(0)).alias("_o"))
    narrow = written(narrow) if once else narrow
    x = celled(narrow, F.col("_group"), "_value").select("_g", "_c", "_v", "_o")
    counts = x.groupBy("_g", "_c", "_o").agg(F.count("*").alias("_m"))
    whole = counts.groupBy("_g", "_c").agg(F.sum("_m").alias("_m"), F.map_from_entries(F.collect_list(F.struct("_o", "_m"))).alias("_own"))
    if fold:
        # Folds are few; they come to each cell as one row.
        folds = narrow.select(F.col("_o").alias("_f")).distinct().agg(F.collect_list("_f").alias("_fs"))
        whole = whole.crossJoin(F.broadcast(folds)).withColumn("_f", F.explode("_fs")).withColumn("_m", F.col("_m") - F.coalesce(F.try_element_at("_own", F.col("_f")), F.lit(0)))
    else:
        whole = whole.withColumn("_f", F.lit(None).cast("int"))
    one = Window.partitionBy("_g", "_f")
    whole = whole.withColumns({"_upto": F.sum("_m").over(one.orderBy("_c")), "n": F.sum("_m").over(one)}).where("_m > 0")
    held = whole.withColumn("place", F.explode(F.array_distinct(places(F.col("n"))))).where((F.col("place") <= F.col("_upto")) & (F.col("place") > F.col("_upto") - F.col("_m")))
    wanted = held.groupBy("_g", "_f", "_c", "n").agg(F.collect_list(F.struct("place", (F.col("place") - F.col("_upto") + F.col("_m")).alias("k"))).alias("_places"))
    inside = x.groupBy("_g", "_c", "_o", "_v").agg(F.count("*").alias("_m")).join(wanted, ["_g", "_c"])
    inside = inside.where(F.col("_o") != F.col("_f")) if fold else inside
    values = inside.groupBy("_g", "_f", "_c", "n", "_places", "_v").agg(F.sum("_m").alias("_m"))
    run = values.withColumn("_upto", F.sum("_m").over(Window.partitionBy("_g", "_f", "_c").orderBy("_v")))
    here = F.filter("_places", lambda p: (p["k"] <= F.col("_upto")) & (p["k"] > F.col("_upto") - F.col("_m")))
    found = run.withColumn("_p", F.explode(here))
    return found.select(*(F.col("_g")[c].alias(c) for c in by), *(["_f"] if fold else []), "n", F.col("_p.place").alias("place"), F.col("_v").alias(value))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], fold: str | None = None, once: bool = True) -> DataFrame:
    """(by, n, q): the values at shares of a group, linear between neighbours, as an array; with fold also _f, as above."""
    at = lambda n, p: (n - 1) * F.lit(float(p))
    ends = lambda n: F.array(*((f(at(n, p)) + 1).cast("bigint") for p in shares for f in (F.floor, F.ceil)))
    keys = [*by, *(["_f"] if fold else []), "n"]
    found = statistics(rows, by, value, ends, fold, once).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", value))).alias("_at"))
    n = F.col("n")

    def between(p: float) -> Column:
        low, high = (F.element_at("_at", (f(at(n, p)) + 1).cast("bigint")) for f in (F.floor, F.ceil))
        return low + (high - low) * (at(n, p) - F.floor(at(n, p)))

    return found.select(*keys, F.array(*map(between, shares)).alias("q"))


def by_levels(rows: DataFrame, keys: list[str | None], value: str, shares: list[float], fold: str | None = None) -> list[DataFrame]:
    """For each key, (_k as text, n, q) of its groups, and of all rows for None; with fold also _f. One pass serves all keys,
    and what it finds is written out, as several joins read it."""
    level = lambda i, key: F.struct(F.lit(i).alias("_level"), (F.col(key) if key else F.lit(None)).cast("string").alias("_k"))
    stacked = rows.select(F.explode(F.array(*(level(i, key) for i, key in enumerate(keys)))).alias("_x"), value, *([fold] if fold else []))
    found = written(quantiles(stacked.select("_x.*", value, *([fold] if fold else [])), ["_level", "_k"], value, shares, fold))
    return [found.where(F.col("_level") == i).drop("_level") for i in range(len(keys))]


def summary(rows: DataFrame, by: list[str], value: str, aggs: list[Column], shares: dict[str, float], digits: int = 6) -> DataFrame:
    """The aggregates of each group, with the values at shares of it under their names, rounded; one row if by is empty. The
    rows are written out: give no more columns than aggs need."""
    rows = written(rows)
    found = quantiles(rows, by, value, list(shares.values()), once=False)
    found = found.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.round(F.col("q")[i], digits).alias(name) for i, name in enumerate(shares)))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    base = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    return base.join(found, same, "left").drop(*(f"_{c}" for c in by))


def weighted(rows: DataFrame, by: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """(by, shares' names): the first value at which the running weight reaches each share of the whole."""
    narrow = written(rows.where(F.col(weight) > 0).select(F.struct(*(F.col(c) for c in by)).alias("_group"), F.col(value).alias("_value"), F.col(weight).alias("_w")))
    x = celled(narrow, F.col("_group"), "_value").select("_g", "_c", "_v", "_w")
    one = Window.partitionBy("_g")
    cells = x.groupBy("_g", "_c").agg(F.sum("_w").alias("_w")).withColumns({"_upto": F.sum("_w").over(one.orderBy("_c")), "_total": F.sum("_w").over(one)})
    cells = cells.select("_g", "_c", (F.col("_upto") - F.col("_w")).alias("_before"), "_upto", "_total")
    # A cell with some slack on both sides, so that the order of summing doesn't decide which one holds a share.
    wanted = cells.where(F.exists(F.array(*map(F.lit, shares.values())), lambda q: (F.col("_upto") >= (q - 1e-9) * F.col("_total")) & (F.col("_before") <= (q + 1e-9) * F.col("_total"))))
    inside = x.groupBy("_g", "_c", "_v").agg(F.sum("_w").alias("_w")).join(wanted.drop("_upto"), ["_g", "_c"])
    cdf = (F.col("_before") + F.sum("_w").over(Window.partitionBy("_g", "_c").orderBy("_v"))) / F.col("_total")
    found = inside.withColumn("_cdf", cdf).groupBy("_g").agg(*(F.min(F.when(F.col("_cdf") >= q - 1e-12, F.col("_v"))).alias(name) for name, q in shares.items()))
    return found.select(*(F.col("_g")[c].alias(c) for c in by), *shares)


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with the average rank of the value in its group; those without a value are left out."""
    x = celled(rows, F.struct(*(F.col(c) for c in by)), value)
    counts = x.groupBy("_g", "_c", "_v").agg(F.count("*").alias("_m"))
    cells = counts.groupBy("_g", "_c").agg(F.sum("_m").alias("_k"))
    cells = cells.withColumn("_before", F.sum("_k").over(Window.partitionBy("_g").orderBy("_c")) - F.col("_k")).drop("_k")
    upto = F.sum("_m").over(Window.partitionBy("_g", "_c").orderBy("_v"))
    ranks = counts.withColumn("_upto", upto).join(cells, ["_g", "_c"]).select("_g", "_v", (F.col("_before") + F.col("_upto") - (F.col("_m") - 1) / 2).alias(name))
    return x.drop("_c").join(ranks, ["_g", "_v"]).drop("_g", "_v")
