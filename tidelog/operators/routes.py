"""Routes towards a gate, fitted on training calls: prototypes by sector and as a whole, single paths, remaining ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import geo
from tidelog.operators import experts

WHOLE = "PORT"
#: Kilometres in a degree of latitude, by the mean radius.
KM_PER_DEGREE = 111.1950802335329


def family(lat: Column, lon: Column, gate: tuple[float, float]) -> Column:
    """The sector that a place lies in, seen from the gate (lat, lon)."""
    bearing = geo.bearing(F.lit(gate[0]), F.lit(gate[1]), lat, lon)
    return F.when(bearing < 60, "NNE").when(bearing < 120, "E").when(bearing < 180, "SSE").otherwise("OTHER")


def fit(crossings: DataFrame, gate: tuple[float, float], least_support: int = 3, least_calls: int = 5) -> tuple[DataFrame, DataFrame]:
    """(prototypes, paths) of training calls: route, seq, lat, lon and, of prototypes, level_km and support.

    crossings: call, level_km, lat, lon, the last inward crossing of each ring. A call counts with two rings and the gate at
    least; its family is the sector of its outermost crossing. A prototype has the medians of the crossings of each ring
    that least_support calls have, then the gate; a family has one of its own with least_calls calls and three points.
    """
    calls = crossings.groupBy("call").agg(F.count("*").alias("_n"), F.max_by(F.struct("lat", "lon"), "level_km").alias("_far")).where("_n >= 2")
    calls = calls.select("call", family(F.col("_far.lat"), F.col("_far.lon"), gate).alias("family"))
    known = crossings.join(calls, "call")
    outside_in = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("level_km")))
    end = known.select("call", F.lit(0.0).alias("level_km"), F.lit(gate[0]).alias("lat"), F.lit(gate[1]).alias("lon")).distinct()
    paths = known.select("call", "level_km", "lat", "lon").unionByName(end)
    paths = paths.select(F.col("call").alias("route"), outside_in("call").alias("seq"), "lat", "lon")
    each = known.withColumn("route", F.explode(F.array(F.lit(WHOLE), "family")))
    sizes = each.groupBy("route").agg(F.count_distinct("call").alias("calls")).where((F.col("route") == WHOLE) | (F.col("calls") >= least_calls))
    points = each.groupBy("route", "level_km").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count("*").alias("support")).where(F.col("support") >= least_support)
    points = points.join(sizes.select("route"), "route")
    gates = sizes.select("route", F.lit(0.0).alias("level_km"), F.lit(gate[0]).alias("lat"), F.lit(gate[1]).alias("lon"), F.col("calls").alias("support"))
    whole = points.select("route", "level_km", "lat", "lon", "support").unionByName(gates)
    sound = whole.groupBy("route").agg(F.count("*").alias("_n")).where("_n >= 3").select("route")
    return whole.join(sound, "route").select("route", outside_in("route").alias("seq"), "lat", "lon", "level_km", "support"), paths


def predict(points: DataFrame, prototypes: DataFrame, paths: DataFrame, gate: tuple[float, float], k: int = 5) -> DataFrame:
    """Remaining ways of points (key, call, lat, lon): family, kind (sector or port_fallback), prototype_km,
    prototype_cross_km, knn_km (the median of the k paths that pass nearest), knn_used, knn_cross_km, knn_calls.

    The prototype is that of the point's sector, else the whole port's. A point's own call is not among its paths, and a
    point without a place has none.
    """
    x = points.withColumn("family", family(F.col("lat"), F.col("lon"), gate))
    own = prototypes.select(F.col("route").alias("family"), F.lit(True).alias("_own")).distinct()
    x = x.join(F.broadcast(own), "family", "left").withColumn("kind", F.when(F.col("_own"), "sector").otherwise("port_fallback")).drop("_own")
    ways = lambda routes: experts.along_route(points.select("key", "lat", "lon"), routes.select("route", "seq", "lat", "lon"), "key", gate[0], KM_PER_DEGREE)
    on = ways(prototypes).select("key", F.col("route").alias("_route"), F.col("remaining_km").alias("prototype_km"), F.col("cross_km").alias("prototype_cross_km"))
    x = x.withColumn("_route", F.when(F.col("kind") == "sector", F.col("family")).otherwise(WHOLE)).join(on, ["key", "_route"], "left").drop("_route")
    near = experts.nearest_routes(points.select("key", "call", "lat", "lon"), paths.select("route", "seq", "lat", "lon"), "key", "call", k, gate[0], KM_PER_DEGREE)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("_r", "route"))), lambda r: r["route"])
    near = near.groupBy("key").agg(F.median("remaining_km").alias("knn_km"), F.count("*").alias("knn_used"), F.avg("cross_km").alias("knn_cross_km"), ranked.alias("knn_calls"))
    return x.join(near, "key", "left")
