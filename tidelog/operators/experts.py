"""Predictors of a remaining time: prior, physics, analogue, route, corridor; and what they need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import CorridorConfig, PriorConfig
from tidelog.functions import arrays, geo, numeric, text, times
from tidelog.operators import joins, quantiles
from tidelog.session import written

# Words of a destination that name no place, and names that more than one place could be meant by.
UNKNOWN_WORDS = ("", "UNKNOWN", "N A", "NA", "N/A", "NONE", "NULL", "NOT AVAILABLE")
ORDER_WORDS = ("FOR ORDER", "FOR ORDERS", "ORDER", "ORDERS", "FO")
VAGUE_WORDS = ("ATLANTIC OCEAN", "MARE", "WORKSITE", "IN PORT")
AMBIGUOUS_NAMES = ("MALTA",)
FUZZY_LEAST, FUZZY_MARGIN, FUZZY_LENGTH = 0.94, 0.04, 5
#: Columns of a resolution, besides the text.
RESOLVED = ("normal", "terminal", "is_route", "canonical", "code", "name", "country", "lat", "lon", "method", "confidence", "is_resolved", "is_vague")


def resolve(raw: DataFrame, catalog: DataFrame, ambiguous: tuple[str, ...] = AMBIGUOUS_NAMES, fuzzy: bool = True) -> DataFrame:
    """What each distinct text stands for: text, then RESOLVED.

    raw has `text`; catalog has code, name, aliases (joined by semicolons) and, if known, country, lat and lon. Every
    distinct text is resolved once, by equal joins in the order unknown, orders, vague, ambiguous, code, alias; only what is
    left is compared with aliases, those that share a part with it, by similarity. A code that looks like one but isn't in
    the catalogue names no place for sure. Two rows of one code, or an alias of two codes, are errors in the catalogue.
    """
    catalog = catalog.withColumns({c: F.lit(None).cast(kind) for c, kind in (("country", "string"), ("lat", "double"), ("lon", "double")) if c not in catalog.columns})
    catalog = catalog.withColumn("code", text.compact(F.col("code")))
    x = raw.select("text").distinct().withColumn("normal", F.coalesce(text.folded(F.col("text")), F.lit("")))
    x = x.withColumns({"terminal": F.coalesce(text.terminal(F.col("normal")), F.col("normal")), "is_route": text.is_route(F.col("normal"))})
    x = x.withColumn("_compact", text.compact(F.col("terminal")))
    names = catalog.select(F.col("code").alias("_code"), F.explode(F.concat(F.array("name", "code"), F.split(F.coalesce("aliases", F.lit("")), ";"))).alias("_alias"))
    names = names.withColumn("_alias", text.folded(F.col("_alias"))).where("_alias <> ''")
    names = names.withColumn("_key", F.when(text.code_like(F.col("_alias")), text.compact(F.col("_alias"))).otherwise(F.col("_alias")))
    fail = lambda what, key: F.raise_error(F.concat(F.lit(what), F.col(key))).cast("string")
    exact = names.groupBy("_key").agg(F.min("_code").alias("_low"), F.max("_code").alias("_high"))
    exact = exact.select("_key", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(fail("an alias of two codes: ", "_key")).alias("_by_alias"))
    once = catalog.groupBy("code").agg(F.count("*").alias("_n"), F.first(F.struct("name", "country", "lat", "lon")).alias("_place"))
    once = once.select(F.when(F.col("_n") == 1, F.col("code")).otherwise(fail("a code of two rows: ", "code")).alias("_by_code"), "_place")
    x = x.withColumn("_key", F.when(text.code_like(F.col("terminal")), F.col("_compact")).otherwise(F.col("terminal")))
    x = x.join(once.select("_by_code"), F.col("_compact") == F.col("_by_code"), "left").join(exact, "_key", "left")
    t = F.col("terminal")
    kind = (
        F.when(t.isin(*UNKNOWN_WORDS) | F.col("_compact").isin("", "UNKNOWN", "NA", "NONE", "NULL", "NOTAVAILABLE"), "unknown")
        .when(t.isin(*ORDER_WORDS) | F.col("normal").contains("FOR ORDER"), "for_orders")
        .when(t.isin(*VAGUE_WORDS), "non_specific")
        .when(t.isin(*ambiguous) if ambiguous else F.lit(False), "ambiguous_geography")
        .when(F.col("_by_code").isNotNull(), "exact_code")
        .when(F.col("_by_alias").isNotNull(), "alias")
    )
    x = x.withColumn("_kind", kind)
    if fuzzy:
        x = x.join(closest(x.where("_kind is null"), names), "terminal", "left").withColumn("_kind", F.coalesce("_kind", F.when(F.col("_fuzzy").isNotNull(), "fuzzy")))
    else:
        x = x.withColumns({"_fuzzy": F.lit(None).cast("string"), "_score": F.lit(None).cast("double")})
    unlisted = F.col("_compact").rlike("^[A-Z]{2}[A-Z0-9]{3}$")
    x = x.withColumn("_kind", F.coalesce("_kind", F.when(unlisted, "code_like_unverified").otherwise("unresolved_text")))
    k = F.col("_kind")
    found = F.when(k == "exact_code", F.col("_by_code")).when(k == "alias", F.col("_by_alias")).when(k == "fuzzy", F.col("_fuzzy"))
    x = x.withColumn("_found", found).join(once.select(F.col("_by_code").alias("_found"), "_place"), "_found", "left")
    code = F.coalesce("_found", F.when(k == "code_like_unverified", F.col("_compact")))
    canonical = (
        F.when(k == "unknown", "UNKNOWN").when(k == "for_orders", "FOR_ORDERS").when(k == "non_specific", "NON_SPECIFIC")
        .when(k == "ambiguous_geography", F.concat(F.lit("AMBIGUOUS:"), t)).otherwise(F.coalesce(code, F.concat(F.lit("TEXT:"), t)))
    )
    confidence = F.when(k == "alias", 0.99).when(k == "fuzzy", F.col("_score")).when(k == "code_like_unverified", 0.7).when(k == "unresolved_text", 0.0).otherwise(1.0)
    method = F.when(F.col("is_route") & k.isin("exact_code", "alias", "fuzzy"), F.concat(F.lit("route_"), k)).otherwise(k)
    country = F.coalesce(F.col("_place.country"), F.when(k == "code_like_unverified", F.substring("_compact", 1, 2)))
    place = {"name": F.col("_place.name"), "country": country, "lat": F.col("_place.lat"), "lon": F.col("_place.lon")}
    flags = {"is_resolved": F.col("_found").isNotNull(), "is_vague": k.isin("unknown", "for_orders", "non_specific")}
    new = {"canonical": canonical, "code": code, **place, "method": method, "confidence": confidence, **flags}
    return x.select("text", "normal", "terminal", "is_route", *(value.alias(name) for name, value in new.items()))


def closest(left: DataFrame, names: DataFrame) -> DataFrame:
    """(terminal, _fuzzy, _score) of texts that one code's aliases resemble clearly more than any other's.

    A code counts as another from a ratio of 0.94 - 0.04 on, which leaves a tenth of both lengths unmatched. Of an alias cut
    into one part more than that, some part stands whole in the text, and it has three letters at least: pairs meet on runs
    of three letters, not in a product.
    """
    low = FUZZY_LEAST - FUZZY_MARGIN
    runs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3)))))
    x = left.select("terminal").distinct().where(F.length("terminal") >= FUZZY_LENGTH).withColumn("_run", runs("terminal"))
    long_names = names.where((F.length("_alias") >= FUZZY_LENGTH) & ~text.code_like(F.col("_alias"))).select("_alias", "_code").distinct().withColumn("_run", runs("_alias"))
    both = F.length("terminal") + F.length("_alias")
    # The ratio is at most twice the shorter length over both, and the edit distance at most what is unmatched.
    near = (2 * F.least(F.length("terminal"), F.length("_alias")) >= low * both - 1e-9) & (F.levenshtein("terminal", "_alias") <= (1 - low) * both + 1e-9)
    met = x.join(long_names, "_run").where(near).select("terminal", "_alias", "_code").distinct()
    scored = met.withColumn("_s", text.similarity(F.col("terminal"), F.col("_alias")))
    best = scored.groupBy("terminal", "_code").agg(F.max("_s").alias("_s"))
    w = Window.partitionBy("terminal").orderBy(F.desc("_s"), "_code")
    ranked = best.withColumns({"_r": F.row_number().over(w), "_next": F.lead("_s", 1, 0.0).over(w)})
    return ranked.where((F.col("_r") == 1) & (F.col("_s") >= FUZZY_LEAST) & (F.col("_s") - F.col("_next") >= FUZZY_MARGIN)).select("terminal", F.col("_code").alias("_fuzzy"), F.col("_s").alias("_score"))


def hierarchical_prior(rows: DataFrame, target: str, cfg: PriorConfig = PriorConfig(), fold: str = "fold", train: DataFrame | None = None) -> DataFrame:
    """Priors: each row's prediction uses the targets of other folds only, or those of train, if that is given.

    From the global median down the levels, a level with enough support pulls the prediction towards its median with
    weight n / (n + alpha); predictions stay within the training quantiles. Folds are a column: the statistics of a fold
    are those of the rows outside it, made for all folds in one plan. Adds prediction, level, level_name, support, weight.
    """
    source, by = (rows, fold) if train is None else (train, None)
    same = (lambda: F.col(fold) == F.col("_f")) if by else (lambda: F.lit(True))
    mine = ["_f"] if by else []
    top, *levels = quantiles.by_levels(source, [None, *cfg.levels], target, [0.5, *cfg.clip], by)
    top = top.select(*mine, F.col("q")[0].alias("_p"), F.slice("q", 2, 2).alias("_q"))
    x = rows.join(F.broadcast(top), same(), "left").drop("_f").withColumns({"prediction": F.col("_p"), "level": F.lit(0), "level_name": F.lit("global"), "support": F.lit(0).cast("bigint"), "weight": F.lit(0.0)})
    low, high = F.col("_q")[0], F.col("_q")[1]
    for depth, (key, stats) in enumerate(zip(cfg.levels, levels, strict=True), 1):
        stats = stats.select(*mine, "_k", F.col("q")[0].alias("_m"), F.col("n").alias("_n"))
        x = x.join(stats, same() & F.col(key).cast("string").eqNullSafe(F.col("_k")), "left")
        ok = F.coalesce(F.col("_n") >= cfg.min_support, F.lit(False))
        w = F.col("_n") / (F.col("_n") + cfg.alpha)
        x = x.withColumns(
            {
                "prediction": F.when(ok, F.least(high, F.greatest(low, w * F.col("_m") + (1 - w) * F.col("prediction")))).otherwise(F.col("prediction")),
                "level": F.when(ok, depth).otherwise(F.col("level")),
                "level_name": F.when(ok, key).otherwise(F.col("level_name")),
                "support": F.when(ok, F.col("_n")).otherwise(F.col("support")),
                "weight": F.when(ok, w).otherwise(F.col("weight")),
            }
        ).drop("_f", "_k", "_m", "_n")
    return x.drop("_p", "_q")


def physics(distance_nm: Column, speed_a: Column, speed_b: Column, factor: Column) -> Column:
    """Hours by distance over speed: the first speed if it is at least 2 knots, else the second, within 2 and 25."""
    speed = F.when(speed_a >= 2, speed_a).otherwise(speed_b)
    return distance_nm * factor / numeric.clip(F.coalesce(speed, F.lit(2.0)), 2.0, 25.0)


def physics_eligible(resolved: Column, confidence: Column, distance_nm: Column, *speeds: Column) -> Column:
    return F.coalesce(resolved & (confidence >= 0.99) & (distance_nm >= 1.0) & (F.greatest(*speeds) >= 2.0), F.lit(False))


def sinuosity(travelled_km: Column, net_km: Column, most: float = 2.0) -> Column:
    """How much longer the way was than the straight line, of a kilometre at least: from 1 to most; 1 if unknown."""
    ratio = travelled_km / F.greatest(net_km, F.lit(1.0))
    return numeric.clip(F.coalesce(F.when(~F.isnan(ratio) & (F.abs(ratio) < float("inf")), ratio), F.lit(1.0)), 1.0, most)


def physics_features(rows: DataFrame, radius_nm: float) -> DataFrame:
    """rows with distance_nm, bearing_deg, alignment_deg (between course and bearing), sinuosity_180, sinuosity_360,
    recent_kn (the larger median speed) and eligible.

    rows: lat, lon, cog, place_lat, place_lon, is_resolved, confidence, and of the last 180 and 360 minutes speed_,
    travelled_km_ and net_km_. Missing values give null features, and no eligibility.
    """
    here, there = (F.col("lat"), F.col("lon")), (F.col("place_lat"), F.col("place_lon"))
    x = rows.withColumns({"distance_nm": geo.haversine(*here, *there, radius_nm), "bearing_deg": geo.bearing(*here, *there), "recent_kn": F.greatest("speed_180", "speed_360")})
    x = x.withColumns({f"sinuosity_{w}": sinuosity(F.col(f"travelled_km_{w}"), F.col(f"net_km_{w}")) for w in (180, 360)})
    x = x.withColumn("alignment_deg", geo.turn(F.col("cog"), F.col("bearing_deg")))
    return x.withColumn("eligible", physics_eligible(F.col("is_resolved"), F.col("confidence"), F.col("distance_nm"), F.col("recent_kn"), F.lit(0.0)))


def residual_corrected(
    rows: DataFrame, base: str, target: str, eligible: str, key: str, alpha: float = 10.0, min_support: int = 3, fold: str = "fold", train: DataFrame | None = None
) -> DataFrame:
    """corrected: base plus the median residual of eligible rows of other folds (or of train, if that is given), the key's
    shrunk towards the global one."""
    source, by = (rows, fold) if train is None else (train, None)
    same = (lambda: F.col(fold) == F.col("_f")) if by else (lambda: F.lit(True))
    # Residuals that don't count are null.
    known = source.withColumn("_r", F.when(F.col(eligible), F.col(target) - F.col(base)))
    mine = ["_f"] if by else []
    top, own = quantiles.by_levels(known, [None, key], "_r", [0.5], by)
    top, own = top.select(*mine, F.col("q")[0].alias("_g")), own.select(*mine, "_k", F.col("q")[0].alias("_m"), F.col("n").alias("_n"))
    x = rows.join(F.broadcast(top), same(), "left").drop("_f").join(own, same() & (F.col(key).cast("string") == F.col("_k")), "left")
    w = F.when(F.col("_n") >= min_support, F.col("_n") / (F.col("_n") + alpha)).otherwise(0.0)
    shift = F.coalesce(w * F.col("_m"), F.lit(0.0)) + (1 - w) * F.coalesce(F.col("_g"), F.lit(0.0))
    return x.withColumn("corrected", F.greatest(F.lit(0.0), F.col(base) + shift)).drop("_f", "_k", "_m", "_n", "_g")


def trajectories(points: DataFrame, owner: str, at: str, xs: list[str], n: int) -> DataFrame:
    """(owner, points): n points evenly spaced in time over each owner's observed span, by linear interpolation.

    Of equal times the least point counts; owners with fewer than two distinct times are left out. An owner's points are
    one array, so its window of history must be bounded; a step looks for the neighbours in it on either side.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    t = (F.timestamp_diff("MICROSECOND", epoch, F.col(at)) / F.lit(1e6)).alias("t")
    x = points.select(owner, t, *(F.col(c).cast("double").alias(name) for c, name in zip(xs, ("x", "y"), strict=True))).dropna()
    x = x.groupBy(owner, "t").agg(F.min(F.struct("x", "y")).alias("p")).select(owner, F.struct("t", F.col("p.x").alias("x"), F.col("p.y").alias("y")).alias("r"))
    x = x.groupBy(owner).agg(F.array_sort(F.collect_list("r")).alias("rows")).where(F.size("rows") > 1)
    rows, first, last = F.col("rows"), F.col("rows")[0]["t"], F.element_at("rows", -1)["t"]

    def between(a: Column, b: Column, t: Column) -> Column:
        part = F.when(b["t"] > a["t"], (t - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
        return F.struct((a["x"] + part * (b["x"] - a["x"])).alias("x"), (a["y"] + part * (b["y"] - a["y"])).alias("y"))

    time = lambda i: F.when(i == n - 1, last).otherwise(first + (last - first) * i / (n - 1))
    # Times, then neighbours, then places: each step's are looked for once, however often a place names them.
    around = lambda t: F.struct(F.element_at(F.filter(rows, lambda r: r["t"] <= t), -1).alias("a"), F.filter(rows, lambda r: r["t"] >= t)[0].alias("b"), t.alias("t"))
    steps = F.transform(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), time), around)
    return x.select(owner, F.transform(steps, lambda s: between(s["a"], s["b"], s["t"])).alias("points"))


#: Queries and memories that one task compares.
QUERIES, MEMORIES = 4_096, 8_192


def analogues(queries: DataFrame, memory: DataFrame, gate: str, k: int, min_gate: int = 3) -> DataFrame:
    """Prediction of each query from its k nearest memories by DTW: q_id, prediction, gap, neighbours.

    queries: q_id, q_owner, q_gate, q_points; memory: m_owner, m_gate, m_points, m_target. Candidates are those of the
    query's gate if there are min_gate others, else all; rows without an owner or points take no part. Weights fall exponentially with the distance over its median;
    the prediction is the weighted median, the gap how much farther the second neighbour is.
    """
    flat = lambda c: F.flatten(F.transform(c, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))).alias(c)
    m = memory.where("m_owner is not null and size(m_points) > 0").select("m_owner", "m_target", F.col("m_gate").alias("gate"), flat("m_points"))
    sizes = memory.groupBy(F.col("m_gate").alias("gate")).agg(F.countDistinct("m_owner").alias("_owners"), F.count("*").alias("_rows"))
    q = queries.where("q_owner is not null and size(q_points) > 0").select("q_id", "q_owner", F.col("q_gate").alias("gate"), flat("q_points"))
    q = written(q.join(sizes, "gate", "left").withColumn("_gated", F.coalesce(F.col("_owners") >= min_gate + 1, F.lit(False))).drop("_owners", "_rows"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((q, "q_id"), (m, "m_owner"), (m, "m_target"))}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("m_owner", "ascending"), ("m_target", "ascending")])
        i, j, d = arrays.dtw_nearest(left.column("q_points"), right.column("m_points"), left.column("q_owner").to_numpy(), right.column("m_owner").to_numpy(), k)
        of = left.take(pa.array(i)), right.take(pa.array(j))
        return pa.table([of[0].column("q_id"), of[1].column("m_owner"), of[1].column("m_target"), pa.array(d, pa.float64())], names=["q_id", "m_owner", "m_target", "d"])

    def met(q: DataFrame, m: DataFrame, on: list[str]) -> DataFrame:
        """Blocks of queries beside blocks of memories, of equal columns `on`: k rows of each are put out, no pairs."""
        blocks = lambda most: F.ceil(F.count("*") / most).cast("int")
        of = q.groupBy(*on).agg(blocks(QUERIES).alias("_qs")).join(m.groupBy(*on).agg(blocks(MEMORIES).alias("_ms")), on) if on else q.agg(F.greatest(F.lit(1), blocks(QUERIES)).alias("_qs")).crossJoin(m.agg(F.greatest(F.lit(1), blocks(MEMORIES)).alias("_ms")))
        of = F.broadcast(written(of))
        with_blocks = lambda x: x.join(of, on) if on else x.crossJoin(of)
        asked = with_blocks(q).withColumn("_q", part("q_id", "_qs")).withColumn("_m", every("_ms")).drop("_qs", "_ms")
        dealt = with_blocks(m).withColumn("_m", part("m_owner", "_ms")).withColumn("_q", every("_qs")).drop("_qs", "_ms")
        return asked.groupBy(*on, "_q", "_m").cogroup(dealt.groupBy(*on, "_q", "_m")).applyInArrow(search, ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", d double")

    scored = met(q.where("_gated").drop("_gated"), m, ["gate"])
    rest = q.where("not _gated").drop("_gated", "gate")
    if not rest.isEmpty():
        scored = scored.unionByName(met(rest, m.drop("gate"), []))
    w = Window.partitionBy("q_id").orderBy("d", "m_owner")
    near = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    scale = F.greatest(F.percentile("d", F.lit(0.5)).over(Window.partitionBy("q_id")), F.lit(1e-9))
    near = near.withColumn("w", F.exp(-F.col("d") / scale))
    by_target = Window.partitionBy("q_id").orderBy("m_target", "m_owner").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("cdf", F.sum("w").over(by_target) / F.sum("w").over(Window.partitionBy("q_id")))
    first, second = F.max(F.when(F.col("r") == 1, F.col("d"))), F.max(F.when(F.col("r") == 2, F.col("d")))
    return near.groupBy("q_id").agg(
        F.min(F.when(F.col("cdf") >= 0.5 - 1e-12, F.col("m_target"))).alias("prediction"),
        ((second - first) / F.greatest(F.abs(first), F.lit(1e-9))).alias("gap"),
        F.transform(F.array_sort(F.collect_list(F.struct("r", "m_owner"))), lambda x: x["m_owner"]).alias("neighbours"),
    )


def along_route(points: DataFrame, routes: DataFrame, key: str, lat0: float, km_per_degree: float = 111.32) -> DataFrame:
    """Cross-track distance and remaining way of points along polylines: key, route, cross_km, remaining_km.

    routes: route, seq, lat, lon in order towards the end. A local plane about lat0 serves as the map; the nearest
    segment counts, the first on ties, and the way is never shorter than the straight line.
    """
    p = points.withColumns(dict(zip(("x", "y"), geo.local_km(F.col("lat"), F.col("lon"), lat0, 0.0, km_per_degree), strict=True))).select(key, "x", "y")
    return projected(p.join(F.broadcast(segments(routes, lat0, km_per_degree))), key)


def segments(routes: DataFrame, lat0: float, km_per_degree: float) -> DataFrame:
    """The segments of routes on the plane: route, seq, from (ax, ay) to (bx, by), len, the way after it (rest), the route's end (zx, zy)."""
    w = Window.partitionBy("route").orderBy("seq")
    r = routes.withColumns(dict(zip(("ax", "ay"), geo.local_km(F.col("lat"), F.col("lon"), lat0, 0.0, km_per_degree), strict=True)))
    r = r.withColumns({"bx": F.lead("ax").over(w), "by": F.lead("ay").over(w)}).where("bx is not null")
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    after = Window.partitionBy("route").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("route")
    r = r.withColumn("len", length).withColumns({"rest": F.coalesce(F.sum("len").over(after), F.lit(0.0)), "zx": F.max_by("bx", "seq").over(whole), "zy": F.max_by("by", "seq").over(whole)})
    return r.select("route", "seq", "ax", "ay", "bx", "by", "len", "rest", "zx", "zy")


def projected(j: DataFrame, key: str) -> DataFrame:
    """key, route, cross_km, remaining_km of points (key, x, y) beside segments: the nearest segment of a route counts."""
    t = numeric.clip(F.coalesce(F.try_divide((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay")), F.col("len") ** 2), F.lit(0.0)), 0.0, 1.0)
    j = j.withColumn("t", t)
    cross = F.sqrt((F.col("x") - F.col("ax") - F.col("t") * (F.col("bx") - F.col("ax"))) ** 2 + (F.col("y") - F.col("ay") - F.col("t") * (F.col("by") - F.col("ay"))) ** 2)
    straight = F.sqrt((F.col("x") - F.col("zx")) ** 2 + (F.col("y") - F.col("zy")) ** 2)
    best = j.groupBy(key, "route").agg(F.min(F.struct(cross.alias("cross_km"), "seq", ((1 - F.col("t")) * F.col("len") + F.col("rest")).alias("along"), straight.alias("straight"))).alias("b"))
    return best.select(key, "route", F.col("b.cross_km").alias("cross_km"), F.greatest(F.col("b.straight"), F.col("b.cross_km") + F.col("b.along")).alias("remaining_km"))


#: Tiles that a segment lies in on average at most, and tiles in a row at most; points and segments that one task compares.
COVER, ACROSS, POINT_ROWS, SEGMENT_ROWS = 4, 128, 8_192, 65_536


def nearest_routes(points: DataFrame, routes: DataFrame, key: str, own: str, k: int, lat0: float, km_per_degree: float = 111.32) -> DataFrame:
    """key, route, cross_km, remaining_km and _r (from 1) of the k routes but a point's own that pass nearest, ties to the
    smaller route: the same as ranking all of along_route.

    Segments are dealt to the tiles of the plane that they meet. A point is first compared with the segments of one tile, the
    nearest that has enough routes; then with those of all tiles that lie no farther than the k-th route found there, as no
    other can hold a nearer one. A task puts out k routes for each point, so no pairs are shuffled; points and segments of a
    crowded tile are dealt into blocks. A point without a place has no nearest routes.
    """
    r = written(segments(routes, lat0, km_per_degree).where("len is not null"))
    xy = dict(zip(("x", "y"), geo.local_km(F.col("lat"), F.col("lon"), lat0, 0.0, km_per_degree), strict=True))
    sound = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    p = written(points.withColumns(xy).select(F.col(key).alias("_key"), F.col(own).alias("_own"), "x", "y").where(sound))
    ends = lambda f, c: f(F.least(f"a{c}", f"b{c}") if f is F.min else F.greatest(f"a{c}", f"b{c}"))
    e = r.agg(*(ends(f, c).alias(f"{name}{c}") for c in "xy" for name, f in (("low", F.min), ("high", F.max))), F.avg("len").alias("len")).first()
    size = 1.0 if e["len"] is None else max(e["len"] / COVER, *((e[f"high{c}"] - e[f"low{c}"]) / ACROSS for c in "xy"), 1e-6)
    at = lambda c: F.floor(c / size).cast("int")
    # A little more than what the segment meets, so that rounding loses no tile.
    slack = size * 1e-6
    x0, x1 = (f(F.col("ax"), F.col("bx")) for f in (F.least, F.greatest))
    covered = r.select("route", "seq", "ax", "ay", "bx", "by", F.explode(F.sequence(at(x0 - slack), at(x1 + slack))).alias("_i"))
    t = lambda x: numeric.clip(F.coalesce(F.try_divide(x - F.col("ax"), F.col("bx") - F.col("ax")), F.lit(0.0)), 0.0, 1.0)
    y = lambda x: F.col("ay") + t(x) * (F.col("by") - F.col("ay"))
    upright = F.abs(F.col("bx") - F.col("ax")) <= slack
    ys = [F.when(upright, F.col(c)).otherwise(y(x)) for c, x in (("ay", F.col("_i") * size - slack), ("by", (F.col("_i") + 1) * size + slack))]
    covered = covered.withColumn("_j", F.explode(F.sequence(at(F.least(*ys) - slack), at(F.greatest(*ys) + slack))))
    # As many rows as there are tiles, ACROSS in a row at most.
    tiles = covered.groupBy("_i", "_j").agg(F.count("*").alias("n"), F.approx_count_distinct("route").alias("routes")).toPandas().sort_values(["_i", "_j"], ignore_index=True)
    corners = tiles[["_i", "_j"]].to_numpy(float) * size
    rich = np.flatnonzero(tiles["routes"].to_numpy() > k)
    kind = {name: df.schema[c].dataType.simpleString() for name, df, c in (("key", p, "_key"), ("own", p, "_own"), ("route", r, "route"))}

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                place = np.stack([batch.column(c).to_numpy() for c in ("x", "y")], axis=1)
                low, high = corners[None] - place[:, None], place[:, None] - corners[None] - size
                if "_most" in batch.schema.names:
                    most, home = batch.column("_most").to_numpy(), batch.column("_home").to_numpy(zero_copy_only=False)
                    near = np.sqrt((np.maximum(np.maximum(low, high), 0.0) ** 2).sum(axis=2))
                    i, j = np.nonzero(near <= (most * (1 + 1e-9) + 2 * slack)[:, None])
                    i, j = i[j != home[i]], j[j != home[i]]
                else:
                    far = (np.maximum(np.abs(low), np.abs(high + 2 * size))[:, rich] ** 2).sum(axis=2)
                    i, j = np.arange(len(place)), rich[far.argmin(axis=1)]
                    most = np.full(len(place), np.inf)
                columns = [batch.column(c).take(pa.array(i)) for c in ("_key", "_own", "x", "y")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(most[i]), pa.array(j, pa.int32())], names=["_key", "_own", "x", "y", "_most", "_tile"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        names, q = right.column("route").combine_chunks(), left.column("_own").combine_chunks()
        if len(left) and len(right):
            right = right.sort_by([("route", "ascending"), ("seq", "ascending")])
            names = right.column("route").combine_chunks()
            labels = pc.unique(names)
            which = pc.index_in(names, value_set=labels).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            names, mine = labels, pc.fill_null(pc.index_in(q.cast(labels.type), value_set=labels), -1).to_numpy(zero_copy_only=False)
            ax, ay, bx, by = (right.column(c).to_numpy() for c in ("ax", "ay", "bx", "by"))
            dx, dy = bx - ax, by - ay
            length = np.sqrt(dx**2 + dy**2) ** 2
            length = np.where(length > 0, length, np.inf)
            x, y, most = (left.column(c).to_numpy() for c in ("x", "y", "_most"))
            step = max(1, 500_000 // len(ax))
            for a in range(0, len(x), step):
                px, py = x[a : a + step, None] - ax, y[a : a + step, None] - ay
                along = np.clip((px * dx + py * dy) / length, 0.0, 1.0)
                d = np.minimum.reduceat(np.sqrt((px - along * dx) ** 2 + (py - along * dy) ** 2), starts, axis=1)
                of = mine[a : a + step]
                d[np.flatnonzero(of >= 0), of[of >= 0]] = np.inf
                least = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                i, j = np.nonzero((d <= np.minimum(least, most[a : a + step] * (1 + 1e-9))[:, None]) & np.isfinite(d))
                order = np.lexsort((j, d[i, j], i))
                i, j = i[order], j[order]
                begin = np.searchsorted(i, i)
                keep = np.arange(len(i)) - begin < k
                found.append((i[keep] + a, j[keep], d[i[keep], j[keep]]))
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        of = left.take(pa.array(i))
        return pa.table([of.column("_key"), of.column("_tile"), names.take(pa.array(j)), pa.array(d)], names=["_key", "_tile", "route", "_d"])

    def compared(asked: DataFrame) -> DataFrame:
        # Of few rows, one for each tile.
        sizes = asked.groupBy("_tile").agg(F.count("*").alias("asked"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        of = r.sparkSession.createDataFrame(tiles.assign(_tile=np.arange(len(tiles)))[["_i", "_j", "_tile", "n"]].values.tolist(), "_i int, _j int, _tile int, n bigint")
        blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
        of = written(of.join(F.broadcast(sizes), "_tile").select("_i", "_j", "_tile", blocks("asked", POINT_ROWS).alias("_ps"), blocks("n", SEGMENT_ROWS).alias("_ss")))
        q = asked.join(F.broadcast(of.drop("_i", "_j")), "_tile").withColumn("_p", part("_key", "_ps")).withColumn("_s", every("_ss")).drop("_ps", "_ss")
        s = covered.join(F.broadcast(of), ["_i", "_j"]).withColumn("_s", part("route", "_ss")).withColumn("_p", every("_ps")).drop("_ps", "_ss", "_i", "_j")
        return q.groupBy("_tile", "_p", "_s").cogroup(s.groupBy("_tile", "_p", "_s")).applyInArrow(search, f"_key {kind['key']}, _tile int, route {kind['route']}, _d double")

    asked = f"_key {kind['key']}, _own {kind['own']}, x double, y double, _most double, _tile int"
    p = p.where("_own is not null")
    w = Window.partitionBy("_key").orderBy("_d", "route")
    if len(rich):
        first = compared(p.mapInArrow(met, asked))
        first = written(first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k))
        bound = first.groupBy("_key").agg(F.max("_tile").alias("_home"), F.when(F.count("*") == k, F.max("_d")).alias("_most"))
        p = p.join(bound, "_key", "left")
    else:
        first, p = None, p.withColumns({"_home": F.lit(-1), "_most": F.lit(None).cast("double")})
    p = p.withColumns({"_home": F.when(F.col("_most").isNotNull(), F.col("_home")).otherwise(-1), "_most": F.coalesce("_most", F.lit(float("inf")))})
    near = compared(p.mapInArrow(met, asked))
    near = near if first is None else near.unionByName(first.drop("_r"))
    near = near.groupBy("_key", "route").agg(F.min("_d").alias("_d")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "_d")
    ways = projected(near.join(p.select("_key", "x", "y"), "_key").join(r, "route"), "_key").withColumnRenamed("_key", key)
    return ways.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("cross_km", "route")))


def shortest_paths(queries: DataFrame, edges: DataFrame, cfg: CorridorConfig = CorridorConfig()) -> DataFrame:
    """Least hours from source to target over the edges known at each query's time.

    queries: q_id, asked_at and either cells, source and target, or places, lat, lon, to_lat, to_lon and recent_kn; edges:
    from_cell, to_cell ("i:j", where there are places), seen_at, nm, kn. Out: q_id, hours, path_hours, source_nm,
    target_nm, n_edges, path, reason. Places are snapped to the nearest centre of a cell known at the time, within
    snap_nm; hours are path_hours and what the snaps take, the source's at recent_kn (the median if unknown, within
    min_path_kn and max_recent_kn) and the target's at the median speed of the known edges.

    Each query sees only edges seen before it. Queries of one day meet the edges once, in one group, and add them to one
    graph in the order of time.
    """
    import heapq
    import math
    from bisect import insort

    import numpy as np

    places = "lat" in queries.columns

    def solve(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("seen_at", kind="stable")
        rows = list(zip(known["seen_at"], known["from_cell"], known["to_cell"], known["nm"], known["kn"], strict=True))
        seen: dict[tuple[str, str], tuple[list[float], list[float]]] = {}
        graph: dict[str, dict[str, float]] = {}
        speeds: dict[tuple[str, str], float] = {}
        centres: dict[str, tuple[float, float]] = {}
        at, out = 0, []

        def add(a: str, b: str, nm: float, kn: float) -> None:
            nms, kns = seen.setdefault((a, b), ([], []))
            nms.append(nm)
            insort(kns, kn)
            half = len(kns) // 2
            speeds[a, b] = kns[half] if len(kns) % 2 else (kns[half - 1] + kns[half]) / 2
            graph.setdefault(a, {})[b] = sum(nms) / len(nms) / max(speeds[a, b], cfg.min_path_kn)
            for cell in (a, b):
                if cell not in centres:
                    centres[cell] = tuple((int(x) + 0.5) * cfg.cell_deg for x in cell.split(":")) if places else (0.0, 0.0)

        def snapped(lat: float, lon: float, stretch: float) -> tuple[float, str]:
            return min((60 * math.hypot(lat - y, (lon - x) * stretch), cell) for cell, (y, x) in centres.items())

        def path(source: str, target: str) -> tuple[float, list[str]] | None:
            best, before, heap = {source: 0.0}, {}, [(0.0, source)]
            while heap:
                cost, here = heapq.heappop(heap)
                if here == target:
                    cells = [target]
                    while cells[-1] != source:
                        cells.append(before[cells[-1]])
                    return cost, cells[::-1]
                if cost > best[here]:
                    continue
                for there, step in graph.get(here, {}).items():
                    if cost + step < best.get(there, float("inf")):
                        best[there], before[there] = cost + step, here
                        heapq.heappush(heap, (cost + step, there))
            return None

        for q in asked.sort_values("asked_at", kind="stable").itertuples(index=False):
            while at < len(rows) and rows[at][0] < q.asked_at:
                add(*rows[at][1:])
                at += 1
            source_nm = target_nm = None
            reason, found, snaps = "", None, 0.0
            if not places:
                source, target = q.source, q.target
                reason = "" if source == target else "NO_EDGES" if not at else "SOURCE_UNKNOWN" if source not in centres else "TARGET_UNKNOWN" if target not in centres else ""
            elif not at:
                reason = "NO_EDGES"
            else:
                stretch = math.cos(math.radians(q.lat))
                (source_nm, source), (target_nm, target) = snapped(q.lat, q.lon, stretch), snapped(q.to_lat, q.to_lon, stretch)
                middle = max(float(np.median(list(speeds.values()))), cfg.min_path_kn)
                recent = min(max(middle if pd.isna(q.recent_kn) else q.recent_kn, cfg.min_path_kn), cfg.max_recent_kn)
                snaps = source_nm / recent + target_nm / middle
                reason = "FEW_EDGES" if at < 2 else "SOURCE_OUTSIDE" if source_nm > cfg.snap_nm else "TARGET_OUTSIDE" if target_nm > cfg.snap_nm else ""
            if not reason and (found := path(source, target)) is None:
                reason = "NO_PATH"
            hours, cells = found or (None, [])
            out.append((q.q_id, None if found is None else hours + snaps, hours, source_nm, target_nm, max(len(cells) - 1, 0), cells, reason))
        return pd.DataFrame(out, columns=["q_id", "hours", "path_hours", "source_nm", "target_nm", "n_edges", "path", "reason"])

    first = edges.groupBy("from_cell", "to_cell", F.to_date("seen_at").alias("_day")).agg(F.min("seen_at").alias("seen_at"), F.avg("nm").alias("nm"), F.avg("kn").alias("kn")).drop("_day").dropna()
    asked = queries.withColumn("_day", F.to_date("asked_at"))
    shared = first.join(F.broadcast(asked.select(F.col("_day").alias("_for")).distinct()), F.to_date("seen_at") <= F.col("_for"))
    return asked.groupBy("_day").cogroup(shared.groupBy("_for")).applyInPandas(solve, "q_id bigint, hours double, path_hours double, source_nm double, target_nm double, n_edges int, path array<string>, reason string")


def stop_clusters(points: DataFrame, key: str, eps_m: float, min_points: int, radius: float) -> DataFrame:
    """Density clusters (key, cluster) of places: cluster is the smallest core key in it; noise is left out.

    Neighbours meet through a grid whose cells are as wide as eps, so only adjoining cells are compared. Labels of core
    points spread along core pairs by least label until nothing changes; a border point takes its least core label.
    """
    import math

    size = eps_m / (math.pi * radius / 180)
    x = points.select(F.col(key).alias("k"), "lat", "lon").withColumns({"i": geo.cell(F.col("lat"), size), "j": F.floor(F.col("lon") * 0.5 / size).cast("bigint")})
    spread = x.select(F.col("k").alias("k2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.sequence(F.col("i") - 1, F.col("i") + 1)).alias("i"), "j")
    spread = spread.withColumn("j", F.explode(F.sequence(F.col("j") - 1, F.col("j") + 1)))
    pairs = x.join(spread, ["i", "j"]).where(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), radius) <= eps_m).select("k", "k2").checkpoint()
    core = pairs.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("k")
    links = pairs.join(core, "k").join(core.withColumnRenamed("k", "k2"), "k2").select("k", "k2").checkpoint()
    labels = core.withColumn("label", F.col("k"))
    while True:
        nxt = links.join(labels.withColumnRenamed("k", "k2"), "k2").groupBy("k").agg(F.min("label").alias("label"))
        up = nxt.select(F.col("k").alias("label"), F.col("label").alias("higher"))
        nxt = nxt.join(up, "label", "left").select("k", F.least("label", F.coalesce("higher", "label")).alias("label")).checkpoint()
        if not nxt.join(labels.withColumnRenamed("label", "old"), "k").where("label <> old").limit(1).count():
            break
        labels = nxt
    near = pairs.join(nxt.withColumnRenamed("k", "k2"), "k2").groupBy("k").agg(F.min("label").alias("border"))
    return near.join(nxt, "k", "left").select(F.col("k").alias(key), F.coalesce("label", "border").alias("cluster"))


def mixture(errors: DataFrame, key: str, value: str, k: int = 2, df: float = 3.0, rounds: int = 30) -> pd.DataFrame:
    """A mixture of Student distributions by expectation and maximisation: weight, mean, scale of each component.

    Every round is one aggregation of a few sums; only those come to the driver.
    """
    from math import lgamma, log, pi

    x = errors.select(F.col(value).cast("double").alias("v")).where("v is not null").persist()
    qs = x.agg(F.percentile("v", F.array(*(F.lit((i + 0.5) / k) for i in range(k)))).alias("q"), F.stddev_pop("v").alias("s")).first()
    if qs["q"] is None:
        return pd.DataFrame({"component": [], "weight": [], "mean": [], "scale": []})
    weight, mean, scale = [1 / k] * k, list(qs["q"]), [max(qs["s"] or 0.0, 1e-6)] * k
    const = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(df * pi)
    for _ in range(rounds):
        z = [((F.col("v") - m) / s) for m, s in zip(mean, scale, strict=True)]
        dens = [F.lit(w) * F.exp(F.lit(const - log(s)) - (df + 1) / 2 * F.log1p(q * q / df)) for w, s, q in zip(weight, scale, z, strict=True)]
        whole = F.greatest(sum(dens[1:], dens[0]), F.lit(1e-300))
        sums = []
        for i, (d, q) in enumerate(zip(dens, z, strict=True)):
            r, u = d / whole, (df + 1) / (df + q * q)
            sums += [F.sum(r).alias(f"r{i}"), F.sum(r * u).alias(f"u{i}"), F.sum(r * u * F.col("v")).alias(f"m{i}"), F.sum(r * u * F.col("v") * F.col("v")).alias(f"s{i}")]
        row = x.agg(*sums, F.count("*").alias("n")).first()
        old = list(mean)
        weight = [row[f"r{i}"] / row["n"] for i in range(k)]
        mean = [row[f"m{i}"] / max(row[f"u{i}"], 1e-12) for i in range(k)]
        scale = [max((row[f"s{i}"] - 2 * m * row[f"m{i}"] + m * m * row[f"u{i}"]) / max(row[f"r{i}"], 1e-12), 1e-12) ** 0.5 for i, m in enumerate(mean)]
        if max(abs(a - b) for a, b in zip(old, mean, strict=True)) < 1e-4 * max(scale):
            break
    x.unpersist()
    return pd.DataFrame({"component": range(k), "weight": weight, "mean": mean, "scale": scale})


def memory_snapshots(points: DataFrame, step_hours: int, steps: int, hours: int, least_points: int, least_span_hours: float) -> DataFrame:
    """owner, tick, n, span_h, label_h: what was seen of an owner (owner, id, recorded_at) in the hours up to each of its last
    ticks of a wall-clock grid, with the hours from there to its last row. Ticks with too few rows or too short a span go."""
    last = points.groupBy("owner").agg(F.max("recorded_at").alias("last_at"))
    hour = F.date_trunc("hour", "last_at").cast("timestamp_ntz")
    top = F.timestamp_add("HOUR", -(F.hour(hour) % step_hours), hour)
    ticks = last.withColumn("tick", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.timestamp_add("HOUR", -i * step_hours, top))))
    ticks = ticks.withColumn("since", F.timestamp_add("HOUR", F.lit(-hours), F.col("tick")))
    aggs = [F.count("id").alias("n"), times.hours_between(F.min("recorded_at"), F.max("recorded_at")).alias("span_h")]
    x = joins.in_windows(points, ticks, "owner", "recorded_at", "since", "tick", hours, aggs, ["owner", "tick", "last_at"], closed="right")
    x = x.where((F.col("n") >= least_points) & (F.col("span_h") >= least_span_hours))
    return x.select("owner", "tick", "n", "span_h", times.hours_between(F.col("tick"), F.col("last_at")).alias("label_h"))


def window_sampler(rows: DataFrame, owner: str, at: str, most: int = 8) -> DataFrame:
    """At most `most` evenly spaced rows of each owner as causal end points."""
    w = Window.partitionBy(owner)
    x = rows.withColumns({"_r": F.row_number().over(w.orderBy(at, "id")) - 1, "_n": F.count("*").over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (most - 1)))
    return x.where(F.array_contains(picks, F.col("_r").cast("bigint"))).drop("_r", "_n")

