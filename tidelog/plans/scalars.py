"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.config import EARTH_KM, EARTH_M, EARTH_NM
from tidelog.functions import arrays, geo, hashing, numeric, text, times
from tidelog.operators import contracts, states
from tidelog.plans.registry import query
from tidelog.sources.domain import POSITIONS_SQL, positions
from tidelog.sources.tables import table

CLEAN_SQL = f"""WITH {POSITIONS_SQL}, cl AS (SELECT *, CASE WHEN sog_raw >= 0 AND sog_raw <= 102.2 THEN sog_raw END AS sog_clean,
  CASE WHEN cog_raw >= 0 AND cog_raw < 360 THEN cog_raw END AS cog_clean,
  CASE WHEN heading_raw >= 0 AND heading_raw <= 359 AND heading_raw <> 511 THEN heading_raw END AS heading_clean,
  CASE WHEN nav_raw BETWEEN 0 AND 14 THEN nav_raw END AS nav_clean FROM pos)"""

#: Names of the navigation codes.
NAV_NAMES = {0: "UNDER_WAY_ENGINE", 1: "AT_ANCHOR", 2: "NOT_UNDER_COMMAND", 3: "RESTRICTED_MANOEUVRE", 4: "CONSTRAINED_BY_DRAUGHT", 5: "MOORED", 6: "AGROUND", 7: "FISHING", 8: "UNDER_WAY_SAIL", 9: "RESERVED_HSC", 10: "RESERVED_WIG", 11: "TOWING_ASTERN", 12: "PUSHING_AHEAD", 13: "RESERVED", 14: "AIS_SART"}


@query(CLEAN_SQL + " SELECT id, sog_clean, coalesce(sog_raw = 102.2, false) AS capped, round(cog_clean, 6) AS cog_clean, round(heading_clean, 6) AS heading_clean, nav_clean FROM cl")
def sentinel_clean(spark, sf):
    return states.clean(positions(spark, sf)).select("id", "sog_clean", F.col("sog_capped_high").alias("capped"), F.round("cog_clean", 6).alias("cog_clean"), F.round("heading_clean", 6).alias("heading_clean"), "nav_clean")


_names = " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAV_NAMES.items())


@query(f"WITH {POSITIONS_SQL} SELECT CASE nav_raw {_names} END AS nav_name, count(*) AS n FROM pos GROUP BY 1")
def enum_names(spark, sf):
    return positions(spark, sf).groupBy(numeric.code_name(F.col("nav_raw"), NAV_NAMES).alias("nav_name")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN k >= 255 THEN 25.5 WHEN k > 0 THEN round(k / 10.0, 6) END AS draught, round(least(25.0, greatest(2.0, value)), 6) AS clipped,
  round(least(1.35, greatest(1.0, coalesce(value / nullif(k, 0), 1.0))), 6) AS factor, round(ln(1 + value / 60), 6) AS log_age, round(exp(value / 1000) - 1, 6) AS back,
  try_cast(replace(props, '{', '') AS DOUBLE) AS bad
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) * 3 AS k FROM events)""")
def numeric_transforms(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") * 3
    return table(spark, sf, "events").select(
        "event_id",
        F.round(numeric.draught(k).cast("double"), 6).alias("draught"),
        F.round(numeric.clip(F.col("value"), 2.0, 25.0), 6).alias("clipped"),
        F.round(numeric.bounded_ratio(F.col("value"), k.cast("double"), 1.0, 1.35, 1.0), 6).alias("factor"),
        F.round(F.log1p(F.col("value") / 60), 6).alias("log_age"),
        F.round(F.expm1(F.col("value") / 1000), 6).alias("back"),
        numeric.number(F.regexp_replace("props", r"\{", "")).alias("bad"),
    )


@query("""SELECT p_partkey, round((a + b + c) / 3, 6) AS mean, round(sqrt(((a - (a+b+c)/3)**2 + (b - (a+b+c)/3)**2 + (c - (a+b+c)/3)**2) / 2), 6) AS std,
  round(greatest(a, b, c) - least(a, b, c), 6) AS spread, round(list_sort([a, b, c])[2], 6) AS median,
  CASE least(a, b, c) WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'c' END AS best
  FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice / 40 AS b, CAST(p_partkey % 37 AS DOUBLE) AS c FROM part)""")
def row_statistics(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 40).alias("b"), (F.col("p_partkey") % 37).cast("double").alias("c"))
    xs = [F.col(c) for c in "abc"]
    return x.select(
        "p_partkey",
        F.round(numeric.row_mean(*xs), 6).alias("mean"),
        F.round(numeric.row_std(*xs), 6).alias("std"),
        F.round(numeric.row_spread(*xs), 6).alias("spread"),
        F.round(numeric.row_median(*xs), 6).alias("median"),
        numeric.argmin(xs, ["a", "b", "c"]).alias("best"),
    )


@query("""SELECT band, movement, count(*) AS n FROM (SELECT CASE WHEN h < -24 THEN 'PAST' WHEN h < -1 THEN 'OVERDUE' WHEN h < 0 THEN 'DUE' WHEN h < 168 THEN 'WEEK' WHEN h < 336 THEN 'FORTNIGHT'
  WHEN h < 720 THEN 'MONTH' ELSE 'FAR' END AS band, CASE WHEN v <= 0.5 THEN 'STOPPED' WHEN v <= 5 THEN 'SLOW' ELSE 'MOVING' END AS movement
  FROM (SELECT value * 4 - 30 AS h, value AS v FROM events)) GROUP BY 1, 2""")
def status_bands(spark, sf):
    h = F.col("value") * 4 - 30
    band = numeric.bands(h, [-24, -1, 0, 168, 336, 720], ["PAST", "OVERDUE", "DUE", "WEEK", "FORTNIGHT", "MONTH", "FAR"])
    return table(spark, sf, "events").groupBy(band.alias("band"), numeric.movement(F.col("value")).alias("movement")).agg(F.count("*").alias("n"))


_NAME = "concat(' ', replace(p_name, ' ', '  '), CASE WHEN p_size % 3 = 0 THEN ' >  ' || p_brand || '> ' ELSE '' END)"


@query(rf"""SELECT p_partkey, light, key, compact, nullif(trim(list_filter(string_split(light, '>'), lambda x: trim(x) <> '')[-1]), '') AS terminal, contains(light, '>') AS route,
  regexp_full_match(compact, '[A-Z]{{2}}\s?[A-Z0-9]{{3}}') AS code FROM (SELECT p_partkey, regexp_replace(upper(trim(s)), '\s+', ' ', 'g') AS light,
  coalesce(nullif(trim(regexp_replace(upper(s), '[^A-Z0-9>]+', ' ', 'g')), ''), 'UNKNOWN') AS key, regexp_replace(upper(s), '[^A-Z0-9]', '', 'g') AS compact FROM (SELECT p_partkey, {_NAME} AS s, p_size FROM part))""")
def text_normalise(spark, sf):
    s = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" >  "), F.col("p_brand"), F.lit("> "))).otherwise(""))
    x = table(spark, sf, "part").select("p_partkey", s.alias("s"))
    light, compact = text.light(F.col("s")), text.compact(F.col("s"))
    return x.select("p_partkey", light.alias("light"), text.key(F.col("s")).alias("key"), compact.alias("compact"), text.terminal(light).alias("terminal"), text.is_route(light).alias("route"), text.code_like(compact).alias("code"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(translate(upper(replace(text, 'ß', 'ss')), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'AAAAAACEEEEIIIINOOOOOUUUUY'), '\s*(?:→|=+>|-+>|>)\s*', '>', 'g'), '[,_;|]+', ' ', 'g'), '\s+', ' ', 'g'))) AS folded FROM documents""")
def text_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.folded_ascii(F.col("text"))).alias("folded"))


@query("SELECT concat_ws(chr(31), c_mktsegment, coalesce(n_name, 'UNKNOWN')) AS composite, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3 GROUP BY 1")
def composite_keys(spark, sf):
    nation = table(spark, sf, "nation").where("n_regionkey < 3")
    x = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return x.groupBy(text.composite(F.col("c_mktsegment"), F.col("n_name")).alias("composite")).agg(F.count("*").alias("n"))


_ETA = "strftime(ts + INTERVAL (event_id % 400) DAY, '%m/%d %H:%M')"
_YEARS = "list_filter([try_strptime((year(ts) + d)::VARCHAR || '/' || eta, '%Y/%m/%d %H:%M') FOR d IN [-1, 0, 1]], lambda x: x IS NOT NULL)"


@query(f"""SELECT event_id, eta, nearest, round(margin, 6) AS margin FROM (SELECT event_id, eta, c[1].t AS nearest, CASE WHEN len(c) > 1 THEN c[2].off - c[1].off END AS margin
  FROM (SELECT event_id, eta, list_sort([{{'off': abs(date_diff('microsecond', ts, x)) / 8.64e10, 'year': year(x), 't': x}} FOR x IN {_YEARS}]) AS c FROM (SELECT event_id, ts, {_ETA} AS eta FROM events)))""")
def nearest_year(spark, sf):
    x = table(spark, sf, "events").withColumn("eta", F.date_format(F.timestamp_add("DAY", (F.col("event_id") % 400).cast("int"), F.col("ts")), "MM/dd HH:mm"))
    return x.select("event_id", "eta", times.yearless(F.col("eta"), F.col("ts")).alias("nearest"), F.round(times.yearless_margin(F.col("eta"), F.col("ts")), 6).alias("margin"))


@query("""SELECT owner, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, a + INTERVAL '5:59:59.999999' HOUR TO SECOND), z - INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)) AS tick
  FROM (SELECT user_id AS owner, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1)""".replace("INTERVAL '5:59:59.999999' HOUR TO SECOND", "INTERVAL 21599999999 MICROSECOND"))
def decision_grid(spark, sf):
    x = table(spark, sf, "events").groupBy(F.col("user_id").alias("owner")).agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return x.select("owner", F.explode(times.grid(F.col("a"), F.col("z"), 360)).alias("tick"))


@query("""SELECT event_id, date_add(ts, to_microseconds(CAST(floor(d / 2) AS BIGINT))) AS middle, round(d / 3.6e9, 6) AS hours, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN rtrim(strftime(ts, '%f'), '0') = '' THEN '' ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || 'Z' AS iso
  FROM (SELECT event_id, ts, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) WHERE d IS NOT NULL""")
def elapsed_times(spark, sf):
    from pyspark.sql import Window

    x = table(spark, sf, "events").withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next is not null")
    return x.select("event_id", times.midpoint(F.col("ts"), F.col("next")).alias("middle"), F.round(times.hours_between(F.col("ts"), F.col("next")), 6).alias("hours"), times.canonical(F.col("ts")).alias("iso"))


@query("""SELECT weekday, bin, count(*) AS n, round(sum(s), 4) AS hour_sin, round(sum(c), 4) AS hour_cos FROM (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) // 6 AS INTEGER) AS bin,
  sin(2 * pi() * hour(ts) / 24) AS s, cos(2 * pi() * hour(ts) / 24) AS c FROM events) GROUP BY 1, 2""")
def cyclic_time(spark, sf):
    c = times.cyclic(F.col("ts"))
    x = table(spark, sf, "events").select(c["weekday"].alias("weekday"), times.hour_bin(F.col("ts")).alias("bin"), c["hour_sin"].alias("s"), c["hour_cos"].alias("c"))
    return x.groupBy("weekday", "bin").agg(F.count("*").alias("n"), (F.round(F.sum("s"), 4) + 0.0).alias("hour_sin"), (F.round(F.sum("c"), 4) + 0.0).alias("hour_cos"))


def _hav(r: float, a: str, b: str, c: str, d: str) -> str:
    root = f"sqrt(sin(radians({c} - {a}) / 2)**2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2)**2)"
    return f"2 * {r} * asin(CASE WHEN {root} > 1 THEN 1.0 ELSE {root} END)"


def _bearing(a: str, b: str, c: str, d: str) -> str:
    return f"((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360.0) % 360.0)"


@query(f"""WITH {POSITIONS_SQL} SELECT id, round({_hav(EARTH_M, "lat", "lon", "37.5", "15.1")}, 4) AS m, round({_hav(EARTH_KM, "lat", "lon", "37.5", "15.1")}, 6) AS km, round({_hav(EARTH_NM, "lat", "lon", "37.5", "15.1")}, 6) AS nm,
  round({_bearing("lat", "lon", "37.5", "15.1")}, 6) AS course, round(abs((({_bearing("lat", "lon", "37.5", "15.1")} - cog_raw + 540.0) % 360.0) - 180.0), 6) AS turn FROM pos""")
def haversine_bearing(spark, sf):
    x, lat, lon, to = positions(spark, sf), F.col("lat"), F.col("lon"), (F.lit(37.5), F.lit(15.1))
    course = geo.bearing(lat, lon, *to)
    return x.select("id", *(F.round(geo.haversine(lat, lon, *to, r), d).alias(n) for r, d, n in ((EARTH_M, 4, "m"), (EARTH_KM, 6, "km"), (EARTH_NM, 6, "nm"))), F.round(course, 6).alias("course"), F.round(geo.turn(course, F.col("cog_raw")), 6).alias("turn"))


_BOX = [(14.8, 36.8), (15.3, 36.7), (15.2, 37.2), (14.9, 37.1)]


def _ray() -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(_BOX, [*_BOX[1:], _BOX[0]], strict=True):
        out.append(f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < {x1} + (lat - {y1}) * {(x2 - x1) / (y2 - y1)!r} THEN 1 ELSE 0 END")
    return " + ".join(out)


@query(f"""WITH {POSITIONS_SQL} SELECT inside, box, s > 0 AS north, cell_lat, cell_lon, sector, count(*) AS n, round(sum(east), 3) AS east FROM (SELECT ({_ray()}) % 2 = 1 AS inside,
  lon BETWEEN 14.7 AND 15.2 AND lat BETWEEN 36.9 AND 37.3 AS box, ((15.2517 - 14.753) * (lat - 37.0013) - (37.1009 - 37.0013) * (lon - 14.753)) AS s, CAST(floor(lat / 0.2) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.2) AS BIGINT) AS cell_lon,
  CASE WHEN cog_raw < 60 THEN 'NNE' WHEN cog_raw < 120 THEN 'E' WHEN cog_raw < 200 THEN 'SSE' ELSE 'OTHER' END AS sector, (lon - 15.0) * 111.32 * cos(radians(37.0)) AS east FROM pos) GROUP BY ALL""")
def places(spark, sf):
    x, lon, lat = positions(spark, sf), F.col("lon"), F.col("lat")
    east, _ = geo.local_km(lat, lon, 37.0, 15.0)
    keys = [
        geo.inside_polygon(lon, lat, _BOX).alias("inside"),
        geo.in_box(lon, lat, 14.7, 36.9, 15.2, 37.3).alias("box"),
        (geo.side((14.753, 37.0013), (15.2517, 37.1009), (15.0, 38.0), lon, lat) > 0).alias("north"),
        geo.cell(lat, 0.2).alias("cell_lat"),
        geo.cell(lon, 0.2).alias("cell_lon"),
        geo.sector(F.col("cog_raw")).alias("sector"),
    ]
    return x.select(*keys, east.alias("_e")).groupBy("inside", "box", "north", "cell_lat", "cell_lon", "sector").agg(F.count("*").alias("n"), F.round(F.sum("_e"), 3).alias("east"))


@query("SELECT c_custkey, b, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'calibration' ELSE 'final' END AS part FROM (SELECT c_custkey, CAST(('0x' || substr(sha256('v1:' || c_custkey), 1, 8)) AS BIGINT) % 100 AS b FROM customer)")
def hash_split(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hashing.bucket("v1", F.col("c_custkey")).alias("b"), hashing.split("v1", F.col("c_custkey")).alias("part"))


@query("SELECT c_custkey AS owner, CAST((row_number() OVER (ORDER BY sha256('folds|' || c_custkey), c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer")
def hash_folds(spark, sf):
    return hashing.balanced_folds(table(spark, sf, "customer").select(F.col("c_custkey").alias("owner")), "owner", "folds", 5)


@query("SELECT event_id, sha256(user_id || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS sample_key FROM events")
def sample_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", hashing.digest(F.col("user_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("sample_key"))


@query("""SELECT a.vec_id, round(greatest(0.0, least(2.0, 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))), 5) AS distance
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) b""")
def cosine_to_one(spark, sf):
    x = table(spark, sf, "embeddings")
    one = x.where("vec_id = 0").select(F.col("embedding").alias("other"))
    return x.crossJoin(F.broadcast(one)).select("vec_id", F.round(arrays.cosine_distance(F.col("embedding"), F.col("other")), 5).alias("distance"))


@query("""SELECT i, n, round(mean, 6) AS mean, round(CASE WHEN std < 1e-6 THEN 1 ELSE std END, 6) AS std FROM (SELECT i, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std
  FROM (SELECT unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1)""")
def feature_scaling(spark, sf):
    x = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    std = F.stddev_pop(F.col("v").cast("double"))
    return x.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.when(std < 1e-6, 1.0).otherwise(std), 6).alias("std"))


@query("SELECT alias, count(DISTINCT p_partkey) AS codes FROM (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ';') || ';' || p_brand, ';')) AS alias FROM part) WHERE alias <> '' GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def alias_collisions(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", F.explode(F.split(F.concat_ws(";", F.replace("p_name", F.lit(" "), F.lit(";")), F.col("p_brand")), ";")).alias("alias"))
    return x.where("alias <> ''").groupBy("alias").agg(F.countDistinct("p_partkey").alias("codes")).where("codes > 1")


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN k BETWEEN 0 AND 99 THEN 1 ELSE 0 END)::BIGINT AS valid, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1")
def json_contract(spark, sf):
    x = table(spark, sf, "events").withColumn("x", F.from_json("props", "k int"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("x.k").between(0, 99).cast("bigint")).alias("valid"), F.max("x.k").alias("most"))


@query("""SELECT 'duplicate key' AS violation, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
  UNION ALL SELECT 'l_quantity missing', count(*) FROM lineitem WHERE l_quantity IS NULL UNION ALL SELECT 'l_discount out of range', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.05""")
def ledger_contract(spark, sf):
    return contracts.violations(table(spark, sf, "lineitem"), key=["l_orderkey", "l_linenumber"], present=["l_quantity"], ranges={"l_discount": (0, 0.05)})
