"""Nulls, ties, causality and contracts of single operators."""

import datetime as dt
import difflib
import functools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.config import StateConfig
from tidelog.functions import arrays, numeric, text, times
from tidelog.operators import aggregates, contracts, evaluation, experts, folds, joins, sessions, states
from tidelog.sources import tables

T0 = dt.datetime(2024, 1, 1)
RAW = "id bigint, owner bigint, recorded_at timestamp_ntz, sog_raw double, cog_raw double, heading_raw double, nav_raw int, lat double, lon double, event_type string"


def track(spark, rows):
    return spark.createDataFrame([(i, 1, T0 + dt.timedelta(seconds=s), sog, cog, 90.0, nav, lat, lon, "x") for i, (s, sog, cog, nav, lat, lon) in enumerate(rows)], RAW)


def test_sentinels_and_cap(spark):
    x = states.clean(track(spark, [(0, 102.3, 360.0, 15, 91.0, 181.0), (60, 102.2, 359.9, 0, 37.0, 15.0), (120, None, -1.0, 1, None, None)])).orderBy("id").collect()
    assert [r.sog_clean for r in x] == [None, 102.2, None]
    assert [r.sog_capped_high for r in x] == [False, True, False]
    assert [r.position_valid for r in x] == [False, True, False]
    assert [r.nav_clean for r in x] == [None, 0, 1]


def test_states_are_causal(spark):
    r = random.Random(3)
    rows = [(60 * i + r.randrange(30), r.choice([0.1, 2.0, 9.0, None]), r.uniform(0, 360), r.choice([0, 1, 5]), 37 + r.random() / 100, 15 + r.random() / 100) for i in range(40)]
    whole = states.states(track(spark, rows)).orderBy("id").toPandas()
    part = states.states(track(spark, rows[:25])).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(whole.iloc[:25].reset_index(drop=True), part)


def test_moored_is_not_stale_and_gap_ends_stop(spark):
    rows = [(0, 0.0, 10.0, 5, 37.0, 15.0), (60, 0.0, 10.0, 5, 37.0, 15.0), (1000, 0.0, 10.0, 5, 37.0, 15.0), (1060, 0.0, 10.0, 5, 37.0, 15.0)]
    x = states.states(track(spark, rows), StateConfig()).orderBy("id").collect()
    assert {r.stale_risk for r in x} == {"LOW"}
    assert [r.stopped_s for r in x] == [0.0, 0.0, 0.0, 60.0]
    assert x[2].events == "STOP_START;OBS_GAP"


def test_empty_log(spark):
    assert states.states(track(spark, [(0, 1.0, 1.0, 1, 37.0, 15.0)]).limit(0)).count() == 0


def test_pairing_against_a_state_machine(spark):
    r = random.Random(5)
    rows, want = [], []
    for owner in range(60):
        state, session = False, 0
        for i in range(r.randrange(9)):
            kind = r.choice(["signup", "purchase", "view"])
            rows.append((owner * 100 + i, owner, T0 + dt.timedelta(hours=i), kind))
            if kind == "signup" and not state:
                state, session = True, session + 1
                want.append([owner, session, i, None])
            elif kind == "purchase" and state:
                state = False
                want[-1][3] = i
    got = sessions.pair_sessions(spark.createDataFrame(rows, "id bigint, owner bigint, recorded_at timestamp_ntz, event_type string")).toPandas()
    hour = lambda t: None if pd.isna(t) else (t - T0).total_seconds() / 3600
    assert sorted([a, b, hour(c), hour(d)] for a, b, c, d in got[["owner", "session", "inbound_at", "outbound_at"]].itertuples(index=False)) == sorted(want)


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(hours=1)), (2, T0)], "owner bigint, at timestamp_ntz")
    right = spark.createDataFrame([(1, T0, 1, "a"), (1, T0, 2, None)], "owner bigint, seen timestamp_ntz, id bigint, v string")
    x = joins.asof(left, right, "owner", "at", "seen", ["id", "v"], "id").collect()
    assert sorted((r.owner, r.id) for r in x if r.id) == [(1, 2), (1, 2)]
    strict = joins.asof(left, right, "owner", "at", "seen", ["id"], "id", strict=True).collect()
    assert sum(r.id is not None for r in strict) == 1


def test_clip_keeps_missing_and_argmin_takes_first(spark):
    x = spark.range(1).select(numeric.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("a"), numeric.argmin([F.lit(1.0), F.lit(1.0)], ["p", "q"]).alias("b"), numeric.row_std(F.lit(1.0), F.lit(3.0), F.lit(None).cast("double")).alias("c")).first()
    assert x.a is None and x.b == "p" and x.c == pytest.approx(2**0.5)


def test_normalisers(spark):
    x = spark.createDataFrame([("  a  b ",), ("@@@",), ("",), (None,), ("Crème → Brûlée",)], "s string")
    got = x.select(text.light(F.col("s")).alias("l"), text.key(F.col("s")).alias("k"), text.folded(F.col("s")).alias("f"), text.folded_ascii(F.col("s")).alias("g")).collect()
    assert [r.l for r in got][:4] == ["A B", None, None, None]
    assert [r.k for r in got][1:4] == ["UNKNOWN"] * 3
    assert got[4].f == got[4].g == "CREME>BRULEE"


def test_leap_day(spark):
    x = spark.createDataFrame([("02/29 10:00", dt.datetime(2023, 3, 1)), ("bad", T0), ("12/31 23:00", T0)], "e string, t timestamp_ntz").select(times.yearless(F.col("e"), F.col("t")).alias("y")).collect()
    assert [r.y for r in x] == [dt.datetime(2024, 2, 29, 10), None, dt.datetime(2023, 12, 31, 23)]


def warped(a, b, band=2):
    """The cheapest way through the grid of pairs of points, by recursion over its last step."""
    reach = max(band, abs(len(a) - len(b)))

    @functools.cache
    def cheapest(i, j):
        if i < 0 or j < 0 or abs(i - j) > reach:
            return 0.0 if i == j == -1 else math.inf
        return math.dist(a[i], b[j]) + min(cheapest(i - 1, j), cheapest(i, j - 1), cheapest(i - 1, j - 1))

    return cheapest(len(a) - 1, len(b) - 1) / (len(a) + len(b))


def test_dtw_in_batches(spark):
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=(r.integers(0, 5), 2)).tolist(), r.normal(size=(r.integers(1, 5), 2)).tolist()) for k in range(40)]
    as_points = lambda v: [{"x": a, "y": b} for a, b in v]
    df = spark.createDataFrame([(k, as_points(a), as_points(b)) for k, a, b in rows], "k int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    got = {x.k: x.d for x in df.select("k", arrays.dtw_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    for k, a, b in rows:
        assert got[k] is None if not a else got[k] == pytest.approx(warped(a, b))


def test_trajectories(spark):
    r = random.Random(8)
    rows = [(o, T0 + dt.timedelta(seconds=r.randrange(500)), r.random(), r.random()) for o in range(5) for _ in range(o * 3 + 1)]
    got = {x.owner: x.points for x in experts.trajectories(spark.createDataFrame(rows, "owner bigint, at timestamp_ntz, lon double, lat double"), "owner", "at", ["lon", "lat"], 7).collect()}
    assert set(got) == {1, 2, 3, 4}
    for o, pts in got.items():
        mine = sorted((a, x, y) for k, a, x, y in rows if k == o)
        # Of equal times the first in order counts.
        first = {(a - T0).total_seconds(): (x, y) for a, x, y in reversed(mine)}
        at = sorted(first)
        even = [at[0] + (at[-1] - at[0]) * k / 6 for k in range(7)]
        for axis, name in enumerate("xy"):
            assert [p[name] for p in pts] == pytest.approx(np.interp(even, at, [first[k][axis] for k in at]).tolist())


def test_nnls_and_conformal(spark):
    g = np.array([[2.0, 0.0], [0.0, 2.0]])
    assert evaluation.nnls(g, np.array([1.0, -1.0])).tolist() == [1.0, 0.0]
    rows = spark.createDataFrame([(0, float(v)) for v in range(1, 10)], "f int, s double")
    assert evaluation.conformal(rows, "s", ["f"], 0.8).first().width == 8.0


def test_priors_ignore_their_own_targets(spark):
    rows = [(i, i % 2, "d%d" % (i % 2), "t", float(i)) for i in range(20)]
    schema = "key bigint, fold bigint, destination string, destination_type string, y double"
    one = experts.hierarchical_prior(spark.createDataFrame(rows, schema), "y").where("fold = 0").orderBy("key").toPandas()
    other = experts.hierarchical_prior(spark.createDataFrame([(a, b, c, d, y + 1000 * (b == 0)) for a, b, c, d, y in rows], schema), "y").where("fold = 0").orderBy("key").toPandas()
    assert one.prediction.tolist() == other.prediction.tolist()


CATALOG = [
    ("ITAUG", "Augusta", "Italy", 37.2, 15.2, "AUGUSTA ITALY"),
    ("ITCTA", "Catania", "Italy", 37.5, 15.1, "CATANIA SICILY;CATANIA ITALY"),
    ("ITMLZ", "Milazzo", "Italy", 38.2, 15.2, ""),
    ("GIGIB", "Gibraltar", "Gibraltar", 36.1, -5.4, "GBGIB;GIBRALTAR"),
    ("PLGDN", "Gdansk", "Poland", 54.4, 18.7, None),
    ("ITSAL", "Salerno", "Italy", None, None, ""),
]


def resolved(spark, texts, catalog=CATALOG):
    places = spark.createDataFrame(catalog, "code string, name string, country string, lat double, lon double, aliases string")
    return {x.text: x for x in experts.resolve(spark.createDataFrame([(t,) for t in texts], "text string"), places).collect()}


def test_resolver(spark):
    texts = ["ITAUG", "IT AUG", "Augusta", "CATANIA SICILY", "ITSAL>ITCTA", "Messina => MILAZZO", "GBGIB", "MALTA", "FOR ORDER", "BALTIC SEA FOR ORDERS", "UNKNOWN", "n/a", None, "", "In Port", "ITMNP", "CATANIA SICIL", "Gdańsk", "GİBRALTAR", "ITSAL", "nowhere at all", "> >"]
    got = resolved(spark, texts)
    assert {got[t].canonical for t in ("ITAUG", "IT AUG", "Augusta")} == {"ITAUG"} and all(got[t].is_resolved for t in ("ITAUG", "IT AUG", "Augusta"))
    assert (got["Augusta"].lat, got["Augusta"].lon, got["Augusta"].country, got["Augusta"].name) == (37.2, 15.2, "Italy", "Augusta")
    assert got["CATANIA SICILY"].canonical == "ITCTA" and got["CATANIA SICILY"].method == "alias"
    route = got["ITSAL>ITCTA"]
    assert (route.canonical, route.method, route.is_route, route.confidence) == ("ITCTA", "route_exact_code", True, 1.0)
    assert got["Messina => MILAZZO"].canonical == "ITMLZ" and got["Messina => MILAZZO"].is_route
    assert (got["GBGIB"].canonical, got["GBGIB"].method) == ("GIGIB", "alias")
    assert (got["MALTA"].canonical, got["MALTA"].code, got["MALTA"].is_resolved, got["MALTA"].method) == ("AMBIGUOUS:MALTA", None, False, "ambiguous_geography")
    assert {got[t].canonical for t in ("FOR ORDER", "BALTIC SEA FOR ORDERS")} == {"FOR_ORDERS"}
    assert {got[t].canonical for t in ("UNKNOWN", "n/a", None, "")} == {"UNKNOWN"} and got["In Port"].canonical == "NON_SPECIFIC"
    unlisted = got["ITMNP"]
    assert (unlisted.canonical, unlisted.method, unlisted.is_resolved, unlisted.country, unlisted.confidence) == ("ITMNP", "code_like_unverified", False, "IT", 0.7)
    fuzzy = got["CATANIA SICIL"]
    assert (fuzzy.canonical, fuzzy.method) == ("ITCTA", "fuzzy") and fuzzy.confidence == pytest.approx(difflib.SequenceMatcher(None, "CATANIA SICIL", "CATANIA SICILY").ratio())
    assert got["Gdańsk"].canonical == "PLGDN" and got["GİBRALTAR"].canonical == "GIGIB"
    assert got["ITSAL"].is_resolved and got["ITSAL"].lat is None
    assert (got["nowhere at all"].canonical, got["nowhere at all"].confidence) == ("TEXT:NOWHERE AT ALL", 0.0)


@pytest.mark.parametrize("row, what", [(("ITAUG", "Other", "Italy", 1.0, 1.0, ""), "code of two rows"), (("ITXXX", "Augusta", "Italy", 1.0, 1.0, ""), "alias of two codes")])
def test_resolver_rejects_bad_catalogues(spark, row, what):
    with pytest.raises(Exception, match=what):
        resolved(spark, ["Augusta", "ITAUG"], [*CATALOG, row])


def test_similar_names_meet_all_that_a_product_would(spark):
    r = random.Random(9)
    names = ["".join(r.choice("ABCDEFGH ") for _ in range(r.randint(5, 24))).strip() for _ in range(60)]
    # Names in the form of a code don't count.
    names = sorted({x for n in names if len(x := " ".join(n.split())) >= 5 and not re.fullmatch(r"[A-Z]{2}\s?[A-Z0-9]{3}", x)})
    texts = []
    for _ in range(400):
        t = list(r.choice(names))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(t))
            t[k : k + r.randint(0, 1)] = r.choice(["", "X", "A", "QQ"])
        texts.append("".join(t))
    aliases = spark.createDataFrame([(n, f"C{k % 40}") for k, n in enumerate(names)], "_alias string, _code string")
    got = {x.terminal: (x._fuzzy, x._score) for x in experts.closest(spark.createDataFrame([(t,) for t in texts], "terminal string"), aliases).collect()}
    want = {}
    for t in set(texts):
        scores = {}
        for k, n in enumerate(names):
            scores[f"C{k % 40}"] = max(scores.get(f"C{k % 40}", 0), difflib.SequenceMatcher(None, t, n).ratio())
        (code, best), (_, second) = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
        if len(t) >= 5 and best >= 0.94 and best - second >= 0.04:
            want[t] = (code, pytest.approx(best))
    assert got == want and len(want) > 50


def test_shortest_path_is_causal(spark):
    edges = spark.createDataFrame([("a", "b", T0, 10.0, 10.0), ("b", "c", T0, 10.0, 10.0), ("a", "c", T0 + dt.timedelta(days=2), 1.0, 10.0)], "from_cell string, to_cell string, seen_at timestamp_ntz, nm double, kn double")
    q = spark.createDataFrame([(1, "a", "c", T0 + dt.timedelta(days=1)), (2, "a", "c", T0 + dt.timedelta(days=3)), (3, "c", "a", T0 + dt.timedelta(days=3)), (4, "a", "c", T0)], "q_id bigint, source string, target string, asked_at timestamp_ntz")
    got = {r.q_id: (r.hours, r.reason, r.path) for r in experts.shortest_paths(q, edges).collect()}
    assert got[1][0] == pytest.approx(2.0) and got[1][2] == ["a", "b", "c"]
    assert got[2][0] == pytest.approx(0.1)
    assert got[3][1] == "NO_PATH" and got[4][1] == "NO_EDGES"


def test_snapped_paths(spark):
    hours = lambda n: T0 + dt.timedelta(hours=n)
    edges = spark.createDataFrame([("0:0", "0:1", hours(1), 10.0, 10.0), ("0:1", "0:2", hours(2), 10.0, 5.0), ("0:2", "0:3", hours(2), 10.0, 1.0), ("0:0", "0:3", hours(30), 10.0, 20.0)], "from_cell string, to_cell string, seen_at timestamp_ntz, nm double, kn double")
    at = lambda cell, north=0.0: (0.1 + north / 60, 0.2 * cell + 0.1)
    asked = [(1, hours(5), *at(0, 3), *at(3, 12), 6.0), (2, hours(5), *at(0), *at(3), None), (3, hours(40), *at(0), *at(3), None), (4, hours(1), *at(0), *at(1), None), (5, hours(2), *at(0), *at(1), None), (6, hours(5), *at(0, 60), *at(1), None), (7, hours(5), *at(0), *at(1, 60), None), (8, hours(5), *at(3), *at(0), None), (9, hours(5), *at(0, 3), *at(0, 3), 99.0)]
    q = spark.createDataFrame(asked, "q_id bigint, asked_at timestamp_ntz, lat double, lon double, to_lat double, to_lon double, recent_kn double")
    got = {r.q_id: r for r in experts.shortest_paths(q, edges).collect()}
    assert [got[k].reason for k in range(1, 10)] == ["", "", "", "NO_EDGES", "FEW_EDGES", "SOURCE_OUTSIDE", "TARGET_OUTSIDE", "NO_PATH", ""]
    # Speeds below 2 knots count as 2; the median speed of the edges 10, 5 and 1 is 5.
    assert got[1].path_hours == got[2].hours == pytest.approx(1 + 2 + 5) and got[1].path == ["0:0", "0:1", "0:2", "0:3"]
    assert (got[1].source_nm, got[1].target_nm) == (pytest.approx(3), pytest.approx(12)) and got[1].hours == pytest.approx(8 + 3 / 6 + 12 / 5)
    assert got[3].hours == pytest.approx(0.5) and got[9].hours == pytest.approx(3 / 25 + 3 / 5) and got[9].n_edges == 0
    assert got[6].hours is None and got[6].path == []


def test_every_owner_has_a_path(spark, sf):
    from tidelog.plans import registry, temporal

    owners = {r.owner for r in temporal.transition_rows(spark, sf).select("owner").distinct().collect()}
    assert len(owners) > 1 and {r.q_id for r in registry.QUERIES["corridor_paths"](spark, sf).collect()} == owners


def test_contracts(spark):
    with pytest.raises(contracts.ContractError):
        contracts.forbid_leakage(["speed", "target_tte_h"])
    assert contracts.forbid_leakage(["speed"]) == ["speed"]
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="unique"):
        contracts.validated_join(a, b, ["k"]).collect()
    seen = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(hours=2)), (2, T0)], "owner bigint, at timestamp_ntz")
    cut = lambda hours: spark.createDataFrame([(1, T0 + dt.timedelta(hours=hours))], "owner bigint, cut timestamp_ntz")
    assert contracts.causal(seen, cut(2), "owner", "at", "cut").where("at is not null").count() == 2
    with pytest.raises(Exception, match="after the cut-off of 1"):
        contracts.causal(seen, cut(1), "owner", "at", "cut").collect()


def test_modes_quantiles_concentration(spark):
    x = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "g int, v string")
    assert [tuple(r) for r in aggregates.mode_smallest(x, ["g"], "v").collect()] == [(1, "a", 1)]
    w = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 1.0), (0, 9.0, 0.0), (0, 3.0, 2.0)], "g int, v double, w double").withColumn("t", F.col("v"))
    assert aggregates.weighted_quantiles(w, ["g"], "v", "w", {"q50": 0.5}).first().q50 == 2.0


def test_greedy_folds(spark):
    x = spark.createDataFrame([(i, n) for i, n in enumerate([9, 7, 5, 5, 3, 1])], "owner bigint, n bigint")
    loads = folds.greedy_balanced(x, "owner", "n", 2).groupBy("fold").agg(F.sum("n").alias("s")).collect()
    assert sorted(r.s for r in loads) == [15, 15]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", "2024-01-01 00:00:00", "5.5"), ("x", "2024-01-01 00:00:00", "1"), ("2", None, "1")], "`M-M-S-I` string, Time string, draft string")
    got = tables.standard_static(df).collect()
    assert len(got) == 1 and got[0].draught == 5.5 and got[0].eta_available is False
    tables.write_once(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exists"):
        tables.write_once(df, str(tmp_path / "t"))
    assert tables.manifest(df, str(tmp_path / "m"))["rows"] == 3
    assert tables.digests(spark, str(tmp_path / "m" / "part-*")).count() >= 1
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.csv", "a,b\n1,2\n")
    assert [r.line for r in tables.zipped_lines(spark, str(tmp_path / "a.zip"), "in.csv").collect()] == ["a,b", "1,2"]
    assert [tuple(r) for r in tables.zipped_csv(spark, str(tmp_path / "a.zip"), "in.csv", "a int, b double").collect()] == [(1, 2.0)]
    r = random.Random(3)
    rows = [(str(r.randrange(8) * 60_000), f"2024-01-01 00:00:{r.randrange(60):02d}", "1.0", str(k)) for k in range(200)]
    got = tables.standard_positions(spark.createDataFrame(rows, "mmsi string, time string, lat string, lon string")).collect()
    assert [x.id for x in sorted(got, key=lambda x: (x.owner, x.recorded_at, x.lat, x.lon))] == list(range(1, 201))
    with pytest.raises(ValueError):
        tables.read(spark, "x", "pickle")


def test_first_accepted_and_spread(spark):
    x = spark.createDataFrame([(f"{i:02d}", i % 3 == 0) for i in range(12)], "h string, ok boolean")
    kept, why = aggregates.first_accepted(x, "h", F.col("ok"), F.lit("no"), 3)
    assert [r.h for r in kept.orderBy("h").collect()] == ["00", "03", "06"] and why.first().n == 4


def test_bundle_and_geometries(spark, tmp_path):
    from pyspark.ml import Pipeline

    from tidelog.sources import bundle

    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"gate"},"geometry":{"type":"LineString","coordinates":[[15.0,37.0],[15.1,37.2]]}},{"type":"Feature","properties":{"name":"basin"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    got = {r.name: [(c.lon, c.lat) for c in r.corners] for r in bundle.geometries(spark, str(tmp_path / "g.geojson")).collect()}
    assert got["gate"] == [(15.0, 37.0), (15.1, 37.2)] and len(got["basin"]) == 4
    (tmp_path / "m.json").write_text('{"A": 1.5, "B": 2}')
    assert {r.key: r.value for r in bundle.medians(spark, str(tmp_path / "m.json")).collect()} == {"A": 1.5, "B": 2.0}
    rows = spark.createDataFrame([(float(i), float(2 * i)) for i in range(10)], "x double, y double")
    fitted = Pipeline(stages=[*evaluation.preprocessing(["x"], []), evaluation.models("y")["ridge"]]).fit(rows)
    bundle.save(str(tmp_path / "b"), {"rows": rows}, {"ridge": fitted}, {"alpha": 1})
    t, m, c = bundle.load(spark, str(tmp_path / "b"))
    assert t["rows"].count() == 10 and c == {"alpha": 1} and m["ridge"].transform(rows).count() == 10
    stress = {r.masked: r.mae for r in evaluation.masking_stress(rows, fitted, {"x": 4.5}, "y").collect()}
    assert stress["x"] > 1


@pytest.mark.parametrize("coarse, small", [(16, 512), (2, 4)])
def test_quantiles_of_all_folds_but_one(spark, monkeypatch, coarse, small):
    from tidelog.operators import quantiles

    monkeypatch.setattr(quantiles, "COARSE", coarse)
    monkeypatch.setattr(quantiles, "SMALL", small)
    r = np.random.default_rng(5)
    n = 1500
    values = np.where(r.random(n) < 0.3, 7.0, np.exp(r.normal(0, 6, n)))
    rows = pd.DataFrame({"g": [None if x == 3 else int(x) for x in r.choice([0, 0, 0, 1, 2, 3], n)], "fold": r.integers(0, 4, n), "v": values, "w": r.random(n)})
    rows.loc[::17, "v"] = None
    df = spark.createDataFrame([(None if pd.isna(a) else int(a), int(b), None if pd.isna(c) else float(c), float(d)) for a, b, c, d in rows.itertuples(index=False)], "g int, fold int, v double, w double").repartition(3)
    x = rows[rows.v.notna()]
    key = lambda g: -1 if pd.isna(g) else int(g)
    got = {(key(t.g), t._f): (t.n, list(t.q)) for t in quantiles.quantiles(df, ["g"], "v", [0.0, 0.35, 0.5, 1.0], "fold").collect()}
    want = {}
    for g in (-1, 0, 1, 2):
        for f in range(4):
            part = x[(x.g.map(key) == g) & (x.fold != f)].v.to_numpy()
            want[g, f] = (len(part), np.quantile(part, [0.0, 0.35, 0.5, 1.0]).tolist())
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    whole = quantiles.statistics(df, [], "v", lambda n: F.array(F.lit(1).cast("bigint"), F.ceil(n * 0.7).cast("bigint"), n)).collect()
    ordered = np.sort(x.v.to_numpy())
    assert {t.place: t.v for t in whole} == {k: ordered[k - 1] for k in (1, int(np.ceil(len(x) * 0.7)), len(x))}
    for t in aggregates.weighted_quantiles(df, ["g"], "v", "w", {"a": 0.2, "b": 0.5}).collect():
        part = x[x.g.map(key) == key(t.g)].sort_values("v")
        cdf = part.w.cumsum() / part.w.sum()
        assert (t.a, t.b) == tuple(part.v[cdf >= q - 1e-12].min() for q in (0.2, 0.5))
    for t in aggregates.spearman(df, ["g"], "v", "w").collect():
        part = x[x.g.map(key) == key(t.g)]
        assert t.n == len(part) and t.rho == pytest.approx(part.v.rank().corr(part.w.rank()))


def test_streaming_equals_batch(spark, tmp_path):
    from tidelog.streaming import states as streaming

    r = random.Random(6)
    rows = [(60 * i + r.randrange(30), r.choice([0.1, 2.0, 9.0, None]), 10.0, 0, 37 + r.random() / 100, 15 + r.random() / 100) for i in range(30)]
    log = track(spark, rows)
    for k, part in enumerate((log.where("id < 11"), log.where("id between 11 and 20"), log.where("id > 20"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    paths = str(tmp_path / "p*")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(paths).withColumnRenamed("sog_raw", "sog")
    got = {x.id: (x.motion_state, x.stopped_s) for x in streaming.run_once(streaming.motion(stream)).collect()}
    want = {x.id: (x.motion_state, x.stopped_s) for x in states.states(log).collect()}
    assert got == want


def test_graph_search():
    from tidelog.operators.retrieval import Graph

    r = np.random.default_rng(3)
    v = r.normal(size=(1500, 8))
    graph = Graph(v)
    built, hits = graph.evaluated, 0
    for q in r.normal(size=(40, 8)):
        want = set(np.argsort(((v - q) ** 2).sum(axis=1))[:10].tolist())
        found = graph.search(q, 10)
        assert found == sorted(found)
        hits += len(want & {x for _, x in found})
    assert hits >= 0.95 * 400 and (graph.evaluated - built) / 40 < 900
    assert len(Graph(v[:1]).search(v[0], 5)) == 1


def test_support_vectors_follow_a_curve(spark):
    r = np.random.default_rng(4)
    x = r.uniform(-2, 2, 300)
    y = np.sin(2 * x) + np.where(r.random(300) < 0.1, 30.0, 0.0)
    rows = spark.createDataFrame([(k, k % 3, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(300, 0, None, 1.0)], "key int, fold int, x double, y double")
    got = {t.key: t.prediction for t in evaluation.support_vectors(rows, ["x"], "y", "fold", [0, 1, 2], cost=500.0, tube=0.01, gamma=2.0).collect()}
    assert len(got) == 301
    # One row in ten lies far off; the loss is that of distances, so the curve stays where most are.
    assert np.median([abs(got[k] - np.sin(2 * a)) for k, a in enumerate(x)]) < 0.3


def shuffled_rows(spark, run):
    """Rows that the stages of a run wrote for shuffles."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in (s.apply(k) for s in [sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())] for k in range(s.size()))}
    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_snap_repeats_cells_not_points(spark):
    r = random.Random(3)
    rows = [(k, 37 + r.uniform(-0.5, 0.5), 15 + r.uniform(-0.5, 0.5)) for k in range(3000)] + [(3000, None, 15.0), (3001, 50.0, 15.0)]
    cells = [(i, j) for i in range(181, 189) for j in range(72, 79) if r.random() < 0.3]
    points = spark.createDataFrame(rows, "id int, lat double, lon double")
    nodes = spark.createDataFrame([(f"{i}:{j}", i, j, (i + 0.5) * 0.2, (j + 0.5) * 0.2) for i, j in cells], "node string, node_i bigint, node_j bigint, node_lat double, node_lon double")
    got = []
    assert shuffled_rows(spark, lambda: got.extend(joins.snap(points, nodes, 0.2, 20.0, 3440.065, "id").collect())) < 12_000

    def far(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 3440.065 * math.asin(math.sqrt(h))

    want = {k: min((far(a, b, (i + 0.5) * 0.2, (j + 0.5) * 0.2), f"{i}:{j}") for i, j in cells) for k, a, b in rows if a}
    want = {k: v for k, v in want.items() if v[0] <= 20}
    assert {x.id: x.node for x in got} == {k: v[1] for k, v in want.items()} and all(abs(x.snap_nm - want[x.id][0]) < 1e-9 for x in got)


def test_support_vectors_fit_all_folds_in_the_same_passes(spark):
    r = np.random.default_rng(8)
    rows = spark.createDataFrame([(k, k % 6, float(a), float(b)) for k, (a, b) in enumerate(r.normal(size=(240, 2)))] + [(240, None, 1.0, 1.0), (241, 1, 1.0, None)], "key int, fold int, x double, y double")
    jobs = []
    for folds in ([0], [0, 1, 2, 3, 4, 5]):
        spark.sparkContext.setJobGroup(f"folds{len(folds)}", "")
        got = evaluation.support_vectors(rows, ["x"], "y", "fold", folds, rounds=3).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{len(folds)}")))
        assert len(got) == (40 if len(folds) == 1 else 241)
    assert jobs[1] <= jobs[0] + 2


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_nearest_routes_are_those_of_all_routes(spark, spread):
    from pyspark.sql import Window

    r = random.Random(6)
    lines = [(c, s, 37 + (5 - s) * r.uniform(-0.1, 0.1), 15 + (5 - s) * r.uniform(-0.1, 0.1)) for c in range(60) for s in range(1, 6)]
    lines += [(c + 100, s, lat, lon) for c, s, lat, lon in lines[:50]] + [(200, 1, 37.2, 15.0), (200, 2, 36.8, 15.0)]
    places = [(k, k % 70, 37 + r.uniform(-spread, spread), 15 + r.uniform(-spread, spread)) for k in range(120)] + [(120, 1, 45.0, 3.0), (121, 1, 37.0, 15.0), (122, 1, None, 3.0)]
    points, routes = spark.createDataFrame(places, "key int, call int, lat double, lon double"), spark.createDataFrame(lines, "route int, seq int, lat double, lon double")
    every = experts.along_route(points, routes, "key", 37.0).join(points.select("key", "call"), "key").where("route <> call and cross_km is not null")
    want = every.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("cross_km", "route"))).where("_r <= 5").select("key", "route", "cross_km", "remaining_km", "_r").collect()
    got = experts.nearest_routes(points, routes, "key", "call", 5, 37.0).select("key", "route", "cross_km", "remaining_km", "_r").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 5 * 122


def test_recall_shuffles_no_pairs(spark, monkeypatch):
    """Neighbours are those of plain distances, with copies and ties, and what is shuffled grows with rows, not with pairs."""
    from tidelog.operators import retrieval

    monkeypatch.setattr(retrieval, "MEMORY_ROWS", 500)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 60)
    monkeypatch.setattr(retrieval, "TILE", (16, 64))
    g = np.random.default_rng(2)
    v = g.normal(size=(1200, 12))
    v[100:160] = v[100]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(1200, None)], "m_id bigint, m_v array<double>")
    asked = rows.where("m_id % 10 = 0").selectExpr("m_id as q_id", "m_v as q_v")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {i: sorted((round(float(((u[i] - u[j]) ** 2).sum()), 9), j) for j in range(1200) if j != i)[:5] for i in range(0, 1200, 10)}
    for find in (lambda: retrieval.exact(asked, rows, 5), lambda: retrieval.approximate(asked, rows, 5, 3.0)):
        got, near = [], {}
        assert shuffled_rows(spark, lambda find=find, got=got: got.extend(find().collect())) < 12_000
        for x in sorted(got, key=lambda x: (x.q_id, x.rank)):
            near.setdefault(x.q_id, []).append(x.m_id)
        assert all(len(x) == 5 for x in near.values())
        hits = sum(len(set(near[i]) & {j for _, j in want[i]}) for i in want)
        assert hits >= 0.95 * 600
    exact = {x.q_id: [] for x in asked.collect()}
    for x in sorted(retrieval.exact(asked, rows, 5).collect(), key=lambda x: (x.q_id, x.rank)):
        exact[x.q_id].append(x.m_id)
    assert {i: x for i, x in exact.items() if i < 1200} == {i: [j for _, j in x] for i, x in want.items()}


def test_nearest_routes_shuffle_no_pairs(spark):
    """Points near the end that all routes share meet them inside tasks: k routes a point are shuffled, not all that it meets."""
    r = random.Random(8)
    lines = [(c, s, 37 + (4 - s) * r.uniform(-0.02, 0.02), 15 + (4 - s) * r.uniform(-0.02, 0.02)) for c in range(500) for s in range(1, 5)]
    points = spark.createDataFrame([(k, k % 500, 37 + r.uniform(-0.02, 0.02), 15 + r.uniform(-0.02, 0.02)) for k in range(600)], "key int, call int, lat double, lon double")
    routes = spark.createDataFrame(lines, "route int, seq int, lat double, lon double")
    got = []
    rows = shuffled_rows(spark, lambda: got.extend(experts.nearest_routes(points, routes, "key", "call", 5, 37.0).collect()))
    assert len(got) == 5 * 600 and rows < 100_000


def test_recall_asks_for_every_row(spark, sf):
    from tidelog.plans import retrieval
    from tidelog.sources.tables import table

    rows = table(spark, sf, "embeddings").count()
    assert rows > 100 and retrieval.lsh_recall(spark, sf).first().n == 10 * rows


def test_analogues_shuffle_no_pairs(spark, monkeypatch):
    """Neighbours by warped distance are those of all pairs, ties to the smaller owner, and only they leave a task."""
    from tidelog.functions import arrays

    monkeypatch.setattr(experts, "QUERIES", 70, raising=False)
    monkeypatch.setattr(experts, "MEMORIES", 90, raising=False)
    g = np.random.default_rng(4)
    tracks = {i: g.uniform(-0.5, 0.5, (12, 2)) + [15, 37] for i in range(400)}
    tracks[7] = tracks[8] = tracks[9]
    gates = {i: "few" if i in (3, 4) else None if i == 5 else "ab"[i % 2] for i in tracks}
    rows = spark.createDataFrame([(i, gates[i], [tuple(p) for p in x.tolist()], float(i)) for i, x in tracks.items()], "m_owner bigint, m_gate string, m_points array<struct<x: double, y: double>>, m_target double")
    asked = rows.selectExpr("m_owner as q_id", "m_owner as q_owner", "m_gate as q_gate", "m_points as q_points")
    found, got = experts.analogues(asked, rows, "m_gate", 5), []
    # No pair with both its tracks is handed to a function.
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert shuffled_rows(spark, lambda: got.extend(found.collect())) < 25_000
    assert len(got) == 400
    for x in got:
        others = [j for j in tracks if j != x.q_id and (gates[x.q_id] not in ("a", "b") or gates[j] == gates[x.q_id])]
        d = arrays.dtw_many(np.repeat(tracks[x.q_id][None], len(others), axis=0), np.stack([tracks[j] for j in others]))
        assert x.neighbours == [j for _, j in sorted(zip(d.tolist(), others, strict=True))[:5]]
