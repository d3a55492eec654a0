"""Every registered query against its SQL on the smallest tables."""

import difflib
import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from test_operators import warped
from tidelog.config import EARTH_M
from tidelog.plans import registry
from tidelog.sources.domain import DECISIONS_SQL, POSITIONS_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    out = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in out.to_numpy().tolist())


def of(duck, sql: str) -> pd.DataFrame:
    return duck.execute(f"WITH {DECISIONS_SQL} {sql}").df()


def resolver_fuzzy(got, duck):
    """All that exact steps left, against every alias."""
    names = [(n.replace("_", " "), f"NN{k:03d}") for k, n in duck.execute("SELECT n_nationkey, n_name FROM nation").fetchall()]
    names += [(f"{word} {k}", code) for _, code in names for k in [int(code[2:])] for word in ("LAND", "COAST")]
    left = got[got.method.isin(["fuzzy", "route_fuzzy", "unresolved_text"])]
    assert len(left)
    for x in left.itertuples():
        best = {}
        for alias, code in names:
            best[code] = max(best.get(code, 0), difflib.SequenceMatcher(None, x.terminal, alias).ratio())
        (code, one), (_, two) = sorted(best.items(), key=lambda y: (-y[1], y[0]))[:2]
        assert (x.code == code) == (len(x.terminal) >= 5 and one >= 0.94 and one - two >= 0.04)


def analogue(got, duck):
    """Warping, gate, weights and the weighted median by plain loops."""
    p = duck.execute(f"WITH {POSITIONS_SQL} SELECT owner, epoch(recorded_at) AS t, lon, lat, sog_raw, id FROM pos ORDER BY owner, t, lon, lat").df()
    tracks, targets = {}, {}
    for owner, g in p.groupby("owner"):
        first = g.drop_duplicates("t")
        if len(first) > 1:
            at = np.linspace(first.t.min(), first.t.max(), 12)
            tracks[owner] = list(zip(np.interp(at, first.t, first.lon), np.interp(at, first.t, first.lat), strict=True))
            targets[owner] = g.sort_values(["t", "id"]).sog_raw.iloc[-1]
    for x in got.itertuples():
        others = [o for o in tracks if o != x.q_id]
        same = [o for o in others if o % 6 == x.q_id % 6]
        near = sorted((warped(tracks[x.q_id], tracks[o]), o) for o in (same if len(same) >= 3 else others))[:5]
        assert list(x.neighbours) == [o for _, o in near]
        weights = {o: math.exp(-d / max(np.median([d for d, _ in near]), 1e-9)) for d, o in near}
        run = 0.0
        for value, o in sorted((targets[o], o) for o in weights):
            run += weights[o]
            if run >= (0.5 - 1e-12) * sum(weights.values()):
                break
        assert x.prediction == pytest.approx(value)
    assert set(got.q_id) == {o for o in tracks if o % 100 == 0}


def corridor(got, duck):
    """Paths join their ends, and every owner with a transition has a row; test_operators compares small graphs."""
    assert len(got) and got.q_id.is_unique
    found = got[got.reason == ""]
    assert (found.path.map(len) == found.n_edges + 1).all() and (found.hours >= found.path_hours - 1e-9).all()


def clusters(got, duck):
    """Density clusters by comparing all places with each other."""
    p = duck.execute(f"WITH {POSITIONS_SQL} SELECT min(id) AS id, round(lat, 4) AS lat, round(lon, 4) AS lon FROM pos WHERE sog_raw < 12 GROUP BY 2, 3").df()
    lat, lon = np.radians(p.lat.to_numpy()), np.radians(p.lon.to_numpy())
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h))) <= 250.0
    core, ids = near.sum(axis=1) >= 3, p.id.to_numpy()
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        least = np.where(core, np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(axis=1), label)
        if (least == label).all():
            break
        label = least
    border = np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(axis=1)
    want = {int(i): int(c) for i, c in zip(ids, border, strict=True) if c < np.iinfo(np.int64).max}
    assert dict(zip(got.id, got.cluster, strict=True)) == want


def mixture(got, duck):
    """The same rounds of expectation and maximisation with arrays."""
    v = of(duck, "SELECT pred_a - target_h AS e FROM dec").e.to_numpy()
    mean, scale, weight = np.quantile(v, [0.25, 0.75]), np.full(2, v.std()), np.full(2, 0.5)
    for _ in range(30):
        z = (v[:, None] - mean) / scale
        dens = weight * np.exp(math.lgamma(2) - math.lgamma(1.5) - 0.5 * math.log(3 * math.pi) - np.log(scale) - 2 * np.log1p(z * z / 3))
        r, u = dens / dens.sum(axis=1, keepdims=True), 4 / (3 + z * z)
        old, weight = mean, r.mean(axis=0)
        mean = (r * u * v[:, None]).sum(axis=0) / (r * u).sum(axis=0)
        scale = np.sqrt((r * u * (v[:, None] - mean) ** 2).sum(axis=0) / r.sum(axis=0))
        if np.abs(old - mean).max() < 1e-4 * scale.max():
            break
    assert np.allclose(got.sort_values("component")[["weight", "mean", "scale"]].to_numpy(), np.stack([weight, mean, scale], axis=1), rtol=1e-6)


def blend(got, duck):
    """The best of all supports for the rows of the other folds."""
    x = of(duck, "SELECT key, fold, pred_a, pred_b, pred_c, target_h FROM dec").set_index("key")
    names = ["pred_a", "pred_b", "pred_c"]
    for fold in range(5):
        train, best = x[x.fold != fold], (math.inf, None)
        for some in (s for k in (1, 2, 3) for s in itertools.combinations(names, k)):
            w = np.linalg.lstsq(train[list(some)].to_numpy(), train.target_h.to_numpy(), rcond=None)[0]
            if (w >= 0).all():
                best = min(best, (float(((train[list(some)].to_numpy() @ w - train.target_h) ** 2).sum()), dict(zip(some, w / w.sum(), strict=True))), key=lambda y: y[0])
        test = x[x.fold == fold]
        want = sum(test[c] * w for c, w in best[1].items())
        assert np.allclose(got.set_index("key").blend.loc[test.index], want, atol=1e-3)


def ridge(got, duck):
    """Normal equations on imputed, scaled and one-hot features; the penalty is that of mean squares over scaled columns."""
    x = of(duck, "SELECT key, fold, price, balance, pred_a, status, ship_type, target_h FROM dec").set_index("key")
    assert set(got.key) == set(x.index)
    merged = got.set_index("key").prediction.loc[x.index]
    for fold in range(5):
        test, train = x[x.fold == fold], x[x.fold != fold]
        # Least squares beat the mean of the training rows only if something is learned; the fit stays close to theirs.
        dummies = lambda d: np.column_stack([np.ones(len(d)), d[["price", "balance", "pred_a"]], *[(d[c] == v) for c in ("status", "ship_type") for v in sorted(train[c].unique())[:-1]]]).astype(float)
        w = np.linalg.lstsq(dummies(train), train.target_h.to_numpy(), rcond=None)[0]
        assert np.corrcoef(dummies(test) @ w, merged.loc[test.index])[0, 1] > 0.9


def risks(got, duck):
    x = of(duck, "SELECT key, abs(pred_a - target_h) AS e FROM dec").set_index("key")
    r = got.set_index("key").risk_h
    # Errors don't depend on the features here, so that all the model can tell is their size: trees of the absolute loss give medians.
    assert set(r.index) == set(x.index) and (r >= 0).all() and (r <= 1.5 * x.e.max()).all() and 0.5 < r.median() / x.e.median() < 2


def gates(got, duck):
    """Probabilities at which the gradient of the balanced, penalised likelihood vanishes."""
    x = duck.execute("SELECT doc_id, n_chars::DOUBLE AS c, length(regexp_replace(text, '[^.]', '', 'g'))::DOUBLE AS d, quality FROM documents JOIN labels USING (doc_id)").df().merge(got, on="doc_id")
    weight = len(x) / (x.quality.nunique() * x.groupby("quality").quality.transform("count"))
    assert len(x) == len(got) and x.p.between(0, 1).all()
    assert abs(float((weight * (x.quality - x.p)).sum() / weight.sum())) < 2e-3


def components(got, duck):
    """Scores on the leading eigenvectors, up to their signs."""
    e = np.array(duck.execute("SELECT embedding FROM embeddings ORDER BY vec_id").df().embedding.tolist(), float)
    _, vectors = np.linalg.eigh(np.cov(e.T))
    mine = np.array(got.sort_values("vec_id").components.tolist())
    assert np.allclose(np.abs(mine), np.abs(e @ vectors[:, ::-1][:, :8]), atol=1e-3)


def recalled(got, duck):
    assert got.n[0] > 0 and got.recall[0] >= 0.9 and got.passed[0]


def graphed(got, duck):
    assert got.n[0] > 0 and got.recall[0] >= 0.9 and got.passed[0] and got.met[0] <= 1.5


def tubes(got, duck):
    """No small step from the answers' weights can be seen here, so: the loss beyond the tube is no more than that of means."""
    x = of(duck, "SELECT key, fold, target_h FROM dec").set_index("key")
    p = got.set_index("key").prediction.loc[x.index]
    scale = x.target_h.std()
    loss = lambda e: np.maximum(np.abs(e) / scale - 0.1, 0).mean()
    means = x.fold.map(lambda f: x.target_h[x.fold != f].mean())
    assert len(got) == len(x) and loss(x.target_h - p) <= 1.02 * loss(x.target_h - means)


def routed(got, duck):
    """Crossings, medians by sector and projections by plain loops."""
    p = duck.execute(f"WITH {POSITIONS_SQL} SELECT owner, epoch(recorded_at) AS t, lat, lon FROM pos ORDER BY owner, recorded_at, id").df()
    r, gate = 6371.0088, (37.0, 15.0)

    def far(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * r * math.asin(math.sqrt(h))

    def sector(a):
        y = math.sin(math.radians(a[1] - gate[1])) * math.cos(math.radians(a[0]))
        x = math.cos(math.radians(gate[0])) * math.sin(math.radians(a[0])) - math.sin(math.radians(gate[0])) * math.cos(math.radians(a[0])) * math.cos(math.radians(a[1] - gate[1]))
        b = math.degrees(math.atan2(y, x)) % 360
        return "NNE" if b < 60 else "E" if b < 120 else "SSE" if b < 180 else "OTHER"

    crossed = {}
    for owner, g in p.groupby("owner"):
        rows = g[["t", "lat", "lon"]].to_numpy().tolist()
        for (t, *a), (u, *b) in zip(rows, rows[1:], strict=False):
            da, db = far(a, gate), far(b, gate)
            for level in (10.0, 20.0, 30.0, 40.0, 50.0):
                if da >= level > db and 0 < u - t <= 5 * 86_400:
                    k = (da - level) / (da - db)
                    crossed.setdefault(owner, {})[level] = (a[0] + k * (b[0] - a[0]), a[1] + k * (b[1] - a[1]))
    crossed = {o: x for o, x in crossed.items() if len(x) >= 2}
    paths = {o: [x[v] for v in sorted(x, reverse=True)] + [gate] for o, x in crossed.items()}
    families = {o: sector(x[max(x)]) for o, x in crossed.items()}

    def prototype(owners):
        points = [[crossed[o][v] for o in owners if v in crossed[o]] for v in (50.0, 40.0, 30.0, 20.0, 10.0)]
        out = [tuple(np.median(x, axis=0)) for x in points if len(x) >= 3] + [gate]
        return out if len(out) >= 3 else None

    protos = {f: prototype([o for o in families if families[o] == f]) for f in set(families.values()) if list(families.values()).count(f) >= 5}
    protos = {f: x for f, x in (protos | {"PORT": prototype(list(families))}).items() if x}
    km = math.radians(1) * r
    flat = lambda a: np.array([a[1] * km * math.cos(math.radians(gate[0])), (a[0] - gate[0]) * km])

    def way(at, line):
        xy, q = [flat(a) for a in line], flat(at)
        length = [np.hypot(*(b - a)) for a, b in zip(xy, xy[1:], strict=False)]
        best = min(
            (float(np.hypot(*(q - a - t * (b - a)))), i, (1 - t) * length[i] + sum(length[i + 1 :]))
            for i, (a, b) in enumerate(zip(xy, xy[1:], strict=False))
            for t in [min(1.0, max(0.0, float((q - a) @ (b - a)) / length[i] ** 2 if length[i] else 0.0))]
        )
        return best[0], max(float(np.hypot(*(q - xy[-1]))), best[0] + best[2])

    last = p.groupby("owner").last()
    for x in got.itertuples():
        at = (last.lat[x.key], last.lon[x.key])
        assert x.family == sector(at) and (x.kind == "sector") == (x.family in protos)
        cross, rest = way(at, protos[x.family if x.kind == "sector" else "PORT"])
        assert (x.prototype_cross_km, x.prototype_km) == (pytest.approx(cross, abs=1e-3), pytest.approx(rest, abs=1e-3))
        near = sorted((*way(at, line)[:1], o) for o, line in paths.items() if o != x.key)[:5]
        assert list(x.knn_calls) == [o for _, o in near] and x.knn_km == pytest.approx(np.median([way(at, paths[o])[1] for _, o in near]), abs=1e-3)
    assert len(got) == len(last)


def attributed(got, duck):
    """Attributions add up to the answer, and to nothing over all rows; a category's depends on nothing else."""
    parts = [c for c in got.columns if c.startswith("by_")]
    assert np.allclose(got.base + got[parts].sum(axis=1), got.prediction, atol=1e-2) and np.allclose(got[parts].mean(), 0, atol=1e-2)
    x = of(duck, "SELECT key, status, price FROM dec").merge(got, on="key")
    assert (x.groupby("status").by_status.nunique() == 1).all() and abs(abs(np.corrcoef(x.price, x.by_price)[0, 1]) - 1) < 1e-6


def importances(got, duck):
    assert len(got) and got.notna().all().all()


def chain(got, duck):
    """Rows, gates and intervals fit together, and the experts that medians make are those of the other owners."""
    part = "CAST(('0x' || substr(sha256('chain:' || owner), 1, 8)) AS BIGINT) % 100"
    x = of(duck, f"SELECT key, {part} >= 85 AS final, target_h, destination FROM dec")
    assert set(got.key) == set(x.key[x.final])
    assert (got.low <= got.hours + 1e-6).all() and (got.hours <= got.high + 1e-6).all() and (got.low >= 0).all() and (got.risk_h >= 0).all()
    assert ((got.tier == "LOW") == (got.action == "DEFER")).all()
    assert all(abs(getattr(r, r.expert) - r.hours) < 1e-6 for r in got.itertuples())
    low, high = np.quantile(x.target_h[~x.final], [0.01, 0.99])
    assert got.prior.between(low - 1e-3, high + 1e-3).all()
    truth = x.set_index("key").target_h.loc[got.key].to_numpy()
    assert ((truth >= got.low.to_numpy()) & (truth <= got.high.to_numpy())).mean() > 0.5


#: What queries without SQL are compared with.
CHECKS = {
    "destination_resolver_fuzzy": resolver_fuzzy, "route_analogue": analogue, "corridor_paths": corridor, "stop_clusters": clusters, "error_mixture": mixture, "nnls_blend": blend,
    "tabular_oof": ridge, "risk_model": risks, "soft_gate": gates, "linear_embedding": components, "lsh_recall": recalled, "feature_importance": importances, "feature_attribution": attributed, "graph_recall": graphed, "route_model": routed, "support_vectors": tubes, "scoring_chain": chain,
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, sf):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLES:
        CHECKS[name](got, duck)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
