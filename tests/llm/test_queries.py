"""The registered queries of the corpus operators with their own parameters, and the pipeline on awkward tables."""

import collections
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tidelog.llm import decontam, langid, minhash, queries, secrets  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered(name, spark, sf):
    got = queries.queries()[name](spark, sf).toPandas()
    if name not in queries.ORACLES:
        table = "embeddings" if name.startswith("op1_") else "documents"
        key = "vec_id" if table == "embeddings" else "doc_id"
        ids = {x[0] for x in duckdb.sql(f"SELECT {key} FROM '{sf}/{table}.parquet'").fetchall()}
        asked = {x for x in ids if x % 100 == 0}
        assert set(got["query_id" if table == "embeddings" else "doc_id"]) == (asked if table == "embeddings" else ids)
        return
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(map(str, got[order].to_numpy().tolist())) == sorted(map(str, want[order].to_numpy().tolist()))


def test_nearest_of_the_query(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    v = {i: np.array(x, np.float32).astype(float) for i, x in rows}
    got = collections.defaultdict(list)
    for x in queries.op1_multiprobe(spark, sf).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    hits = total = 0
    for q, found in got.items():
        want = sorted((float(np.sqrt(((x - v[q]) ** 2).sum())), i) for i, x in v.items() if i != q)[:10]
        hits, total = hits + len({i for i, _ in found} & {i for _, i in want}), total + len(want)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
    assert hits >= 0.9 * total


def test_languages_of_held_out_rows(spark, sf):
    got = queries.op2_language_id(spark, sf).where("held_out")
    truth = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    x = got.join(truth, "doc_id").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert x.n > 10 and x.right >= 0.95


def test_repeated_rows_are_predicted_alike(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    got = langid.identify(docs.union(docs), docs, keep=["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("lang_pred", F.round("score", 3)).alias("k")).collect()
    assert all((x.n, x.k) == (2, 1) for x in got) and len(got) == 30


@pytest.mark.parametrize("search", [lambda df: decontam.decontaminate(df, df.sparkSession.createDataFrame([(1, "w5 " * 12)], "item_id bigint, text string")), secrets.scan_secrets])
def test_texts_of_a_megabyte(spark, search):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(2000)}" for _ in range(180_000)), "w5 " * 350_000, "a" * 1_000_000, "password=" * 110_000, "%41" * 330_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    at = time.perf_counter()
    assert len(search(df).collect()) == len(texts) and time.perf_counter() - at < 120


def test_links_found_of_all(spark):
    """Of all pairs at or above the threshold, near it most of all, with the query's parameters."""
    r = random.Random(31)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for family in range(120):
        base = [r.choice(words) for _ in range(120)]
        for k in range(6):
            x = list(base)
            for at in r.sample(range(120), r.choice([0, 1, 2, 3, 3, 4, 4, 5])):
                x[at] = r.choice(words)
            texts.append((family * 10 + k, " ".join(x)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in texts for w in [t.split()]}
    near = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b < a // 10 * 10 + 10 and 100 * len(x & y) >= 75 * len(x | y)]
    close = sum(100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) for a, b in near)
    signed = {x.doc_id: set(x.bands) for x in minhash.signatures(df, 5, 48, 5, 12).collect()}
    assert len(near) > 300 and close > 50 and all(signed[a] & signed[b] for a, b in near)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()}
    assert all(got[a] == got[b] for a, b in near)


def documents(spark, tmp_path, rows, bench=()):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep bigint, like string, label bigint, _row string, marks binary"
    spark.createDataFrame([(d, t, lang, "s", None if t is None else len(t), 1, "x", 2, "y", b"z") for d, t, lang in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(bench), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def stages(spark, at):
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        kept[name] = docs.collect()
    return kept


def test_pipeline_on_an_empty_table(spark, tmp_path):
    at = documents(spark, tmp_path, [])
    assert all(not rows for rows in stages(spark, at).values()) and corpus_pipeline.run(spark, at).count() == 0


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_with_repeats_nulls_and_clashing_columns(spark, tmp_path, labelled):
    r = random.Random(41)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, prose(60), "en") for k in range(40)]
    passage = prose(12)
    rows += [(100, rows[3][1], "en"), (101, prose(20) + " " + passage + " " + prose(9), "en"), (102, prose(30) + " password=hunter2hunter2", "en"), (103, None, "en"), (104, "", None), (105, "123 456", "en"), (None, prose(40), None)]
    rows += [rows[5], rows[5], rows[-1]]
    rows = [(d, t, lang if labelled else None) for d, t, lang in rows]
    kept = stages(spark, documents(spark, tmp_path, rows, [(1, passage.upper()), (2, None)]))
    count = lambda name: collections.Counter(x.doc_id for x in kept[name])
    lettered = collections.Counter(d for d, t, _ in rows if any(map(str.isalpha, t or "")))
    assert count("language identification") == lettered
    assert count("near-duplicate removal") == lettered - collections.Counter({100: 1})
    assert count("benchmark decontamination") == lettered - collections.Counter({100: 1, 101: 1})
    clean = {x.doc_id: x.text for x in kept["secret redaction"]}
    assert clean[102].endswith(" [SECRET]") and all(clean[d] == t for d, t, _ in rows if d in range(40))
    pieces = collections.Counter()
    for x in kept["packing"]:
        pieces[x.doc_id] += x.length
    totals = {x.doc_id: x.doc_tokens for x in kept["packing"]}
    assert {d: n // totals[d] for d, n in pieces.items()} == dict(count("secret redaction"))
    assert all(set(x.asDict()) == set(corpus_pipeline.COLUMNS) for name, found in kept.items() if name != "packing" for x in found)
