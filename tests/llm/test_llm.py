"""Corpus operators against brute force, with nulls, repeats, empty tables, long texts and clashing columns."""

import bz2
import collections
import gzip
import hashlib
import lzma
import random
import re
import time
import urllib.parse
import zlib
from base64 import b64encode

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tidelog.llm import ann, common, decontam, langid, minhash, packing, phrases, pii, rlz, secrets, suffixes, tokencount  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, d bigint, a string, at string, key string, text_ string"


def frame(spark, texts, langs=None, parts=3):
    """Rows (doc_id, text) with extra columns whose names the operators use inside."""
    rows = [(d, t, (langs or {}).get(d, "en"), "s", None if t is None else len(t), 7, "a", "at", "key", "x") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def corpus(seed, n=60):
    """Prose with exact and near copies, shared passages, nulls, empty texts, repeated rows and one long text."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghéü") for _ in range(r.randint(1, 6))) for _ in range(150)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, base = prose(80), prose(120)
    out = []
    for d in range(n):
        kind = d % 6
        if kind == 0:
            t = prose(r.randint(1, 200))
        elif kind == 1:
            t = prose(20) + "  " + passage + "\n" + prose(15)
        elif kind == 2:
            x = base.split()
            for _ in range(r.randint(0, 8)):
                x[r.randrange(len(x))] = r.choice(words)
            t = " ".join(x)
        elif kind == 3:
            t = base if d % 4 else passage + " " + passage
        elif kind == 4:
            t = r.choice(["", " \n ", "a", None, prose(4), prose(12), prose(13)])
        else:
            t = passage[: r.randint(100, 500)] + prose(5)
        out.append((d, t))
    out += [out[1], out[2], (None, passage), (None, None), (n, ("lorem " * 3000).strip())]
    return out


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_sliding_argmin():
    r = np.random.default_rng(0)
    for n in range(1, 40):
        for w in (1, 2, 5, 20):
            x = r.integers(0, 4, n).astype(np.uint64)
            assert common.sliding_argmin(x, w).tolist() == [i + int(np.argmin(x[i : i + w])) for i in range(n - w + 1)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, bucket int, cell int, score double")


def test_nearest(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 8)).astype(np.float32)
    v[10:40] = v[10]
    rows = [(i, v[i].tolist(), 0, 1, 2, 0.5) for i in range(400)]
    rows += [(None, v[0].tolist(), 0, 1, 2, 0.5), (900, None, 0, 1, 2, 0.5), (1000, [0.0] * 8, 0, 1, 2, 0.5), (1100, [float("nan")] + [1.0] * 7, 0, 1, 2, 0.5), (1200, [None] + [1.0] * 7, 0, 1, 2, 0.5), (1300, [1.0], 0, 1, 2, 0.5), rows[20]]
    got = collections.defaultdict(list)
    for x in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        hits += len({i for i, _ in found} & set(want))
        assert all(s == pytest.approx(d[i]) for i, s in found) and found == sorted(found, key=lambda x: (x[1], x[0])) and len({i for i, _ in found}) == 10
    assert hits >= 0.9 * 10 * len(got)
    assert [i for i, _ in got[20]] == [i for i in range(10, 21) if i != 20]
    assert ann.nearest(vectors(spark, rows).limit(0), F.lit(True)).count() == 0
    few = ann.nearest(vectors(spark, rows[:3]), F.col("vec_id") == 0)
    assert few.count() == 2


def test_split_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 16)
    rows = [(i, [1.0, 2.0], 0, 1, 2, 0.5) for i in range(200)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") == 100, k=5).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in got] == [(i, 0.0) for i in range(5)]


def measured(spark, tmp_path, v, queries=40):
    """Recall against brute force, and the result, with the parameters of the query."""
    n, dims = v.shape
    arrays = [pa.array(np.arange(n)), pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.float32).ravel()), dims).cast(pa.list_(pa.float32()))]
    pq.write_table(pa.table(arrays, names=["vec_id", "embedding"]), tmp_path / "embeddings.parquet")
    chosen = np.arange(0, n, 100)[:queries]
    got = collections.defaultdict(set)
    for x in ann.nearest(spark.read.parquet(str(tmp_path / "embeddings.parquet")), F.col("vec_id").isin(chosen.tolist())).collect():
        got[x.query_id].add(x.vec_id)
    w = v.astype(np.float32).astype(np.float64)
    want = {q: {int(i) for i in np.argsort(((w - w[q]) ** 2).sum(axis=1), kind="stable")[:11] if i != q} for q in chosen.tolist()}
    return sum(len(got[q] & set(list(want[q])[:10])) for q in want) / sum(min(10, len(x)) for x in want.values())


@pytest.mark.parametrize("rows, dims, norm, clusters", [(10_000, 64, 1.0, 0), (50_000, 64, 1.0, 0), (10_000, 64, 0.05, 0), (10_000, 64, 10.0, 0), (10_000, 32, 1.0, 0), (10_000, 64, 10.0, 200), (50_000, 32, 1.0, 200)])
def test_nearest_recall(spark, tmp_path, monkeypatch, rows, dims, norm, clusters):
    r = np.random.default_rng(rows + dims)
    v = r.normal(size=(rows, dims))
    if clusters:
        v = r.normal(size=(clusters, dims))[r.integers(0, clusters, rows)] + 0.05 * v
    v *= norm / np.linalg.norm(v, axis=1, keepdims=True)
    made = []
    plain = ann.Hashes.choose
    monkeypatch.setattr(ann.Hashes, "choose", lambda self, *a: (plain(self, *a), made.append(self))[0])
    assert measured(spark, tmp_path, v) >= 0.9
    if clusters:
        tables = made[0][dims]
        met = np.zeros((20, rows), bool)
        for t in range(4):
            keys = tables.keys(t, tables.slots(t, v))
            for k, visited in enumerate(tables.probes(t, tables.slots(t, v[:20]))):
                met[k] |= np.isin(keys, visited)
        assert met.mean() < 0.1


def test_nearest_of_lengths_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 8)
    r = np.random.default_rng(3)
    v = {i: r.normal(size=3 if i % 3 else 5) for i in range(120)}
    for i in range(40, 100):
        v[i] = v[40 if i % 3 else 42]
    got = collections.defaultdict(list)
    for x in ann.nearest(vectors(spark, [(i, x.tolist(), 0, 1, 2, 0.5) for i, x in v.items()]), F.col("vec_id") % 2 == 0, k=4).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    v = {i: x.astype(np.float32).astype(np.float64) for i, x in v.items()}
    want = {q: sorted((i for i in v if i != q and len(v[i]) == len(v[q])), key=lambda i: (float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i))[:4] for q in range(0, 120, 2)}
    assert all(got[q] == want[q] for q in range(40, 100, 2)) and sum(got[q] == x for q, x in want.items()) >= 0.9 * len(want)


def test_language(spark):
    r = random.Random(2)
    alphabets = {"xx": "abcdef", "yy": "uvwxyz", "zz": "äöüßmn"}
    texts, langs = [], {}
    for d in range(240):
        lang = r.choice(sorted(alphabets))
        langs[d] = lang if d % 17 else None
        texts.append((d, " ".join("".join(r.choice(alphabets[lang]) for _ in range(5)) for _ in range(30))))
    texts += [(500, None), (501, ""), (502, "12 %%"), (None, "abc"), (503, "abcdef " * 2000)]
    df = frame(spark, texts, langs).withColumn("lang", F.when(F.col("doc_id") < 240, F.col("lang")))
    got = {x.doc_id: x for x in langid.identify(df.withColumn("score", F.lit(9.0)), df.where("doc_id % 4 <> 2"), n_train=90, n_landmarks=30).collect()}
    assert len(got) == 245
    assert all(got[d].lang_pred == x for d, x in langs.items() if x)
    assert [got[d].lang_pred for d in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0.0
    assert got[503].lang_pred == "xx" and 0.5 < got[503].score <= 1
    assert {x.lang_pred for x in langid.identify(df, df.limit(0), keep=["doc_id"]).collect()} == {"und"}
    assert langid.identify(df.limit(0), df).count() == 0


def test_documents_unlike_all_languages_go(spark, sf):
    import corpus_pipeline

    r = random.Random(16)
    letters = "abcdefghijklmnopqrstuvwxyz"
    unlike = ["Съешь ещё этих мягких французских булок да выпей же чаю", "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", "今天天气很好我们一起去公园散步吧然后去吃饭看电影"]
    unlike += ["".join(r.choice(letters + " " * spaces) for _ in range(n)) for n in (100, 400, 3000) for spaces in (0, 4)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame([(10**9 + k, t, None, "s", len(t)) for k, t in enumerate(unlike)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    both = docs.unionByName(odd).repartition(3)
    lettered = {x.doc_id for x in docs.collect() if any(map(str.isalpha, x.text or ""))}
    assert {x.doc_id for x in corpus_pipeline.language(spark, both, sf).collect()} == lettered
    clash = langid.identify(both.withColumn("like", F.lit("x")), docs.where("doc_id % 2 = 0"), keep=["doc_id", "like"], like=True)
    assert clash.columns == ["doc_id", "lang_pred", "score", "like"]
    held = {x.doc_id: x for x in clash.collect()}
    assert not any(held[10**9 + k].like for k in range(len(unlike))) and [held[10**9 + k].score for k in range(3)] == [0.0] * 3
    assert all(held[d].like for d in lettered)


def test_kernel_ridge_by_plain_means(spark):
    r = random.Random(24)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(40)] for lang, letters in (("aa", "abcdeo"), ("bb", "abxyeo"), ("cc", "cdxyeo"))}
    langs = {d: "abc"[d % 3] * 2 for d in range(90)}
    texts = [(d, " ".join(r.choice(words[lang]) for _ in range(25))) for d, lang in langs.items()]
    df = frame(spark, texts, langs)
    model = langid.fit(df, n_train=10_000, n_landmarks=20, ridge=0.01)
    model.prepare()
    # The landmarks: in turn from each language, in the order of the hash of the ids.
    drawn = [x.doc_id for x in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("x")).orderBy("x", "lang").collect()]
    turn = {d: sum(langs[x] == langs[d] for x in drawn[: drawn.index(d)]) for d in drawn}
    chosen = sorted(drawn, key=lambda d: (turn[d], langs[d], drawn.index(d)))[:20]
    grams = {d: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for d, t in texts}
    known = set().union(*(grams[d] for d in chosen))
    kernel = lambda x, y: len(x & y & known) / max(1, len(x & known)) ** 0.5 / max(1, len(y & known)) ** 0.5
    k = np.array([[kernel(grams[a], grams[b]) for b in chosen] for a in drawn])
    w = np.array([[kernel(grams[a], grams[b]) for b in chosen] for a in chosen])
    y = np.array([[1.0 if langs[d] == lang else -1.0 for lang in ("aa", "bb", "cc")] for d in drawn])
    # Ridge in the landmarks' space: minimise weighted squares plus ridge times the norm, for the kernel's own functions.
    weight = 1 / 30
    values, vectors = np.linalg.eigh(w)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    phi = k @ root
    beta = np.linalg.solve(weight * phi.T @ phi + 0.01 * np.eye(20), weight * phi.T @ y)
    unseen = [" ".join(r.choice(words[lang]) for _ in range(12)) for lang in ("aa", "bb", "cc")] + ["zzz qqq"]
    own = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in unseen]
    want = np.array([[kernel(x, grams[b]) for b in chosen] for x in own]) @ root @ beta
    assert np.allclose(model.scores(unseen), want, atol=1e-3) and [model.langs[i] for i in want[:3].argmax(axis=1)] == ["aa", "bb", "cc"]


def test_language_in_large_alphabets(spark):
    r = random.Random(17)
    # 220 characters that all languages use, and 40 rarer ones of each.
    common, own = [chr(0x4E00 + x) for x in range(220)], {f"k{k}": [chr(0x6000 + 40 * k + x) for x in range(40)] for k in range(3)}
    langs = {d: f"k{d % 3}" for d in range(400)}
    texts = [(d, "".join(r.sample([r.choice(common) for _ in range(400)] + [r.choice(own[lang]) for _ in range(20)], 420))) for d, lang in langs.items()]
    df = frame(spark, texts, langs)
    got = {x.doc_id: x for x in langid.identify(df, df.where("doc_id < 300"), keep=["doc_id"], like=True).collect()}
    assert [d for d, lang in langs.items() if got[d].lang_pred != lang] == []
    lookup = langid.classes(np.arange(1000, 2000))
    assert sorted(set(lookup[1000:2000])) == list(range(1, langid.ALPHABET + 1)) and not lookup[2000:].any()
    assert langid.classed(np.array([1000, 5, 1000 << 21 | 1001, 5 << 42 | 1000 << 21 | 1000]), lookup).tolist() == [1, -1, 1 << 21 | 2, -1]


def test_known_share_in_stretches(monkeypatch):
    text = "the cat sat on the mat, ÄÖ and 1234 " * 3
    codes, counts = langid.counted(text)
    brute = collections.Counter(text.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(text) + 1 - n) if text[i : i + n].isalpha())
    assert sorted(counts) == sorted(brute.values())
    model = langid.Model(["en"], langid.classed(codes[counts > 3], langid.classes(codes[codes < 1 << 21])), np.zeros((0, 0)), np.zeros((0, 0)), codes[codes < 1 << 21])
    model.prepare()
    share = counts[counts > 3].sum() / counts.sum()
    for size in (langid.STRETCH, 7, 50):
        monkeypatch.setattr(langid, "STRETCH", size)
        assert [x.tolist() for x in langid.counted(text)] == [codes.tolist(), counts.tolist()] and model.known(text) == pytest.approx(share)


def test_grams_in_stretches(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog ñandú"
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert langid.grams(text).tolist() == whole.tolist()


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = tokencount.unigram_scores(path)
    plain = {p: s for p, s in scores.items() if not re.fullmatch("<0x[0-9A-F]{2}>", p)}

    def brute(word):
        best = [(0, 0)]
        for e in range(1, len(word) + 1):
            ways = [(best[s][0] + plain[word[s:e]], best[s][1] - 1) for s in range(max(0, e - 20), e) if word[s:e] in plain]
            if word[e - 1] not in plain:
                raw = word[e - 1].encode()
                ways.append((best[-1][0] + sum(scores[f"<0x{b:02X}>"] for b in raw), best[-1][1] - len(raw)))
            best.append(max(ways))
        return -best[-1][1]

    texts = corpus(4) + [(700, "日本語 <0x41> " + "x" * 900 + " tokens, tokenization."), (701, "a" * 201)]
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_pretokens, x.n_tokens) for x in tokencount.token_counts(frame(spark, texts), path).collect())
    words = lambda t: (t or "").encode().split()
    assert got == sorted((d is None, d or 0, len(words(t)), sum(brute("▁" + w.decode()) for w in words(t))) for d, t in texts)
    assert tokencount.token_counts(frame(spark, texts).limit(0), path).count() == 0


def test_trie_starts_afresh(monkeypatch):
    scores = {"▁": -5, "a": -3, "b": -3, "ab": -4, "▁a": -4}
    one = tokencount.Trie(scores)
    monkeypatch.setattr(tokencount, "NODES", 3)
    monkeypatch.setattr(tokencount, "REMEMBERED", 2)
    small = tokencount.Trie(scores)
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))).encode() for _ in range(200)]
    assert [small.counts([w]) for w in words] == [one.counts([w]) for w in words]


def suffix_brute(texts):
    raw = [(d, (t or "").encode()) for d, t in texts]
    seen = collections.Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((str(d), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("part, settled, hot", [(8000, 4096, 2000), (4, 2, 2)])
def test_suffix_dedup(spark, monkeypatch, part, settled, hot):
    for module, name, value in ((suffixes, "PART", part), (suffixes, "SETTLED", settled), (phrases, "HOT", hot), (phrases, "SENT_PLACES", 100 * hot)):
        monkeypatch.setattr(module, name, value)
    texts = corpus(5) + [(800 + k, "y" * k + "z" * 430 + "w" * k) for k in range(3)]
    got = suffixes.drop_repeated_bytes(frame(spark, texts), keep_text=True).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == suffix_brute(texts)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got)
    assert suffixes.drop_repeated_bytes(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffix_dedup_of_passages_in_many_surroundings(spark, monkeypatch, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    r = random.Random(21)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, shorter = text(700), text(390)
    texts = [(k, text(r.randint(0, 300)) + passage[r.randint(0, 60) : 700 - r.randint(0, 60)] + text(r.randint(0, 300))) for k in range(40)]
    texts += [(100 + k, text(250) + shorter + text(250)) for k in range(40)]
    texts += [(200 + k, texts[k][1]) for k in range(3)]
    got = suffixes.drop_repeated_bytes(frame(spark, texts), keep_text=False).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == suffix_brute(texts)


def colliding_texts():
    """Two texts of 400 bytes whose strings differ but have equal polynomial hashes modulo 2**64, whatever the odd base:
    the difference is a multiple of the product of x**e - 1 for powers of two e."""
    p = np.ones(1, np.int64)
    for e in (1, 2, 4, 8, 16, 32, 64, 2, 4, 8, 16, 32, 128):
        p = np.concatenate([np.zeros(e, np.int64), p]) - np.concatenate([p, np.zeros(e, np.int64)])
    one, two = (bytes((65 + np.maximum(s * p, 0)).tolist()) for s in (1, -1))
    return one, two


def test_suffix_dedup_compares_bytes(spark):
    one, two = colliding_texts()
    assert len(one) == 318 and one != two and max(one) < 128
    h = [phrases.prefix(suffixes.byte_numbers()(x))[-1] for x in (one, two)]
    assert h[0] == h[1]
    r = random.Random(4)
    for _ in range(12):
        tail = bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(82))
        texts = [(k, (x + tail).decode()) for k, x in enumerate((one, two))]
        found = [phrases.anchors_of(phrases.prefix(suffixes.byte_numbers()(t.encode())), 400, 64)[2].tolist() for _, t in texts]
        if found[0] == found[1] and found[0][0] >= 318:
            break
    got = suffixes.drop_repeated_bytes(frame(spark, texts)).collect()
    assert {len(t) for _, t in texts} == {400} and [x.n_removed for x in got] == [0, 0]


def test_repeated_ids_cost_no_lists_of_all_copies(spark):
    texts = [(None, "q" * 3 + "many words in one text that repeats itself in all rows " * 12)] * 400
    own = phrases.dealt(phrases.keyed(frame(spark, texts)))
    rows, _ = phrases.all_candidates(phrases.keyed(frame(spark, texts)), suffixes.byte_numbers, 400, 64, (169, 13, 1), False)
    most = phrases.with_places(own, rows).select(F.max(F.size("places"))).first()[0]
    assert 0 < most <= len(texts[0][1])


def test_loser_tree():
    r = random.Random(3)
    for n in (1, 2, 3, 7):
        runs = []
        every = []
        for _ in range(n):
            run = sorted(("".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(r.randint(0, 15))))
            every += run
            runs.append(suffixes.front_coded([(x, x[::-1], 2, 3, 0) for x in run]))
        got = list(suffixes.merge(runs))
        assert [x[0] for _, x in got] == sorted(every) and all(x[1] == x[0][::-1] for _, x in got)
        assert [same for same, _ in got[1:]] == [suffixes.common_prefix(a[0], b[0]) for (_, a), (_, b) in zip(got, got[1:], strict=False)]


def test_repeated_windows():
    r = random.Random(6)
    for _ in range(60):
        rows = sorted(("".join(r.choice("ab") for _ in range(r.randint(3, 9))).encode(), "".join(r.choice("ab") for _ in range(r.randint(0, 4))).encode(), 0, 0, 0) for _ in range(r.randint(2, 12)))
        shared = [0] + [suffixes.common_prefix(x[0], y[0]) for x, y in zip(rows, rows[1:], strict=False)]
        got = suffixes.repeated_windows(rows, shared, 7, 5)
        strings = [[(left[:k][::-1] + right[: 7 - k]) if len(left) >= k and len(right) >= 7 - k else None for k in range(5)] for right, left, *_ in rows]
        assert got.tolist() == [[x is not None and any(y[k] == x for j, y in enumerate(strings) if j != i) for k, x in enumerate(row)] for i, row in enumerate(strings)]


def rlz_brute(texts):
    first = {}
    for d, t in texts:
        w = (t or "").encode().split()
        for i in range(len(w) - 12) if d is not None else ():
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 12) if d is not None else ():
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out.append((str(d), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed, block, hot, places", [(7, 8000, 2000, 100_000), (8, 4, 2, 5)])
def test_rlz(spark, monkeypatch, seed, block, hot, places):
    for module, name, value in ((rlz, "BLOCK", block), (phrases, "HOT", hot), (rlz, "RUN_PLACES", places)):
        monkeypatch.setattr(module, name, value)
    texts = corpus(seed)
    got = rlz.drop_repeats(frame(spark, texts)).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in got) == rlz_brute(texts)
    split = collections.defaultdict(list)
    for d, t in texts:
        split[d].append((t or "").encode().split())
    n = 0
    for x in got:
        own = next(w for w in split[x.doc_id] if len(w) == x.n_words)
        gone = np.zeros(len(own), bool)
        for f in x.factors:
            gone[f.start : f.end] = True
            assert f.ref_doc < x.doc_id and f.end - f.start >= 13
            assert any(w[f.ref_start : f.ref_start + f.end - f.start] == own[f.start : f.end] for w in split[f.ref_doc])
            n += f.end - f.start > 40
        assert gone.sum() == x.n_removed
    assert n > 10
    assert rlz.drop_repeats(frame(spark, texts).limit(0)).count() == 0


def test_rlz_block():
    block = rlz.Block(3)
    block.add(b"a b c d e f".split(), 1, 10)
    block.add(b"x b c d g a b c".split(), 2, 20)
    words = b"b c d g a b c d e y x b c".split()
    assert list(block.factors(words)) == [(0, 7, 2, 21), (5, 9, 1, 11), (10, 13, 2, 20)]


def test_word_windows_in_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 3)
    r = random.Random(22)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passage, shorter = prose(20), prose(9)
    texts = [(k, f"{prose(r.randint(0, 20))} {passage} {prose(9)} {shorter} {prose(r.randint(0, 20))}") for k in range(60)]
    got = rlz.drop_repeats(frame(spark, texts), keep_text=False).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in got) == rlz_brute(texts)


def test_cells_hold_every_window_once(monkeypatch):
    x = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    h = phrases.prefix(x)
    first, count, anchor = phrases.anchors_of(h, 13, 5)
    for cell in (9, 4, 1):
        found = []
        for _, _, begin, n, geo, _ in phrases.cells(h, anchor, anchor - first - count + 1, anchor - first, 9, cell, 13):
            off, width = phrases.unpack_geo(geo.astype(np.int64))
            assert (width == cell).all() and (off < cell).all() and (off >= n - 1).all()
            found += [s for a, k in zip(begin, n, strict=True) for s in range(a, a + k)]
        assert sorted(found) == list(range(288))


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = corpus(9) + [(900, "It's DON'T. x.,! <|endoftext|> İΣς é. naïve, a.́ \x1c%%%"), (901, "word " * 9000)]
    rows = packing.pack(frame(spark, texts), path, largest=256).collect()
    assert len({x.sequence_id for x in rows}) == len(rows)
    by = collections.defaultdict(list)
    for x in rows:
        assert x.length & (x.length - 1) == 0 and x.length <= 256 and x.offset == 0 and x.bucket == x.length.bit_length() - 1
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        by[x.doc_id].append(x)
    for d, t in texts:
        if d is None or d in (1, 2):
            continue
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[d], key=lambda x: x.start)
        assert [i for x in pieces for i in x.ids] == want and {x.doc_tokens for x in pieces} == {len(want)}
        assert len(pieces) == len(want) // 256 + bin(len(want) % 256).count("1")
    assert len(by[1]) == 2 * len({x.start for x in by[1]})
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing_with_each_vocabulary(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = [t or "" for _, t in corpus(19)] + ["It's DON'T.  two  spaces x.,! <|endoftext|> İΣς é. naïve, \n\n a.́ %%%"]
    tokenizer = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(path).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def decontam_brute(text, items, width=10):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        windows = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        for win in windows:
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit[i : i + len(win)] = [True] * len(win)
                    found.add(item)
    return len(words), sum(hit), len(found - {None}), hashlib.sha256(",".join(sorted(map(str, found - {None}))).encode()).hexdigest(), any(hit)


@pytest.mark.parametrize("most", [16 << 20, 300])
def test_decontamination(spark, most):
    texts = corpus(10)
    r = random.Random(1)
    items = [(k, " ".join((texts[r.randrange(60)][1] or "q").upper().split()[:n])) for k, n in enumerate([3, 1, 2, 11, 14, 30, 12, 9])]
    items += [(3, items[3][1]), (20, None), (21, "--"), (None, "zz zz"), (100, items[5][1]), (22, "héé")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hit", F.lit(1))
    texts += [(910, "a zz--ZZ b"), (911, "HÉé héé")]
    got = decontam.decontaminate(frame(spark, texts), bench, most_bytes=most).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == sorted((str(d), *decontam_brute(t, items)) for d, t in texts)
    kept = decontam.without_contaminated(frame(spark, texts), bench, most_bytes=most).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in kept) == sorted((str(d), str(t)) for d, t in texts if not decontam_brute(t, items)[4])
    assert decontam.decontaminate(frame(spark, texts).limit(0), bench).count() == 0
    none = decontam.decontaminate(frame(spark, texts), bench.limit(0), most_bytes=most)
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)


def test_windows_with_one_ending_and_equal_hashes(monkeypatch):
    r = random.Random(25)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 14))) + " same end") for k in range(300)] + [(400, "same end"), (401, "w1")]
    texts = [" ".join(r.choice([items[r.randrange(300)][1], r.choice(words)]) for _ in range(8)) for _ in range(40)]
    plain = decontam.hashed
    for bits in (64, 3):
        monkeypatch.setattr(decontam, "hashed", lambda words, a, b, bits=bits: plain(words, a, b) >> 64 - bits << 64 - bits)
        benchmark = decontam.Benchmark([(k, t.encode()) for k, t in items], 10)
        for text in texts:
            hit, found = benchmark.scan(decontam.words_of(text.encode()))
            want = decontam_brute(text, items)
            assert (len(hit), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(hit)) == want


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def pii_brute(t):
    out = []
    for rank, (kind, p) in enumerate(PII):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            out += [(m.start(), rank, m.end(), kind)] if ok else []
    return sorted(out)


def test_pii(spark):
    r = random.Random(11)
    bits = ["a@b.c", "a@b.c_d@e.f", "x.y@z", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.4", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111112", "1--2 3", "+49 (0)30 1234567", "+1 2", "+123456789012345678", "é", "𝒳", " ", "\n", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "-", "."]
    texts = [(k, "".join(r.choice(bits) + r.choice(["", " ", "é"]) for _ in range(r.randint(0, 12)))) for k in range(300)]
    texts += [(400, None), (401, ""), (None, "a@b.c"), (402, "a@b.c " * 3000), (403, "a" * 50_000), (404, "a." * 20_000 + "@" + "b." * 20_000 + "c"), (405, "Please pay to IBAN GB82 WEST 1234 5698 7654 32."), (406, "Her social security number is 123-45-6789"), (407, "part 123-45-6789")] + texts[:3]
    got = sorted((str(x.doc_id), x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in pii.find_pii(frame(spark, texts)).collect())
    want = []
    for d, t in texts:
        found = pii_brute(t)
        n = collections.Counter(x[3] for x in found)
        want.append((str(d), n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()))
    assert got == sorted(want)
    spans = {x.doc_id: x.spans for x in pii.find_pii(frame(spark, texts)).where("doc_id >= 405").collect()}
    assert "iban:19:46" in spans[405] and spans[406] == "ssn:30:41" and spans[407] == ""
    assert pii.find_pii(frame(spark, texts).limit(0)).count() == 0


def test_account_numbers_end_where_their_country_says(spark):
    number, other = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    texts = [f"iban {number} The bank", f"iban {number} AND more", f"iban {other} X", f"iban {number}", f"iban {number}A", f"iban {number[:-1]}3", f"iban {other} {number}"]
    got = [x.spans for x in pii.find_pii(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert [[y for y in x.split(",") if y.startswith("iban")] for x in got] == [["iban:5:32"], ["iban:5:32"], ["iban:5:27"], ["iban:5:32"], [], [], ["iban:5:27", "iban:28:55"]]


def secret_brute(t):
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.A):
        out += [(m.start(), 0, m.end(), "assign")] if len(m[1]) >= 6 else []
    for rank, kind, p, n in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, t or "") if len(m[0]) >= n]
    return sorted(out)


def test_secrets(spark):
    r = random.Random(12)
    bits = ["password=abcdef", "PassWD : 'x1y2z3'", "passwd=token: abcdefgh", "secret==abc", "api_key=\"1234567\"", "apikey:ab", "AKIA" + "B" * 16, "AKIA" + "C" * 15, "AKIAAKIA" + "D" * 14, "0123456789abcdef01234567", "ab" * 11, "é", " ", "ſecret=abcdef", "toKen=abcdef"]
    texts = [(k, "".join(r.choice(bits) + r.choice(["", " ", "ö"]) for _ in range(r.randint(0, 8)))) for k in range(300)]
    inner = "password=hunter2hunter2"
    packed = b64encode(gzip.compress(("note " + inner).encode())).decode()
    nested = urllib.parse.quote(b64encode(inner.encode()).decode(), safe="")
    deep = b64encode(b64encode(packed.encode())).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in inner)
    texts += [(400, None), (401, ""), (None, inner), (402, "é " + packed + " end"), (403, "x " + nested + "%3D"), (404, "é " + escaped), (405, deep), (406, "%41" * 9000), (407, "a" * 60_000), (408, "%25" * 40 + "41")] + texts[:2]
    df = frame(spark, texts)
    rows = secrets.scan_secrets(df).collect()
    want = []
    for d, t in texts:
        found = secret_brute(t)
        n = collections.Counter(x[3] for x in found)
        want.append((str(d), n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in rows) == sorted(want)
    by = {x.doc_id: x for x in rows}
    assert f"assign:2:{2 + len(packed)}" in by[402].spans
    assert by[403].spans.startswith("assign:2:") and by[404].spans == f"assign:2:{2 + len(escaped)}" and by[405].spans == f"assign:0:{len(deep)}"
    assert by[402].redacted == "é [SECRET] end" and by[400].redacted is None and by[401].redacted == ""
    clean = {x.doc_id: x for x in secrets.with_redacted_texts(df).collect()}
    assert clean[402].text == "é [SECRET] end" and clean[402].n_chars == len("é [SECRET] end") and clean[401].text == "" and clean[400].text is None
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_secrets_in_short_base64(spark):
    short = [b64encode(x).decode() for x in (b"token=abcdef", b"password=hunter2")]
    assert [len(x) for x in short] == [16, 24]
    texts = [*short, short[1].rstrip("="), "Verantwortlichkeit", b64encode(b"token=abcde").decode()]
    got = {x.doc_id: x for x in secrets.scan_secrets(frame(spark, [(k, f"x {t} y") for k, t in enumerate(texts)])).collect()}
    assert [got[k].spans for k in range(5)] == ["assign:2:18", "assign:2:26", "assign:2:24", "", ""]
    assert got[0].redacted == got[1].redacted == "x [SECRET] y"


def test_secrets_encoded_in_part(spark):
    noise = " ".join(hashlib.sha256(b"%d" % k).hexdigest()[:20] for k in range(30))
    wrap = lambda x, end="\n": end.join(re.findall(".{1,76}", b64encode(x).decode()))
    zipped, prose = wrap(gzip.compress(f"{noise} password=hunter2hunter2".encode())), wrap(b"y" * 50 + b" password=hunter2hunter2 tail")
    assert zipped.count("\n") > 2 and prose.count("\n") == 1
    texts = ['é {"password": "\\u0068unter22"} tail', 'a token%20%3D%20"abcdef99" tail', f"see:\n{zipped}\n\nend of it", f"é: {zipped}".replace("\n", "\r\n  "), f"{prose}\nword", "k " + b64encode(b"note password: ").decode() + ' "hunter2x" z', "u=" + urllib.parse.quote(b64encode(b"note token=abcdef").decode(), safe="") + " z", "one%20two \\u0041 " + b64encode(b"nothing to hide here").decode()]
    got = {x.doc_id: x for x in secrets.scan_secrets(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[k].redacted for k in range(8)] == ['é {"[SECRET]"} tail', 'a [SECRET]" tail', "see:\n[SECRET]\n\nend of it", "é: [SECRET]", "[SECRET]\nword", 'k [SECRET]" z', "[SECRET] z", texts[7]]
    assert [got[k].spans for k in (0, 1, 6, 7)] == ["assign:4:29", "assign:2:25", f"assign:0:{len(texts[6]) - 2},assign:2:25", ""]


def test_secrets_in_long_and_nested_streams(monkeypatch):
    pack = lambda x: b64encode(x).strip()
    inner, plain = b"note password=hunter2hunter2", " ".join(f"é{k}" for k in range(2000)).encode()
    texts = [pack(gzip.compress(gzip.compress(inner))), pack(lzma.compress(bz2.compress(zlib.compress(inner))))]
    texts += [pack(f(plain) + f(inner)) for f in (gzip.compress, bz2.compress, lzma.compress)]
    texts += [pack(f(plain + inner + plain)) for f in (gzip.compress, zlib.compress, bz2.compress, lzma.compress)]
    texts += [pack(gzip.compress(plain + b" " + pack(gzip.compress(inner)) + b" " + plain))]
    for sizes in ((1 << 20, 64 << 20, 1 << 20), *((64, size, 200) for size in (999, 1000, 1013, 1500))):
        for name, size in zip(("PIECE", "LAYER", "OVERLAP"), sizes, strict=True):
            monkeypatch.setattr(secrets, name, size)
        assert [secrets.all_spans(b"x " + t + b" y")[1] for t in texts] == [[(2, 2 + len(t), "assign")] for t in texts]
        binary = pack(gzip.compress(plain + b"\xff token=abcdef " + plain + b"\xff"))
        assert secrets.all_spans(b"x " + binary) == ([], [(2, 2 + len(binary), "assign")])


def decoded_to_the_end(text):
    while (plain := urllib.parse.unquote_to_bytes(text)) != text:
        text = plain
    return text


def test_deeply_nested_escapes_take_time_in_proportion():
    r = random.Random(23)
    for _ in range(300):
        text = "".join(r.choice(["%", "25", "41", "%3", "4", "x", "%25"]) for _ in range(r.randint(1, 14))).encode()
        assert secrets.unescaped(text) == decoded_to_the_end(text)
    assert secrets.unescaped(rb"\u005cu00e9 \x5cx41 %5cx2541") == "é A A".encode()
    for inner in (b"%" + b"25" * 500_000 + b"74oken=abcdef", b"\\u005c" + b"u005c" * 200_000 + b"u0074oken=abcdef"):
        at = time.perf_counter()
        assert (2, 2 + len(inner), "assign") in secrets.all_spans(b"x " + inner + b" y")[1]
        assert time.perf_counter() - at < 60
    for depth in (1, 5, 31, 32, 33, 40):
        inner = b"%" + b"25" * depth + b"74oken=abcdef"
        assert secrets.all_spans(b"x " + inner) == ([(3, 3 + 2 * depth + 2, "hex")] if depth > 10 else [], sorted({(2, 2 + len(inner), "assign"), *([(2, 2 + len(inner), "hex")] if depth > 11 else [])}, key=secrets.order))


def near_brute(texts):
    sets = []
    for d, t in texts:
        w = (t or "").encode().translate(minhash.LOWER).split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    label = {d: d for d, _ in sets if d is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return sorted((str(d), len(x), str(find(d) if d is not None else None), d is None or find(d) == d) for d, x in sets)


@pytest.mark.parametrize("block, hot", [(2048, 8192), (5, 8192), (5, 1)])
def test_near_duplicates(spark, monkeypatch, block, hot):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(minhash, "HOT_QUERIES", hot)
    r = random.Random(13)
    words = [f"w{k}" for k in range(300)]
    base = [r.choice(words) for _ in range(90)]
    texts = []
    for d in range(150):
        x = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            x[r.randrange(len(x))] = r.choice(words)
        texts.append((r.randrange(1000) * 200 + d, " ".join(x)))
    texts += corpus(14) + [(5000, "A B c"), (5001, "a b C"), (5002, "c b a")]
    got = minhash.near_duplicates(frame(spark, texts)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in got) == near_brute(texts)
    assert minhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_near_duplicates_of_large_keys_are_those_of_small_ones(spark, monkeypatch):
    """Links whose documents have one band in common only, many of them in one key: a further band would lose them all."""
    r = random.Random(23)
    words = [f"w{k}" for k in range(5000)]
    base = [r.choice(words) for _ in range(120)]
    texts = []
    for d in range(260):
        x = list(base)
        for at in r.sample(range(120), r.choice([2, 3, 4, 5])):
            x[at] = r.choice(words)
        texts.append((d + 1, " ".join(x)))
    bands = dict(bands=4, per_band=5)
    got = []
    for hot, share in ((8192, 32), (1, 32), (1, 1), (40, 4)):
        for name, value in (("HOT_QUERIES", hot), ("ORDER_SHARE", share), ("BLOCK_ROWS", 64)):
            monkeypatch.setattr(minhash, name, value)
        got.append(sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(frame(spark, texts), **bands).collect()))
    assert got[1:] == got[:1] * 3


def test_near_duplicates_meet_only_if_enough_is_left_for_a_link(spark, monkeypatch):
    """Texts of one beginning share bands, but their sets are too unlike: in keys of any size none of them meet."""
    r = random.Random(31)
    words = [f"w{k}" for k in range(50_000)]
    base = [r.choice(words) for _ in range(80)]
    texts = [(d + 1, " ".join(base + [r.choice(words) for _ in range(20)])) for d in range(200)]
    real, met = minhash.set_rows, []
    monkeypatch.setattr(minhash, "set_rows", lambda docs, ids, most, width: met.append(most) or real(docs, ids, most, width))
    assert all(x.kept and x.component_id == x.doc_id for x in minhash.near_duplicates(frame(spark, texts)).collect())
    assert met[-2:] == [200, 0]


def test_near_duplicates_of_ids_with_several_sets(spark):
    r = random.Random(37)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for group in range(4):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(40):
            x = list(base)
            for at in r.sample(range(60), r.choice([1, 2, 2, 3])):
                x[at] = r.choice(words)
            texts.append((group * 100 + r.randrange(30), " ".join(x[: r.choice([60, 60, 52])])))
    texts += [(7, ""), (107, None), (7, texts[-1][1])]
    got = minhash.near_duplicates(frame(spark, texts)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in got) == near_brute(texts)


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_prefixes_of_linked_sets_meet(spark, percent):
    r = random.Random(percent)
    words = [f"w{k}" for k in range(900)]
    base = [r.choice(words) for _ in range(70)]
    texts = [(d, " ".join([r.choice(words) if r.random() < 0.02 else w for w in base][: r.choice([70, 70, 66, 58])])) for d in range(80)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    sets = {d: set(minhash.shingles(t.encode(), minhash.WordHashes(), 5).tolist()) for d, t in texts}
    long, short = {}, {}
    for x in minhash.prefixes(docs, docs.select("doc_id"), 80, 5, percent).collect():
        long.setdefault(x.doc_id, set()).add(x.shingle)
        if x.short:
            short.setdefault(x.doc_id, set()).add(x.shingle)
    linked = [(a, b) for a in sets for b in sets if a != b and len(sets[a]) <= len(sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(linked) > 50 and all(short[a] & long[b] for a, b in linked)
    assert all(len(long[d]) <= len(sets[d]) - percent * len(sets[d]) // 100 + 1 for d in sets)


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(15)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {x.node: x.label for x in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == label


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = corpus(15) + [(950, "1234 %%"), (951, "the password=abcdefgh1 is here"), (952, "zq xw vu ts rq po nm lk ji hg fe dc")]
    frame(spark, texts).select(corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "ZQ xw vu ts rq po nm lk ji hg")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = docs.collect()
    ids = {name: {x.doc_id for x in rows} for name, rows in kept.items()}
    lettered = {d for d, t in texts if any(map(str.isalpha, t or ""))}
    assert ids["language identification"] == lettered
    classes = {x[0]: x[3] for x in near_brute([x for x in texts if x[0] in lettered])}
    assert ids["near-duplicate removal"] == {d for d in lettered if classes[str(d)]}
    assert ids["benchmark decontamination"] == ids["near-duplicate removal"] - {952}
    assert {x.doc_id: x.text for x in kept["secret redaction"]}[951] == "the [SECRET] is here"
    assert sum(x.length for x in kept["packing"] if x.doc_id == 951) == kept["packing"][[x.doc_id for x in kept["packing"]].index(951)].doc_tokens
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((str(x.doc_id), x.start, x.ids_crc32) for x in total.collect()) == sorted((str(x.doc_id), x.start, x.ids_crc32) for x in kept["packing"])
