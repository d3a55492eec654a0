"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import ann, decontam, langid, minhash, packing, pii, rlz, secrets, suffixes, tokencount
from tidelog.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op1_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return langid.identify(docs, docs.where(~F.col("held_out")), keep=["doc_id", "held_out"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents"), keep_text=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep_ids=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def op7_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.drop_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("found")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multiprobe": op1_multiprobe,
        "op2_language_id": op2_language_id,
        "op3_token_counts": op3_token_counts,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_packing": op5_packing,
        "op6_decontamination": op6_decontamination,
        "op7_rlz": op7_rlz,
        "op8_pii": op8_pii,
        "op9_minhash": op9_minhash,
        "op10_secrets": op10_secrets,
    }


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = "[^\\x20\\x09-\\x0D]+"

#: Same results by plain means; the other operators' models, tokenizers, searches and decodings have none in SQL.
ORACLES = {
    "op4_suffix_dedup": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 w AS (SELECT doc_id, unnest(range(1, octet_length(b) - 398)) AS i, b FROM d), h AS (SELECT doc_id, i, md5(b[i : i + 399]) AS m FROM w),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM h) WHERE n > 1),
 g AS (SELECT doc_id, i, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS s FROM r)),
 s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, run),
 p AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM s),
 k AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, unhex(string_agg(CASE WHEN a > before THEN hex(b[before : a - 1]) ELSE '' END, '' ORDER BY a) || max(CASE WHEN after IS NULL THEN CASE WHEN z <= octet_length(b) THEN hex(b[z : octet_length(b)]) ELSE '' END END)) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, b)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op6_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_SMALL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 m AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS p FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 x AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM m))),
 h AS (SELECT DISTINCT doc_id, i, n, item_id FROM x JOIN m USING (n, p)),
 c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_rlz": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_RUNS}') AS w FROM documents),
 x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS p FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
 g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY p) AS first FROM x) WHERE first < doc_id),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN g USING (doc_id, j) GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_SMALL}, '{_RUNS}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 75 * (u.n + v.n - c)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT x AS doc_id, x AS t FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.t), c AS (SELECT doc_id, min(t) AS component_id FROM r GROUP BY 1)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
