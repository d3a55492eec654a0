"""A corpus pipeline: STAGES of corpus operators, each applied to all that the stage before it kept.

Null ids and texts: a null text has no language and goes in the first stage; a document with a null doc_id is compared
with no other and stays if its text does. Rows that repeat a doc_id are one document: they stay or go together. An empty
table passes through all stages. Columns besides those of documents don't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, langid, minhash, packing, secrets
from tidelog.llm.common import bounded_batches, deleted, shared_folder, table
from tidelog.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if the classifiers of all languages speak against it more clearly than this (0.5: undecided).
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: one without letters, or unlike every language learned, goes.

    Unlike is a document of whose n-grams too few are known (langid.LIKE), or one that the classifiers speak against. Where
    no row has a label there is nothing to be unlike: all documents with a letter stay.
    """
    bounded_batches(spark)
    if docs.where("doc_id is not null and lang is not null and text is not null").isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = langid.identify(docs, docs, keep=COLUMNS, like=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & F.col("like") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of near duplicates."""
    bounded_batches(spark)
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; a null text has none, and repeated rows go or stay together."""
    return decontam.without_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them replaced by a mark; null and empty texts as they are."""
    bounded_batches(spark)
    return secrets.with_redacted_texts(docs.select(COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids; a null or empty text gives the one with the end id."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language identification", language),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret redaction", redaction),
    ("packing", packed),
]
#: SQL expresses neither the classifier nor the tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written as Parquet beside the checkpoints, read by the next one and
    deleted after it; only the last of these tables stays, as the result reads it."""
    token = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{token}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}-{k}")
            docs = spark.read.parquet(f"{base}-{k}")
            if k:
                deleted(spark, f"{base}-{k - 1}")
    return docs
