"""Corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage works on all that its predecessor kept and returns the columns of documents, but for the last one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontamination, language_id, near_duplicates, packing, pii
from pagemill.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language is unknown or if less than this part of its n-grams is of its best language, however
#: many other languages have them too.
LEAST_KNOWN = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; texts that are null or have no letter go. Repeated rows and null ids
    stay as they are."""
    filters = language_id.fit(docs)
    found = language_id.identify(docs, filters, keep=COLUMNS).filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("known") >= LEAST_KNOWN))
    return found.select(*[F.col(f"k_{c}").alias(c) for c in COLUMNS])


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that of the least id. Repeated rows are one; rows without id or words stay."""
    return near_duplicates.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text has a leaked benchmark item; other texts of the same id stay, and rows without id or text do.
    Equal rows go together. Very long texts are searched whole; ties play no part."""
    leaked = decontamination.leaked_texts(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "th").distinct()
    rows = docs.select(*COLUMNS).withColumn("th", F.xxhash64("text"))
    return rows.join(leaked.hint("merge"), ["doc_id", "th"], "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; every row stays, n_chars is the new text's (null: null)."""
    masked = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; null texts are empty ones."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("duplicates", duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]
#: No stage but the third can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
