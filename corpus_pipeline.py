"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Language identification drops documents without a language; exact dedup keeps the largest doc_id of equal texts; the
n-gram Jaccard join keeps the smallest doc_id of each group of similar ones; personal data is redacted; packing gives
each piece of the rest its place in a training sequence. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import exact_dedup, jaccard_join, language_id, packing, pii
from tributary.llm.common import shared_path, table

#: Documents whose language is less sure than this are rejected; those without any letter always are.
MIN_LANGUAGE_SCORE = 0.3

#: The stages have no SQL: language models, redaction and tokenizers are beyond it. Tests hold them to plain versions.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.filter_rows(docs, model, MIN_LANGUAGE_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_last(docs, spark)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.op10_packing(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
