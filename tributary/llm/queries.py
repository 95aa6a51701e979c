"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import byte_bpe, chat, exact_dedup, jaccard_join, language_id, packing, pii, quality, token_output, vector_search
from tributary.llm.common import table


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.op1_token_output(spark, table(spark, sf_dir, "documents"), _public("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op2_exact_dedup(spark, table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3_pii(spark, table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op4_jaccard_join(spark, table(spark, sf_dir, "documents"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.op5_vector_search(spark, table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6_quality(spark, sf_dir)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op8_chat(spark, table(spark, sf_dir, "conversations"))


def chat_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over a table with calls, results, schemas and dependencies, made of all conversations."""
    return chat.op8_chat(spark, chat.with_calls(table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op7_language_id(spark, table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.op9_byte_bpe(spark, table(spark, sf_dir, "documents"), _public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op10_packing(spark, table(spark, sf_dir, "documents"), _public("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_exact_dedup, op3_pii, op4_jaccard_join, op5_vector_search, op6_quality, op7_language_id, op8_chat, op9_byte_bpe, op10_packing, chat_with_calls)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op5_vector_search": vector_search.ORACLE_SQL, "op8_chat": chat.ORACLE_SQL, "chat_with_calls": chat.CALLS_SQL}
