"""Operator 1: token ids as Parquet list columns, readable by columns, row groups and pages.

write_tokens() stores documents in ascending doc_id order: `ids` is a list column, delta-encoded where its
dictionary grows too large, beside metadata columns (doc_id, n_tokens, local_start, part). Row groups and pages
have set sizes and page indexes, so a reader of metadata touches no ids and a reader of a doc_id range touches
few pages.

Null text counts as empty (ids: the end id alone); rows that repeat a doc_id are all stored, side by side; an
empty table gives an empty file; columns other than doc_id and text are ignored; null doc_ids come first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import map_arrow, shared_path, shuffle_partitions, small_batches
from tributary.llm.encoding import WINDOW_BYTES, word_encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
PAGE_ROWS = 2_000


def _encode(path: str, end_id: int):
    def over(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        encoder = word_encoder(path)
        for b in small_batches(batches, "text", WINDOW_BYTES):
            ids, bounds = encoder.encode(b.column(1), end_id)
            n = np.diff(bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(start + bounds[:-1]), pa.array(n), lists], ["part", "doc_id", "local_start", "n_tokens", "ids"])
            start += int(bounds[-1])

    return over


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 1, parts: int | None = None) -> None:
    """Encodes whole texts, appends end_id to each, and writes them to `out` in doc_id order, range by range."""
    spark = docs.sparkSession
    # The text's hash deals rows of one doc_id, or of none, over several parts.
    ordered = docs.select("doc_id", "text").repartitionByRange(parts or shuffle_partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    encoded = map_arrow(ordered, lambda: _encode(tokenizer_path, end_id), "part int, doc_id long, local_start long, n_tokens long, ids array<int>")
    (
        encoded.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", 1)
        .parquet(out)
    )


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. The table of parts is as long as there are files."""
    rows = spark.read.parquet(out)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, at = {}, 0
    for part, n in sorted((r.part, r.n) for r in totals):
        base[part] = at
        at += n
    if not base:
        return rows.select("doc_id", F.col("local_start").alias("start"), "n_tokens", "ids")
    parts = spark.createDataFrame(list(base.items()), "part int, base long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crcs():
    def over(batches):
        for b in batches:
            ids = b.column(2)
            ends = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return over


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens() gives; lengths and checksums come from the lists read."""
    return map_arrow(tokens.select("doc_id", "start", "ids"), _crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    out = shared_path(spark, "tokens")
    write_tokens(docs, tokenizer_path, out)
    return digests(read_tokens(spark, out))
