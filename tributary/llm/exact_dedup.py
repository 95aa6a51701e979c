"""Operator 2: exact dedup against a persistent digest index, bucketed and sorted by digest.

The index has one row for each distinct text: digest (SHA-256), keep_id, group_size, batch. A batch of documents
is reduced to its distinct digests, those the index has are dropped by a sort-merge anti-join that needs no
shuffle of the index, and the rest are appended.

Null text counts as empty. Texts are equal when identical. Of equal texts in a batch the largest doc_id stays (a null
doc_id is smaller than any); texts that an earlier batch brought are all dropped, and their keep_id is the earlier
one's. Rows that repeat both doc_id and text share their decision. An empty table gives no rows. Decisions rest on
doc_id and text alone; documents travel beside them in a struct, so their columns may have any names. Adding a batch
again, say after a crash, gives the same decisions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import join_by_class, shared_path, shuffle_partitions

SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"


class DigestIndex:
    """An index at `path`, which any later session can open; `buckets` must not change over its life.

    While it is open, a table of the session's catalogue stands for it; close() takes that away and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.buckets, self.name = spark, buckets, f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, keyed: DataFrame, batch: str) -> None:
        """Adds the digests of `keyed` (doc_id, digest) that the index lacks."""
        if self.rows().where(F.col("batch") == batch).limit(1).count():
            return
        groups = keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.rows().select(F.col("digest").alias("known")).hint("merge")
        # The second condition keeps the join above the aggregate: below it, a hot text's rows would all be shuffled.
        fresh = groups.join(known, (F.col("digest") == F.col("known")) & (F.col("group_size") > 0), "left_anti").withColumn("batch", F.lit(batch))
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def decide(self, keyed: DataFrame, batch: str) -> DataFrame:
        """keyed (doc_id, digest, and at most `doc`) with keep_id, group_size (rows with that text in the batch that brought it), batch and kept."""
        total = self.rows().agg(F.sum("group_size")).first()[0] or 0
        spread = F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        joined = join_by_class(keyed, self.rows(), "digest", "group_size", total, spread)
        return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Adds docs to the index; doc (a struct of all columns of docs), doc_id, digest, keep_id, group_size, batch, kept."""
    digest = digest_of(F.col("text"))
    index.append(docs.select("doc_id", digest.alias("digest")), batch)
    return index.decide(docs.select(F.struct("*").alias("doc"), "doc_id", digest.alias("digest")), batch)


def keep_last(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """docs, all columns, without the rows whose text another with a larger doc_id has."""
    index = new_index(spark)
    kept = dedup_batch(docs, index, "all").where("kept").select("doc.*")
    index.close()
    return kept


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, shared_path(spark, "digests"), shuffle_partitions(spark))


def op2_exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    index, keyed = new_index(spark), docs.select("doc_id", digest_of(F.col("text")).alias("digest"))
    index.append(keyed, "all")
    decided = index.decide(keyed, "all").select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    index.close()
    return decided


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
