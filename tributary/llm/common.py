"""What the operators of this subpackage share: table access, shared storage, skew-proof joins."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys may be called hot, so a broadcast of one row for each stays small.
MAX_HOT_KEYS = 20_000
#: No key with fewer rows than this is called hot.
MIN_HOT_ROWS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); set here only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/tributary/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df to shared storage and reads it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """What the optimizer takes df's size to be: files' sizes where it is a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bins_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Bins to deal df's content over: as many as there are shuffle partitions, or more where the input asks for it.

    At most 32 a partition, as the optimizer's guess of what joins give may be far too large.
    """
    parts = shuffle_partitions(df.sparkSession)
    return min(max(parts, -(-input_bytes(df) // bytes_each)), 32 * parts)


def hot_threshold(total_rows: int) -> int:
    """Rows from which a key counts as hot: there can't be more than MAX_HOT_KEYS such keys."""
    return max(MIN_HOT_ROWS, total_rows // MAX_HOT_KEYS + 1)


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, size: str, total_rows: int, spread: Column) -> DataFrame:
    """Left join of rows to classes (one row for each key, `size` rows in it) that no hot key can skew.

    Keys of at least hot_threshold(total_rows) rows are at most MAX_HOT_KEYS, so their classes are broadcast;
    rows of such keys go through the shuffle under `spread`, a value that is no key, and so are dealt evenly.
    """
    values = [c for c in classes.columns if c != key]
    hot = classes.where(F.col(size) >= hot_threshold(total_rows)).select(key, *(F.col(c).alias(f"_h_{c}") for c in values))
    tagged = rows.join(F.broadcast(hot), key, "left").withColumn("_k", F.when(F.col(f"_h_{size}").isNull(), F.col(key)).otherwise(spread))
    cold = classes.where(F.col(size) < hot_threshold(total_rows)).select(F.col(key).alias("_k"), *(F.col(c).alias(f"_c_{c}") for c in values))
    return tagged.join(cold, "_k", "left").select(*rows.columns, *(F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in values))


_kept: list[Callable[[], None]] = []
_stage: list[int] = [-1]


def kept_for_stage(make: Callable):
    """A cache of one entry that a worker keeps from task to task of a stage, and drops when it begins another stage."""
    cached = functools.lru_cache(maxsize=1)(make)
    _kept.append(cached.cache_clear)
    return cached


def _begin_task() -> None:
    from pyspark import TaskContext

    task = TaskContext.get()
    if task is not None and task.stageId() != _stage[0]:
        for clear in _kept:
            clear()
        _stage[0] = task.stageId()


def give_back() -> None:
    """Returns freed memory to the system, as idle workers stay beside those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], schema) -> DataFrame:
    """mapInArrow; `make` runs once in each task and returns the function over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin_task()
        give_back()
        yield from make()(batches)
        give_back()

    return df.mapInArrow(run, schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that `column` has about max_bytes in each, or one row where a row is longer."""
    for batch in batches:
        start, held = 0, 0
        col = batch.column(batch.schema.get_field_index(column))
        for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
            if held and held + (n or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)
