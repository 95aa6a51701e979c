"""Global ranks and order statistics without a single-partition window or a buffer of all values of a group.

Distinct values are counted first, which combines before the shuffle. They are dealt by range, added up part by part, and
shifted by the sums of earlier parts. The local sums are written once, as parts must not be dealt anew between the two.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.exprs import col
from tributary.sources.scratch import materialise


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where entries are, null included."""
    return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def value_ranks(values: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """values (keys, value, n: rows that have it, ...) with `before`: rows of smaller values of the same keys."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.repartitionByRange(parts, *(col(k) for k in keys), col(value)).sortWithinPartitions(*(col(k) for k in keys), col(value))
    where, names = values.columns.index(n), [values.columns.index(k) for k in keys]
    schema = T.StructType([*dealt.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def running(batches):
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            count = b.column(where).to_numpy(zero_copy_only=False).astype(np.int64)
            change = np.zeros(b.num_rows, bool)
            for i in names:
                codes = _codes(b.column(i))
                change[1:] |= codes[1:] != codes[:-1]
            first = tuple(b.column(i)[0].as_py() for i in names)
            total = total if first == last else 0
            sums = np.concatenate(([0], np.cumsum(count)))
            start = np.maximum.accumulate(np.where(change, np.arange(b.num_rows), 0))
            base = np.where(np.cumsum(change) > 0, sums[start], -total)
            last, total = tuple(b.column(i)[b.num_rows - 1].as_py() for i in names), int(sums[-1] - base[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(sums[:-1] - base)], [*b.schema.names, "_part", "_local"])

    local = materialise(dealt.mapInArrow(running, schema), "ranks")
    if not keys:
        raise ValueError("ranks need a key")
    earlier = Window.partitionBy(*(col(k) for k in keys)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy("_part", *(col(k) for k in keys)).agg(F.sum(col(n)).alias("_sum"))
    shift = sums.select(F.col("_part").alias("_p"), *(col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"_k{i}"))
    # A key that lies in one part alone has no row of its own here but one of shift 0: parts + keys rows at most.
    return local.join(F.broadcast(shift), same).select(*(col(c) for c in values.columns), (F.col("_local") + F.col("_shift")).alias("before"))


def count_values(long: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """keys, value, n of a long table; null values are left out."""
    value = col(value) if isinstance(value, str) else value
    return long.select(*(col(k) for k in keys), value.alias("value")).where("value is not null").groupBy(*(col(k) for k in keys), "value").agg(F.count(F.lit(1)).alias("n"))


def order_statistics(ranked: DataFrame, keys: Sequence[str], shares: Sequence[float], between: bool = True) -> DataFrame:
    """keys, q (index into shares), value: exact quantiles of ranked counts (keys, value, n, before).

    between: interpolated between the two nearest values; else the smallest value with at least that share of rows up to it.
    Each row answers only the shares that fall on it, so what is shuffled is two rows a quantile.
    """
    totals = ranked.groupBy(*(col(k) for k in keys)).agg(F.sum("n").alias("_total"))
    totals = totals.select(*(col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_total")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"_k{i}"))
    held = ranked.join(F.broadcast(totals), same) if keys else ranked.crossJoin(F.broadcast(totals))  # totals of no key: one row
    place = (lambda q: (F.col("_total") - 1) * F.lit(float(q))) if between else (lambda q: F.greatest(F.ceil(F.col("_total") * F.lit(float(q))) - 1, F.lit(0)).cast("double"))
    asked = F.array(*(F.struct(F.lit(i).alias("q"), place(q).alias("at")) for i, q in enumerate(shares)))
    covers = lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n"))
    mine = F.filter(asked, lambda x: covers(F.floor(x["at"])) | covers(F.ceil(x["at"])))
    met = held.select(*(col(k) for k in keys), "value", "n", "before", F.inline(mine))
    low, high = F.max(F.when(covers(F.floor("at")), F.col("value"))), F.max(F.when(covers(F.ceil("at")), F.col("value")))
    share = F.max(F.col("at") - F.floor("at"))
    return met.groupBy(*(col(k) for k in keys), "q").agg((low + (high - low) * share if between else low).alias("value"))


def quantiles(long: DataFrame, keys: Sequence[str], value: Column | str, shares: Sequence[float], between: bool = True) -> DataFrame:
    """keys, q, value: exact quantiles of a long table's values by keys."""
    return order_statistics(value_ranks(count_values(long, keys, value), keys, "value", "n"), keys, shares, between)


def to_long(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """feature, value and the carried columns: a row for each of `columns`."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), col(c).cast(kind).alias("value")) for c in columns))
    return df.select(*(col(c) for c in carry), F.inline(cells))


def _ntile(place: Column, total: Column, bins: int) -> Column:
    """The bin, 1 .. bins, of a row by the number of rows before it."""
    small, large = F.floor(total / bins), total % bins
    edge = large * (small + 1)
    return F.when(place < edge, F.floor(place / (small + 1)) + 1).otherwise(large + F.floor(F.try_divide(place - edge, small)) + 1).cast("int")


def counts_by_value(df: DataFrame, columns: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """feature, value (null too), the carried columns, n: written once, as ranks and bins both read it."""
    return materialise(to_long(df, columns, carry).groupBy("feature", "value", *(col(c) for c in carry)).agg(F.count(F.lit(1)).alias("n")), "value-counts")


def binned_counts(df: DataFrame, columns: Sequence[str], key: str, bins: int, carry: str, counted: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """feature, bin, carry, n: rows by bin, 1 .. bins of equal numbers of rows by (value, key), 0 for null.

    Bins come from counts by value (`counted`: feature, value, carry, n; `ranked`: feature, value, n, before; made here where not
    given): a value whose rows all fall into one bin needs no more. Only rows of the values that an edge cuts, fewer than
    `bins` a feature, are ranked by key.
    """
    counted = counts_by_value(df, columns, [carry]) if counted is None else counted
    if ranked is None:
        ranked = value_ranks(counted.where("value is not null").groupBy("feature", "value").agg(F.sum("n").alias("n")), ["feature"], "value", "n")
    totals = ranked.groupBy("feature").agg(F.sum("n").alias("total"))
    placed = ranked.join(F.broadcast(totals), "feature")
    first, last = _ntile(F.col("before"), F.col("total"), bins), _ntile(F.col("before") + F.col("n") - 1, F.col("total"), bins)
    placed = materialise(placed.select("feature", "value", "before", "total", first.alias("bin"), last.alias("last")), "placed-values")
    cut = placed.where("bin <> last").select("feature", "value", "before", "total")
    whole = counted.join(placed.where("bin = last").select("feature", "value", "bin"), ["feature", "value"]).select("feature", "bin", col(carry), "n")
    out = whole.union(counted.where("value is null").select("feature", F.lit(0).alias("bin"), col(carry), "n"))
    names = [r.feature for r in cut.select("feature").distinct().collect()]  # at most as many as columns
    if names:
        rows = to_long(df, names, [key, carry]).join(F.broadcast(cut.select("feature", "value")), ["feature", "value"])
        ties = value_ranks(rows.select("feature", "value", col(key).alias("_key"), col(carry).alias("_carry"), F.lit(1).alias("n")), ["feature", "value"], "_key", "n")
        ties = ties.withColumnRenamed("before", "inside").join(F.broadcast(cut), ["feature", "value"])
        out = out.union(ties.select("feature", _ntile(F.col("before") + F.col("inside"), F.col("total"), bins), F.col("_carry"), F.col("n").cast("long")))
    return out.groupBy("feature", "bin", col(carry)).agg(F.sum("n").alias("n"))
