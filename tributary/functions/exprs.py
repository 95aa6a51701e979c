"""Null-safe column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its literal name; dots in it are no struct access."""
    return F.col(f"`{name}`")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where the bottom is null or zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def log1p_clamped(x: Column) -> Column:
    """ln(1 + x), negatives counting as 0."""
    return F.log(F.lit(1.0) + F.greatest(x.cast("double"), F.lit(0.0)))


def log_magnitude(x: Column) -> Column:
    """ln(1 + |x|), the space in which shapes are judged."""
    return F.log(F.lit(1.0) + F.abs(x.cast("double")))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def bucket_of(seed: str, key: Column, buckets: int) -> Column:
    """A 60-bit md5 bucket of seed and key, the same on every engine."""
    digest = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(buckets).cast("bigint"))


def sample_skewness(x: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; null with fewer than three values or no spread."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Sample excess kurtosis; null with fewer than four values or no spread."""
    n, g = F.count(x).cast("double"), F.kurtosis(x)
    return F.when((n > 3) & (F.var_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both; null where either has no spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def histogram_bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin number over fixed edges: 0 below the first, i for [edge i-1, edge i), len(edges) from the last on; null stays null."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x < F.lit(float(edges[i])), F.lit(i)).otherwise(out)
    return F.when(x.isNotNull(), out)


def bin_counts(x: Column, edges: Sequence[float]) -> list[Column]:
    """One count for each of the len(edges) + 1 bins; nulls are in none."""
    e = [float(v) for v in edges]
    spans = [x < e[0], *((x >= lo) & (x < hi) for lo, hi in zip(e, e[1:])), x >= e[-1]]
    return [count_where(s) for s in spans]
