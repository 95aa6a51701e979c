"""Reproducible disjoint pools by a seeded hash: membership is computed, never stored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.exprs import bucket_of, col

MIN_BUCKETS = 100


@dataclass(frozen=True)
class Partition:
    """Named shares of a key's buckets, by ranges in the order declared; excluded qualities are in no pool."""

    seed: str
    shares: tuple[tuple[str, float], ...]
    buckets: int = 1_000_000
    key: str = "uid"
    exclude: tuple[str, ...] = ("out-of-space",)

    def __post_init__(self) -> None:
        if not self.seed:
            raise ValueError("a partition needs a seed")
        if self.buckets < MIN_BUCKETS:
            raise ValueError(f"at least {MIN_BUCKETS} buckets are needed")
        if len({n for n, _ in self.shares}) < len(self.shares) or any(s <= 0 for _, s in self.shares):
            raise ValueError("pools need different names and positive shares")
        if abs(sum(s for _, s in self.shares) - 1) > 1e-9:
            raise ValueError("shares must sum to 1")
        if any(lo == hi for _, lo, hi in self.ranges()):
            raise ValueError("a pool has no bucket: more buckets are needed")

    def ranges(self) -> list[tuple[str, int, int]]:
        """name, first bucket, bucket after the last; ends are rounded sums of shares, so no bucket is lost."""
        out, total, at = [], 0.0, 0
        for i, (name, share) in enumerate(self.shares):
            total += share
            end = self.buckets if i == len(self.shares) - 1 else round(total * self.buckets)
            out.append((name, at, end))
            at = end
        return out

    def bucket(self) -> Column:
        return bucket_of(self.seed, col(self.key), self.buckets)

    def pool(self) -> Column:
        """The pool of a row's bucket, whatever its quality."""
        b, out = self.bucket(), F.lit(None).cast("string")
        for name, lo, hi in self.ranges():
            out = F.when((b >= lo) & (b < hi), F.lit(name)).otherwise(out)
        return out

    def allowed(self, df: DataFrame) -> Column:
        """Rows without a quality are in; excluded ones are not."""
        if "label_quality" not in df.columns or not self.exclude:
            return F.lit(True)
        return F.coalesce(~F.col("label_quality").isin(*self.exclude), F.lit(True))

    def rows(self, df: DataFrame, name: str) -> DataFrame:
        lo, hi = next((lo, hi) for n, lo, hi in self.ranges() if n == name)
        return df.where((self.bucket() >= lo) & (self.bucket() < hi) & self.allowed(df))


def assign(df: DataFrame, partition: Partition) -> DataFrame:
    """df with bucket and pool (null where the row's quality is excluded)."""
    return df.withColumns({"bucket": partition.bucket(), "pool": F.when(partition.allowed(df), partition.pool())})


def counts(df: DataFrame, partition: Partition, by: Sequence[str] = ("label_class",)) -> DataFrame:
    return assign(df, partition).where("pool is not null").groupBy("pool", *by).agg(F.count(F.lit(1)).alias("n"))


def audited(pool: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of a pool that were audited, with the analyst's class for theirs."""
    said = verdicts.where("analyst_class is not null and analyst_class not in ('', 'unknown')").select("uid", "analyst_class")
    return pool.drop("label_class").join(said, "uid").withColumnRenamed("analyst_class", "label_class")
