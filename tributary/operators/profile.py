"""Additive profiles: sufficient statistics per class over a fixed ruler of features and bin edges.

Scalars come from one aggregate. All-pairs products and 2-D histograms are accumulated in each partition with matrix
products and bin counts, and summed by a small aggregate; rows are never exploded into pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import ranks
from tributary.functions.exprs import bin_counts, col, count_where, histogram_bin, log1p_clamped, ratio

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
TOP_K = 40
#: How a pair of bins is packed into one number.
CELL = 1000

# Bin edges of the ruler.
BYTES = (0, 1, 64, 128, 256, 512, 1024, 4096, 16384, 65536, 262144, 1048576, 10485760, 104857600)
PACKETS = (0, 1, 2, 3, 5, 10, 20, 50, 100, 500, 1000, 10000, 100000)
SECONDS = (0, 0.001, 0.01, 0.05, 0.1, 0.5, 1, 2, 5, 10, 30, 60, 300, 900, 3600)
TOTALS = (0, 1, 128, 512, 1024, 4096, 16384, 65536, 262144, 1048576, 10485760, 104857600)
PER_PACKET = (0, 1, 40, 60, 64, 128, 256, 512, 1024, 1500, 9000)
LOG_RATIO = (-6, -4, -3, -2, -1, -0.5, 0, 0.5, 1, 2, 3, 4, 6)
LETTERS = (0, 1, 2, 3, 4, 5, 8, 16, 32)
PORTS = (0, 20, 53, 80, 123, 443, 1024, 3389, 8080, 10000, 32768, 49152, 65535)
HISTORY = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
RATES = (0, 0.1, 1, 10, 100, 1000, 10000, 100000)
MISSED = (0, 1, 1024, 65536, 1048576)


@dataclass(frozen=True)
class Feature:
    name: str
    expr: Callable[[], Column]  # made when a session exists
    edges: tuple[float, ...]
    requires: tuple[str, ...]
    log: bool = True

    def moment(self) -> Column:
        """The value in moment space: nulls count as 0, volumes in logs."""
        x = F.coalesce(col(self.name), F.lit(0.0))
        return log1p_clamped(x) if self.log else x


def _zero(name: str) -> Column:
    return F.coalesce(col(name).cast("double"), F.lit(0.0))


def _sum(x: str, y: str) -> Callable[[], Column]:
    return lambda: _zero(x) + _zero(y)


def _per(x: str, y: str) -> Callable[[], Column]:
    return lambda: ratio(_zero(x), _zero(y))


def default_features() -> list[Feature]:
    """The ruler's numeric features."""
    plain = [("duration", SECONDS), ("orig_bytes", BYTES), ("resp_bytes", BYTES), ("orig_ip_bytes", BYTES), ("resp_ip_bytes", BYTES), ("missed_bytes", MISSED), ("orig_pkts", PACKETS), ("resp_pkts", PACKETS)]
    ob, rb, op, rp = "orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "resp_pkts"
    return [Feature(n, lambda n=n: _zero(n), e, (n,)) for n, e in plain] + [
        Feature("total_bytes", _sum(ob, rb), TOTALS, (ob, rb)),
        Feature("total_pkts", _sum(op, rp), PACKETS, (op, rp)),
        Feature("orig_bytes_per_pkt", _per(ob, op), PER_PACKET, (ob, op)),
        Feature("resp_bytes_per_pkt", _per(rb, rp), PER_PACKET, (rb, rp)),
        Feature("pkt_rate", lambda: ratio(_zero(op) + _zero(rp), col("duration")), RATES, (op, rp, "duration")),
        Feature("byte_ratio", lambda: F.log10((_zero(rb) + 1.0) / (_zero(ob) + 1.0)), LOG_RATIO, (ob, rb), False),
        Feature("resp_port", lambda: F.coalesce(col("resp_p").cast("double"), F.lit(-1.0)), PORTS, ("resp_p",), False),
        Feature("history_len", lambda: F.coalesce(F.length("history"), F.lit(0)).cast("double"), HISTORY, ("history",), False),
    ]


@dataclass
class Ruler:
    features: list[Feature] = field(default_factory=default_features)
    categorical: tuple[str, ...] = ("proto", "service", "conn_state", "history", "local_orig")
    identity: tuple[str, ...] = ("orig_h", "resp_h", "uid")
    null_checks: tuple[str, ...] = ("duration", "orig_bytes", "resp_bytes", "service", "history", "conn_state", "local_orig")
    group: str = "label_class"

    def bind(self, df: DataFrame) -> tuple["Ruler", list[str]]:
        """The ruler restricted to what df has, and the names of the features left out."""
        have = {c.lower() for c in df.columns}
        fits = [f for f in self.features if all(r.lower() in have for r in f.requires)]
        keep = lambda names: tuple(n for n in names if n.lower() in have)
        skipped = [f.name for f in self.features if f not in fits]
        return Ruler(fits, keep(self.categorical), keep(self.identity), keep(self.null_checks), self.group), skipped


def project(df: DataFrame, ruler: Ruler, extra: Sequence[str] = ()) -> DataFrame:
    """Each feature computed once, under its name, beside the group and the columns asked for."""
    return df.select(col(ruler.group), *(col(c) for c in extra), *(f.expr().alias(f.name) for f in ruler.features))


def moments(df: DataFrame, ruler: Ruler) -> DataFrame:
    """Long form: group, feature, n, n_null, n_zero, lo, hi, sum_t, sumsq_t."""
    p = project(df, ruler)
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in ruler.features:
        x, t = col(f.name), f.moment()
        aggs.append(F.struct(F.lit(f.name).alias("feature"), count_where(x.isNull()).alias("n_null"), count_where(x == 0).alias("n_zero"), F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"), F.sum(t).alias("sum_t"), F.sum(t * t).alias("sumsq_t")).alias(f"s_{f.name}"))
    wide = p.groupBy(ruler.group).agg(*aggs)
    return wide.select(ruler.group, "n", F.inline(F.array(*(col(f"s_{f.name}") for f in ruler.features))))


def histograms(df: DataFrame, ruler: Ruler) -> DataFrame:
    """Long form: group, feature, bin, count; every bin of the ruler has a row, nulls are in none."""
    p = project(df, ruler)
    wide = p.groupBy(ruler.group).agg(*(F.array(*bin_counts(col(f.name), f.edges)).alias(f.name) for f in ruler.features))
    rows = F.array(*(F.struct(F.lit(f.name).alias("feature"), col(f.name).alias("counts")) for f in ruler.features))
    return wide.select(ruler.group, F.inline(rows)).select(ruler.group, "feature", F.posexplode("counts").alias("bin", "count"))


def null_counts(df: DataFrame, ruler: Ruler) -> DataFrame:
    wide = df.groupBy(ruler.group).agg(*(count_where(col(c).isNull()).alias(c) for c in ruler.null_checks))
    return wide.unpivot([ruler.group], list(ruler.null_checks), "column", "n_null")


def quantiles(df: DataFrame, ruler: Ruler, exact: bool = True) -> DataFrame:
    p = project(df, ruler)
    if exact:  # every value of every group and feature, so one without any value has no rows
        found = ranks.quantiles(ranks.to_long(p, [f.name for f in ruler.features], [ruler.group]), [ruler.group, "feature"], "value", QUANTILES)
        names = p.select(ruler.group).distinct().select(ruler.group, F.explode(F.array(*(F.lit(f.name) for f in ruler.features))).alias("feature"))
        grid = names.select(ruler.group, "feature", F.explode(F.array(*(F.lit(i) for i in range(len(QUANTILES))))).alias("q"))
        same = grid[ruler.group].eqNullSafe(found[ruler.group]) & (grid["feature"] == found["feature"]) & (grid["q"] == found["q"])
        return grid.join(found, same, "left").select(grid[ruler.group], grid["feature"], grid["q"], found["value"])
    wide = p.groupBy(ruler.group).agg(*(F.percentile_approx(col(f.name), list(QUANTILES), 10_000).alias(f.name) for f in ruler.features))
    rows = F.array(*(F.struct(F.lit(f.name).alias("feature"), col(f.name).alias("v")) for f in ruler.features))
    return wide.select(ruler.group, F.inline(rows)).select(ruler.group, "feature", F.posexplode("v").alias("q", "value"))


def value_counts(df: DataFrame, ruler: Ruler, top: int = TOP_K) -> DataFrame:
    """group, column, value, count of the most frequent values; the rest of a column is folded into `(other)`.

    The rest is a column's total less its top, so no task ever holds or sorts all values of a column.
    """
    long = df.select(col(ruler.group), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(col(c).cast("string"), F.lit("(null)")).alias("value")) for c in ruler.categorical))))
    counted = long.groupBy(ruler.group, "column", "value").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(ruler.group, "column").orderBy(F.desc("count"), "value"))
    first = counted.withColumn("r", rank).where(F.col("r") <= top).drop("r")
    sums = counted.groupBy(ruler.group, "column").agg(F.sum("count").alias("count"))
    rest = sums.select(ruler.group, "column", F.lit("(other)").alias("value"), "count").union(first.select(ruler.group, "column", F.lit("(other)"), -F.col("count")))
    return first.union(rest).groupBy(ruler.group, "column", "value").agg(F.sum("count").alias("count")).where("count > 0")


def distinct_counts(df: DataFrame, ruler: Ruler, exact: bool = False) -> DataFrame:
    of = F.countDistinct if exact else (lambda c: F.approx_count_distinct(c, 0.02))
    wide = df.groupBy(ruler.group).agg(*(of(col(c)).alias(c) for c in ruler.identity))
    return wide.unpivot([ruler.group], list(ruler.identity), "column", "n_distinct")


def capture_span(df: DataFrame, group: str = "label_class") -> DataFrame:
    return df.groupBy("capture", group).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def pair_products(df: DataFrame, ruler: Ruler) -> DataFrame:
    """group, a, b, sum_ab for every pair of features a < b in ruler order, in moment space."""
    names = [f.name for f in ruler.features]
    space = project(df, ruler).select(ruler.group, *(f.moment().alias(f.name) for f in ruler.features))

    def over(batches):
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby(pdf.columns[0], dropna=False):
                x = part[names].to_numpy(np.float64)
                held[g] = held.get(g, 0) + x.T @ x
        for g, m in held.items():
            i, j = np.triu_indices(len(names), 1)
            yield pd.DataFrame({"g": g, "a": i, "b": j, "s": m[i, j]})

    parts = space.mapInPandas(over, "g string, a int, b int, s double")
    name = F.array(*(F.lit(n) for n in names))
    summed = parts.groupBy("g", "a", "b").agg(F.sum("s").alias("sum_ab"))
    return summed.select(F.col("g").alias(ruler.group), F.get(name, "a").alias("a"), F.get(name, "b").alias("b"), "sum_ab")


def joint_histograms(df: DataFrame, ruler: Ruler, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """group, a, b, cell (bin of a * 1000 + bin of b), count; rows where either is null are in none."""
    names = [f.name for f in ruler.features]
    pairs = list(pairs or combinations(names, 2))
    stride = 1 + max(len(f.edges) for f in ruler.features)
    if stride > CELL:
        raise ValueError(f"a ruler of {stride} bins does not fit cells of {CELL}")
    used = [n for n in names if any(n in p for p in pairs)]
    binned = project(df, ruler).select(ruler.group, *(F.coalesce(histogram_bin(col(f.name), f.edges), F.lit(-1)).alias(f.name) for f in ruler.features if f.name in used))

    def over(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby(pdf.columns[0], dropna=False):
                x = {n: part[n].to_numpy(np.int64) for n in used}
                for k, (a, b) in enumerate(pairs):
                    fine = (x[a] >= 0) & (x[b] >= 0)
                    n = np.bincount(x[a][fine] * stride + x[b][fine], minlength=stride * stride)
                    held[g, k] = held.get((g, k), 0) + n
        for (g, k), n in held.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"g": g, "k": k, "cell": at // stride * CELL + at % stride, "n": n[at]})

    counted = binned.mapInPandas(over, "g string, k int, cell long, n long").groupBy("g", "k", "cell").agg(F.sum("n").alias("count"))
    first, second = (F.array(*(F.lit(p[i]) for p in pairs)) for i in (0, 1))
    return counted.select(F.col("g").alias(ruler.group), F.get(first, "k").alias("a"), F.get(second, "k").alias("b"), "cell", "count")


def profile(df: DataFrame, ruler: Ruler | None = None, view: str | None = None) -> dict:
    """The whole profile as one JSON-like document; df is read from memory after the first pass. view: its population."""
    ruler, skipped = (ruler or Ruler()).bind(df)
    df = df.persist()
    try:
        rows = lambda d: [r.asDict() for r in d.collect()]
        return {
            "version": 3, "view": view, "skipped_features": skipped, "group": ruler.group, "edges": {f.name: list(f.edges) for f in ruler.features}, "log": {f.name: f.log for f in ruler.features},
            "moments": rows(moments(df, ruler)), "hist": rows(histograms(df, ruler)), "nulls": rows(null_counts(df, ruler)), "categorical": rows(value_counts(df, ruler)),
            "distinct": rows(distinct_counts(df, ruler)), "pairs": rows(pair_products(df, ruler)), "joint": rows(joint_histograms(df, ruler)),
        }
    finally:
        df.unpersist()
