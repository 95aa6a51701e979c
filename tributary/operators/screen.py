"""Label-free feature screen: shape, dominance, missingness, correlation clusters, variance inflation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.exprs import col, count_where, log_magnitude, sample_kurtosis, sample_skewness
from tributary.functions.ranks import quantiles, to_long, value_ranks
from tributary.sources.scratch import materialise

DOMINANT, NULL_SHARE, CORRELATION = 0.99, 0.50, 0.90
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
PHI_RATIO, DIGITS = 0.5, 6
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
#: Columns that say who, when or what a flow was, and so are no features.
NOT_FEATURES = frozenset("uid ts capture dataset orig_h resp_h orig_p label_binary label_class label_source label_method method_sha label_quality label_confidence label_weight labelled_at rule_id rules_matched label_executed label_margin quarantine_reason".split())


def candidates(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns that may be features."""
    numeric, categorical = [], []
    for f in df.schema:
        if f.name.lower() in NOT_FEATURES:
            continue
        kind = f.dataType.typeName()
        if kind in ("double", "float", "long", "integer", "short", "byte", "decimal"):
            numeric.append(f.name)
        elif kind in ("string", "boolean"):
            categorical.append(f.name)
    return numeric, categorical


def preflight(df: DataFrame, needed: Sequence[str]) -> None:
    have = {c.lower() for c in df.columns}
    missing = [n for n in needed if n.lower() not in have]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def shape(df: DataFrame, columns: Sequence[str], log: bool = False, exact: bool = True) -> DataFrame:
    """feature, n, lo, hi, mean, std, skewness, kurtosis, q01 .. q99.

    Moments come from one pass; exact quantiles from ranked counts by value, approximate ones from a sketch in the same pass.
    """
    x = log_magnitude(F.col("value")) if log else F.col("value")
    long = to_long(df, columns).select("feature", x.alias("x"))
    q = [] if exact else [F.percentile_approx("x", list(QUANTILES), 10_000).alias("q")]
    out = long.groupBy("feature").agg(
        F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        sample_skewness(F.col("x")).alias("skewness"), sample_kurtosis(F.col("x")).alias("kurtosis"), *q,
    )
    if exact:
        found = quantiles(long, ["feature"], "x", QUANTILES).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("q"))
        out = out.join(F.broadcast(found), "feature", "left")
    at = (lambda i: F.try_element_at("q", F.lit(i))) if exact else (lambda i: F.get("q", F.lit(i)))
    return out.select(*out.columns[:-1], *(at(i).alias(f"q{round(100 * q):02d}") for i, q in enumerate(QUANTILES)))


def dominant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, n, share of the most frequent value; null is a value; ties go to null, then to the smaller text."""
    counted = to_long(df, columns, kind="string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    total = counted.groupBy("feature").agg(F.sum("n").alias("total"))
    return counted.withColumn("r", rank).where("r = 1").join(F.broadcast(total), "feature").select("feature", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, rows, n_null, n_distinct, null_share."""
    g = to_long(df, columns, kind="string").groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), count_where(F.col("value").isNull()).alias("n_null"), F.countDistinct("value").alias("n_distinct"))
    return g.withColumn("null_share", F.col("n_null") / F.col("rows"))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, corr of each pair, over rows that have both; null where a column is constant there.

    Sums of all pairs are matrix products of each batch, about the columns' means, which a first light pass gives.
    """
    names, k = list(columns), len(columns)
    wide = df.select(*(col(c).cast("double").alias(c) for c in names))
    means = wide.agg(*(F.avg(col(c)).alias(c) for c in names)).first()
    centre = np.array([means[c] or 0.0 for c in names])

    def over(batches):
        total = np.zeros((6, k, k))
        for pdf in batches:
            x = pdf.to_numpy(np.float64) - centre
            has = ~np.isnan(x)
            x, m = np.where(has, x, 0.0), has.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({"i": i, "j": j} | {c: t[i, j] for c, t in zip(SUMS, total)})

    sums = wide.mapInPandas(over, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in SUMS))
    va, vb, cov = (F.col(x) - F.col(y) * F.col(z) / F.col("n") for x, y, z in (("saa", "sa", "sa"), ("sbb", "sb", "sb"), ("sab", "sa", "sb")))
    name, size = F.array(*map(F.lit, names)), F.array(*(F.lit(float(c * c)) for c in centre))
    flat = (va <= 1e-24 * F.col("n") * F.get(size, "i")) | (vb <= 1e-24 * F.col("n") * F.get(size, "j"))
    return sums.select(F.get(name, "i").alias("a"), F.get(name, "j").alias("b"), F.when(~flat, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb))).alias("corr"))


def rank_columns(df: DataFrame, columns: Sequence[str], key: str = "uid") -> DataFrame:
    """df's columns replaced by their ranks (smallest place among equals; null stays null), a row for each key."""
    long = to_long(df, columns, [key]).where("value is not null")
    ranks = value_ranks(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), ["feature"], "value", "n").select("feature", "value", (F.col("before") + 1).cast("double").alias("rank"))
    placed = long.join(ranks, ["feature", "value"])
    return placed.groupBy(key).agg(*(F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(c) for c in columns)).select(*columns)


def spearman_pairs(df: DataFrame, columns: Sequence[str], key: str = "uid") -> DataFrame:
    """Rank correlations; key names each row."""
    return pearson_pairs(materialise(rank_columns(df, columns, key), "rank-columns"), columns)


def verdicts(df: DataFrame, columns: Sequence[str], indicated: Sequence[str] = ()) -> DataFrame:
    """feature, verdict: a column goes for missing values (unless it has an indicator), else for one dominant value."""
    both = missingness(df, columns).join(dominant(df, columns).select("feature", "share"), "feature")
    missing = (F.col("null_share") > NULL_SHARE) & ~F.col("feature").isin(*indicated, "")
    return both.select("feature", "null_share", "share", F.when(missing, "missing").when(F.col("share") >= DOMINANT, "zero-variance").otherwise("keep").alias("verdict"))


def clusters(pairs: Sequence[tuple[str, str, float | None]], columns: Sequence[str], cut: float = CORRELATION) -> list[dict]:
    """Groups of columns that correlations above the cut connect, each with its first column and strongest link."""
    head = {c: c for c in columns}

    def root(c: str) -> str:
        while head[c] != c:
            c = head[c]
        return c

    strong = [(a, b, abs(r)) for a, b, r in pairs if r is not None and abs(r) > cut]
    for a, b, _ in strong:
        x, y = sorted((root(a), root(b)), key=columns.index)
        head[y] = x
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(root(c), []).append(c)
    return [{"keep": k, "members": m, "strongest": max(r for a, _, r in strong if root(a) == k)} for k, m in groups.items() if len(m) > 1]


def inflation(pairs: Sequence[tuple[str, str, float | None]], columns: Sequence[str]) -> tuple[dict[str, float], bool]:
    """Variance inflation of each column from its correlations, and whether the matrix was singular."""
    m = np.eye(len(columns))
    for a, b, r in pairs:
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = 0.0 if r is None or np.isnan(r) else r
    singular = bool(np.linalg.matrix_rank(m) < len(columns))
    inverse = np.linalg.pinv(m) if singular else np.linalg.inv(m)
    return dict(zip(columns, np.diag(inverse).tolist())), singular


def standardisation(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Centre and scale of each column in log space, rounded."""
    r = df.agg(*(f(log_magnitude(col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (round(r[f"m_{c}"] or 0.0, DIGITS), round(r[f"s_{c}"] or 0.0, DIGITS)) for c in columns}


def suggested_phis(df: DataFrame, targets: Sequence[str]) -> dict[str, float | None]:
    """What each constraint's residual is weighed by: a share of its target's usual size. All medians come from one job."""
    found = {r.feature: r.value for r in quantiles(to_long(df, targets), ["feature"], "value", [0.5]).collect()}
    return {t: round(PHI_RATIO / abs(found[t]), DIGITS) if found.get(t) else None for t in targets}


def screen(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), indicated: Sequence[str] = (), key: str = "uid") -> dict:
    """The whole screen: verdicts, correlations of what is kept, clusters, inflation."""
    preflight(df, [*numeric, *categorical, key])
    found = {r.feature: r.verdict for r in verdicts(df, [*numeric, *categorical], indicated).collect()}
    kept = [c for c in numeric if found[c] == "keep"]
    linear = [tuple(r) for r in pearson_pairs(df, kept).collect()] if len(kept) > 1 else []
    ranked = {(a, b): r for a, b, r in map(tuple, spearman_pairs(df, kept, key).collect())} if len(kept) > 1 else {}
    most = [(a, b, max((abs(x) for x in (r, ranked[a, b]) if x is not None), default=None)) for a, b, r in linear]
    vif, singular = inflation(linear, kept) if kept else ({}, False)
    return {"verdicts": found, "pearson": linear, "spearman": ranked, "clusters": clusters(most, kept), "vif": vif, "singular": singular}
