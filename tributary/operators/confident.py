"""Confident learning: how far pseudo-labels can be trusted, from out-of-fold probabilities.

Input rows hold a key, `label` (index of the class), and `probs` (array of doubles, one a class).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.ranks import count_values, order_statistics, value_ranks
from tributary.sources.scratch import materialise

Q, GAMMA, W_MIN, EPSILON, FOLDS = 0.70, 4.0, 0.20, 1e-6, 5
GRID = tuple(product((0.6, 0.7, 0.8), (0.1, 0.2, 0.3), (4.0, 6.0, 8.0)))


def scored(df: DataFrame) -> DataFrame:
    """df with `score`, the probability of the label a row has."""
    return df.withColumn("score", F.get("probs", F.col("label")))


def ranked_scores(df: DataFrame) -> DataFrame:
    """label, value, n, before: counts of each class's scores, ranked. What thresholds and scales need of the rows."""
    return value_ranks(count_values(scored(df), ["label"], "score"), ["label"], "value", "n")


def _thresholds(ranked: DataFrame, qs: Sequence[float]) -> DataFrame:
    found = order_statistics(ranked, ["label"], qs, between=False)
    return found.select("label", F.get(F.array(*(F.lit(float(q)) for q in qs)), "q").alias("q"), F.col("value").alias("threshold"))


def _scales(ranked: DataFrame, epsilon: float) -> DataFrame:
    middle = order_statistics(ranked, ["label"], [0.5]).select(F.col("label").alias("_l"), F.col("value").alias("_m"))
    off = ranked.join(F.broadcast(middle), F.col("label") == F.col("_l")).groupBy("label", F.abs(F.col("value") - F.col("_m")).alias("value")).agg(F.sum("n").alias("n"))
    return order_statistics(value_ranks(off, ["label"], "value", "n"), ["label"], [0.5]).select("label", F.greatest("value", F.lit(epsilon)).alias("scale"))


def thresholds(df: DataFrame, q: float = Q) -> DataFrame:
    """label, threshold: the order statistic ceil(q * n) of the class's scores."""
    return _thresholds(ranked_scores(df), [q]).select("label", "threshold")


def scales(df: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """label, scale: median absolute deviation of the class's scores, at least epsilon."""
    return _scales(ranked_scores(df), epsilon)


def statistics(df: DataFrame, qs: Sequence[float] = (Q,), epsilon: float = EPSILON) -> DataFrame:
    """label, q, threshold, scale: a row for each class and q, written once, from one scan of the rows."""
    ranked = ranked_scores(df)
    return materialise(_thresholds(ranked, qs).join(_scales(ranked, epsilon), "label"), "class-statistics")


def weights(df: DataFrame, q: float = Q, gamma: float = GAMMA, w_min: float = W_MIN) -> DataFrame:
    """df with score and weight in [w_min, 1]: a logistic centred on the class threshold."""
    out = scored(df).join(F.broadcast(statistics(df, [q]).drop("q")), "label")
    z = (F.col("score") - F.col("threshold")) / (gamma * F.col("scale"))
    return out.withColumn("weight", w_min + (1.0 - w_min) / (1.0 + F.exp(-z))).drop("threshold", "scale")


def soft_joint(df: DataFrame) -> DataFrame:
    """label, k, mass: sums of the probability of class k over rows of each label."""
    return df.select("label", F.posexplode("probs").alias("k", "p")).groupBy("label", "k").agg(F.sum("p").alias("mass"))


def hard_joint(df: DataFrame) -> DataFrame:
    """label, k, n: rows by the likeliest class among those that reach their class's mean self-confidence; ties go to the first.

    The means are a number for each class, so each row finds its class in itself and only counts are shuffled.
    """
    means = {r.label: r.mean for r in scored(df).where("label is not null").groupBy("label").agg(F.avg("score").alias("mean")).collect()}
    if not means:
        return df.select("label", F.lit(0).alias("k"), F.lit(0).cast("long").alias("n")).limit(0)
    bars = F.array(*(F.lit(means.get(k)).cast("double") for k in range(max(means) + 1)))
    reached = F.filter(F.transform("probs", lambda p, k: F.struct(F.when(p >= F.get(bars, k), p).alias("p"), (-k).alias("neg"))), lambda x: x["p"].isNotNull())
    best = df.select("label", F.array_max(reached).alias("m")).where("m is not null")
    return best.select("label", (-F.col("m.neg")).alias("k")).groupBy("label", "k").agg(F.count(F.lit(1)).alias("n"))


def retention(weighted: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """label, rho, factor: each class's estimated clean share, and what its weights are scaled by to carry it. One pass over the rows."""
    each = weighted.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.get("probs", F.col("label"))).alias("own"), F.sum(F.aggregate("probs", F.lit(0.0), lambda s, p: s + p)).alias("mass"))
    rho = F.coalesce(F.try_divide("own", "mass"), F.lit(0.0))
    return each.select("label", rho.alias("rho"), (rho * F.col("n") / F.greatest("w", F.lit(epsilon))).alias("factor"))


def balanced(weighted: DataFrame, w_min: float = W_MIN) -> DataFrame:
    """weighted with weights scaled by their class's factor, clipped to [w_min, 1]."""
    out = weighted.join(F.broadcast(materialise(retention(weighted).select("label", "factor"), "retention")), "label")
    return out.withColumn("weight", F.greatest(F.lit(w_min), F.least(F.lit(1.0), F.col("weight") * F.col("factor")))).drop("factor")


def sce_loss(weighted: DataFrame, alpha: float = 0.3, beta: float = 2.0, epsilon: float = 0.01) -> DataFrame:
    """weighted with loss: weight * (alpha * cross entropy + beta * reverse cross entropy) against smoothed labels."""
    others = epsilon / (F.size("probs") - 1)
    target = F.transform("probs", lambda p, i: F.when(i == F.col("label"), F.lit(1.0 - epsilon)).otherwise(others))
    safe = F.transform("probs", lambda p: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p)))
    total = lambda xs, ys: F.aggregate(F.zip_with(xs, ys, lambda x, y: x * F.log(y)), F.lit(0.0), lambda s, v: s + v)
    return weighted.withColumn("_t", target).withColumn("loss", F.col("weight") * (-alpha * total(F.col("_t"), safe) - beta * total(F.col("probs"), F.col("_t")))).drop("_t")


def grid(df: DataFrame) -> DataFrame:
    """q, w_min, gamma, objective (mean weight of rows whose likeliest class is their label, less that of the others)."""
    cells = df.sparkSession.createDataFrame(list(GRID), "q double, w_min double, gamma double")
    right = F.array_position("probs", F.array_max("probs")) - 1 == F.col("label")
    base = scored(df).withColumn("right", right).join(F.broadcast(statistics(df, sorted({g[0] for g in GRID}))), "label").join(F.broadcast(cells), "q")
    w = F.col("w_min") + (1 - F.col("w_min")) / (1 + F.exp(-(F.col("score") - F.col("threshold")) / (F.col("gamma") * F.col("scale"))))
    return base.groupBy("q", "w_min", "gamma").agg((F.coalesce(F.avg(F.when(F.col("right"), w)), F.lit(0.0)) - F.coalesce(F.avg(F.when(~F.col("right"), w)), F.lit(0.0))).alias("objective"))
