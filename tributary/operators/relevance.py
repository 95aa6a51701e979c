"""Task relevance and domain leakage of features: mutual information, rank AUC, and what the two say together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.ranks import binned_counts, counts_by_value, to_long, value_ranks
from tributary.sources.scratch import materialise

BINS, DOMAIN_HIGH = 20, 0.75
#: A count for each domain is kept beside each value; more domains than this are refused.
MAX_DOMAINS = 1_000


def _information(cells: DataFrame) -> DataFrame:
    """feature, mi (bits), relevance (mi over the label's entropy) of cells (feature, b, y, n)."""
    w = Window.partitionBy("feature")
    t = cells.withColumns({"total": F.sum("n").over(w), "nb": F.sum("n").over(Window.partitionBy("feature", "b")), "ny": F.sum("n").over(Window.partitionBy("feature", "y"))})
    part = F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("total") / (F.col("nb") * F.col("ny")))
    mi = t.groupBy("feature").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("mi"))
    share = F.col("ny") / F.col("total")
    h = t.select("feature", "y", share.alias("p")).distinct().groupBy("feature").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return mi.join(h, "feature").select("feature", "mi", F.coalesce(F.try_divide("mi", "h"), F.lit(0.0)).alias("relevance"))


def mutual_information(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, key: str, bins: int = BINS, counted: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """Of all features at once; numeric ones in bins of equal frequency (ties by key), null in a bin of its own.

    counted, ranked: what binned_counts() takes of numeric values, where the caller has them.
    """
    cells = []
    if numeric:
        cells.append(binned_counts(df, numeric, key, bins, label, counted, ranked).select("feature", F.col("bin").cast("string").alias("b"), F.col(label).alias("y"), "n"))
    if categorical:
        long = to_long(df, categorical, [label], "string").select("feature", F.coalesce("value", F.lit("__null")).alias("b"), F.col(label).alias("y"))
        cells.append(long.groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("n")))
    return _information(cells[0].union(cells[1]) if len(cells) == 2 else cells[0])


def _auc(ranked: DataFrame) -> DataFrame:
    """feature, auc of (feature, before, n, n_pos): the Mann-Whitney statistic with midranks, the better direction."""
    mid = F.col("before") + (F.col("n") + 1) / 2
    g = ranked.groupBy("feature").agg(F.sum(F.col("n_pos") * mid).alias("r"), F.sum("n_pos").alias("p"), F.sum(F.col("n") - F.col("n_pos")).alias("q"))
    auc = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * F.col("q")).cast("double"))
    return g.select("feature", F.greatest(auc, 1 - auc).alias("auc"))


def domain_auc(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], positive: Column) -> DataFrame:
    """How well each feature alone tells one domain: from counts by distinct value, so no row is ranked."""
    df = df.withColumn("_pos", positive.cast("int"))
    counts = lambda long, by: long.groupBy("feature", by).agg(F.count(F.lit(1)).alias("n"), F.sum("_pos").alias("n_pos"))
    out = []
    if numeric:
        out.append(counts(to_long(df, numeric, ["_pos"]).where("value is not null"), "value").select("feature", F.col("value").alias("s"), "n", "n_pos"))
    if categorical:
        by_value = counts(to_long(df, categorical, ["_pos"], "string").where("value is not null"), "value")
        rate = by_value.withColumn("s", F.col("n_pos") / F.col("n"))
        out.append(rate.groupBy("feature", "s").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")))
    both = out[0].union(out[1]) if len(out) == 2 else out[0]
    return _auc(value_ranks(both, ["feature"], "s", "n"))


def domains(df: DataFrame, domain: str) -> list[str]:
    names = [r[0] for r in df.select(domain).distinct().orderBy(domain).limit(MAX_DOMAINS + 1).collect()]
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains: {domain} is no domain")
    return names


def _ranked_by_domain(counted: DataFrame, names: Sequence[str], domain: str) -> DataFrame:
    """feature, value, n, before and _d0, _d1, ...: rows of each domain that have the value, ranked once for all."""
    each = [F.sum(F.when(F.col(domain) == d, F.col("n")).otherwise(0)).alias(f"_d{i}") for i, d in enumerate(names)]
    return value_ranks(counted.where("value is not null").groupBy("feature", "value").agg(F.sum("n").alias("n"), *each), ["feature"], "value", "n")


def worst_domain_auc(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], domain: str, names: Sequence[str] | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """The most identifiable domain's AUC of each feature. Values are counted and ranked once for all domains.

    names, ranked: the domains and numeric values ranked with their counts, where the caller has them.
    """
    names = names or domains(df, domain)
    if len(names) < 2:
        return domain_auc(df, numeric, categorical, F.col(domain) == names[0]).select("feature", F.lit(None).cast("double").alias("auc"))
    each = F.posexplode(F.array(*(F.col(f"_d{i}") for i in range(len(names))))).alias("_d", "n_pos")
    found = []
    if numeric:
        ranked = ranked if ranked is not None else _ranked_by_domain(counts_by_value(df, numeric, [domain]), names, domain)
        found.append(ranked.select("feature", "before", "n", each))
    if categorical:  # a value's score differs by domain, so ranks do
        per = [F.count_if(F.col(domain) == d).alias(f"_d{i}") for i, d in enumerate(names)]
        counted = to_long(df, categorical, [domain], "string").where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), *per)
        rated = counted.select("feature", "n", each).groupBy("feature", "_d", (F.col("n_pos") / F.col("n")).alias("s")).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
        found.append(value_ranks(rated, ["feature", "_d"], "s", "n").select("feature", "before", "n", "_d", "n_pos"))
    both = found[0].union(found[1]) if len(found) == 2 else found[0]
    return _auc(both.withColumn("feature", F.struct("feature", "_d"))).groupBy("feature.feature").agg(F.max("auc").alias("auc"))


def decide(measured: DataFrame) -> DataFrame:
    """feature, mi, relevance, auc, verdict: keep, drop, hold or unmeasured; the cut is the median relevance."""
    measured = materialise(measured, "relevance")  # a row for each feature, used twice
    cut = measured.where("auc is not null").agg(F.coalesce(F.median("relevance"), F.lit(0.0)).alias("cut")).first().cut
    high, useful = F.col("auc") > DOMAIN_HIGH, F.col("relevance") >= F.lit(cut)
    verdict = F.when(F.col("auc").isNull(), "unmeasured").when(high & ~useful, "drop").when(high & useful, "hold").otherwise("keep")
    return measured.select("feature", "mi", "relevance", "auc", verdict.alias("verdict"))


def analyse(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = "label_class", domain: str = "dataset", key: str = "uid") -> DataFrame:
    """Relevance and leakage of all features: numeric values are counted by label and domain in one shuffle and ranked once for both."""
    names, counted, ranked = domains(df, domain), None, None
    if numeric and len(names) > 1 and label != domain:
        each = counts_by_value(df, numeric, [label, domain])
        ranked = _ranked_by_domain(each, names, domain)
        counted = each.groupBy("feature", "value", label).agg(F.sum("n").alias("n"))
    information = mutual_information(df, numeric, categorical, label, key, BINS, counted, None if ranked is None else ranked.select("feature", "value", "n", "before"))
    return decide(information.join(worst_domain_auc(df, numeric, categorical, domain, names, ranked), "feature"))


def joint_domain_auc(df: DataFrame, numeric: Sequence[str], domain: str, sample: int = 200_000) -> float | None:
    """How separable domains are from all features at once: a logistic fit on at most about `sample` rows, in-sample."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    total = df.count()
    part = df.sample(False, min(1.0, sample / total), 0) if total > sample else df
    names = [r[0] for r in part.select(domain).distinct().orderBy(domain).limit(3).collect()]
    if total < 100 or len(names) != 2:
        return None
    data = part.select((F.col(domain) == names[1]).cast("double").alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric))
    data = VectorAssembler(inputCols=list(numeric), outputCol="raw").transform(data)
    data = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data).transform(data)
    return float(BinaryClassificationEvaluator().evaluate(LogisticRegression(maxIter=50).fit(data).transform(data)))
