"""Fusing two branches' labels by agreement, confidence, then margin; and which of these decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.ranks import count_values, order_statistics, value_ranks

AGREED, FIRST_CONFIDENCE, SECOND_CONFIDENCE, FIRST_MARGIN, SECOND_FALLBACK = "agreed", "first-confidence", "second-confidence", "first-margin", "second-fallback"
DECILES = tuple(i / 10 for i in range(1, 10))


def _ladder(values: tuple) -> Column:
    """The rule's lines in order; a null comparison decides nothing. The first branch takes an exact tie."""
    a, b = (lambda c: F.col(f"first_{c}")), (lambda c: F.col(f"second_{c}"))
    return (
        F.when(a("class") == b("class"), values[0]).when(a("confidence") > b("confidence"), values[1]).when(b("confidence") > a("confidence"), values[2])
        .when(a("margin") >= b("margin"), values[3]).otherwise(values[4])
    )


def joined(first: DataFrame, second: DataFrame, key: str = "uid") -> DataFrame:
    """Both branches' class, confidence and margin of the flows that both label."""
    side = lambda df, n: df.select(key, *(F.col(f"label_{c}").alias(f"{n}_{c}") for c in ("class", "confidence", "margin")))
    return side(first, "first").join(side(second, "second"), key)


def decisions(first: DataFrame, second: DataFrame, key: str = "uid") -> DataFrame:
    """The decision for each flow, and why a margin had to decide: a tie, or a missing confidence."""
    missing = F.col("first_confidence").isNull() | F.col("second_confidence").isNull()
    decision = _ladder((AGREED, FIRST_CONFIDENCE, SECOND_CONFIDENCE, FIRST_MARGIN, SECOND_FALLBACK))
    return joined(first, second, key).withColumns({"decision": decision, "margin_cause": F.when(missing, "null-confidence").otherwise("tied")})


def fuse(first: DataFrame, second: DataFrame, key: str = "uid") -> DataFrame:
    """key, label_class, branches_agreed, label_confidence, label_margin."""
    a, b = F.col("first_class"), F.col("second_class")
    return joined(first, second, key).select(
        key, _ladder((a, a, b, a, b)).alias("label_class"), (a == b).alias("branches_agreed"),
        F.greatest("first_confidence", "second_confidence").alias("label_confidence"), F.greatest("first_margin", "second_margin").alias("label_margin"),
    )


def explain(decided: DataFrame) -> DataFrame:
    """decision, margin_cause (of margin decisions), first_class, second_class, n."""
    cause = F.when(F.col("decision").isin(FIRST_MARGIN, SECOND_FALLBACK), F.col("margin_cause"))
    return decided.groupBy("decision", cause.alias("margin_cause"), "first_class", "second_class").agg(F.count(F.lit(1)).alias("n"))


def confidences(decided: DataFrame) -> DataFrame:
    """branch, class, n, mean and deciles of each branch's confidence."""
    sides = F.array(*(F.struct(F.lit(s).alias("branch"), F.col(f"{s}_class").alias("class"), F.col(f"{s}_confidence").alias("c")) for s in ("first", "second")))
    long = decided.select(F.inline(sides)).where("c is not null")
    ranked = value_ranks(count_values(long, ["branch", "class"], "c"), ["branch", "class"], "value", "n")
    sums = ranked.groupBy("branch", "class").agg(F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    tenths = order_statistics(ranked, ["branch", "class"], DECILES).groupBy(F.col("branch").alias("_b"), F.col("class").alias("_c")).agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("q"))
    out = sums.join(F.broadcast(tenths), (F.col("branch") == F.col("_b")) & F.col("class").eqNullSafe(F.col("_c")))
    return out.select("branch", "class", "n", "mean", *(F.try_element_at("q", F.lit(i)).alias(f"p{10 * (i + 1)}") for i in range(9)))


def refuse_unknown_classes(labelled: DataFrame, space: set[str]) -> None:
    """All classes are looked at; the message names ten of those that are beyond the space."""
    beyond = labelled.select("label_class").distinct().where(F.col("label_class").isNull() | ~F.col("label_class").isin(*space, ""))
    found = [str(r[0]) for r in beyond.orderBy("label_class").limit(10).collect()]
    if found:
        raise ValueError(f"classes outside the label space: {found}")


def refuse_duplicates(df: DataFrame, key: str = "uid") -> None:
    twice = [r[0] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"{key} is not unique: {', '.join(map(str, twice))}")
