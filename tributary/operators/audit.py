"""Human audit: a reproducible sample per class, verdicts, recall per class, agreement of methods; alerts and neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.exprs import bucket_of, count_where

FLOOR, CAP, THIN = 200, 2_000, 30
TOLERANCE, CONTEXT_SECONDS, CONTEXT_LIMIT = 2.0, 600.0, 20
#: Seconds of the shortest time buckets, and how many lengths there are, each four times the last; the longest has no end.
FINEST, LEVELS = 8.0, 11
OFFSETS, MIN_ALERTS, MARGIN = (0, -1, -2, -3, -4, -5), 20, 1.5


def candidates(labelled: DataFrame, seed: str, floor: int = FLOOR, buckets: int = 1_000_000) -> DataFrame:
    """The `floor` rows of each class with the lowest buckets (then uid)."""
    keyed = labelled.withColumn("bucket", bucket_of(seed, F.col("uid"), buckets))
    rank = F.row_number().over(Window.partitionBy("label_class").orderBy("bucket", "uid"))
    return keyed.withColumn("rank", rank).where(F.col("rank") <= floor)


def availability(labelled: DataFrame, floor: int = FLOOR, cap: int = CAP) -> DataFrame:
    """label_class, available, taken, shortfall; more than `cap` rows in all are refused."""
    out = labelled.groupBy("label_class").agg(F.count(F.lit(1)).alias("available"))
    out = out.withColumn("taken", F.least("available", F.lit(floor))).withColumn("shortfall", F.lit(floor) - F.col("taken"))
    total = out.agg(F.sum("taken")).first()[0] or 0
    if total > cap:
        raise ValueError(f"{total} rows to audit exceed the cap of {cap}")
    return out


def usable(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("analyst_class is not null and analyst_class not in ('', 'unknown')")


def states(verdicts: DataFrame) -> DataFrame:
    """verdicts with state: unadjudicated, confirmed or corrected against the prior class."""
    unsaid = F.col("analyst_class").isNull() | (F.col("analyst_class") == "")
    return verdicts.withColumn("state", F.when(unsaid, "unadjudicated").when(F.col("analyst_class") == F.col("prior_class"), "confirmed").otherwise("corrected"))


def state_counts(verdicts: DataFrame) -> DataFrame:
    return states(verdicts).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def confusion(verdicts: DataFrame, method: DataFrame) -> DataFrame:
    """truth, predicted (null: the method has no such flow), n."""
    said = usable(verdicts).select("uid", F.col("analyst_class").alias("truth"))
    return said.join(method.select("uid", F.col("label_class").alias("predicted")), "uid", "left").groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def recall(verdicts: DataFrame, method: DataFrame) -> DataFrame:
    """truth, audited, correct, recall, thin. No figure over all classes: it would say how the sample was drawn."""
    g = confusion(verdicts, method).groupBy("truth").agg(F.sum("n").alias("audited"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("correct"))
    return g.select("truth", "audited", "correct", (F.col("correct") / F.col("audited")).alias("recall"), (F.col("audited") < THIN).alias("thin"))


def agreement(methods: dict[str, DataFrame]) -> DataFrame:
    """first, second, shared, agreed for each pair of methods: one aggregate over all labels by flow."""
    long = None
    for name, df in methods.items():
        part = df.select("uid", F.lit(name).alias("method"), "label_class")
        long = part if long is None else long.union(part)
    wide = long.groupBy("uid").pivot("method", list(methods)).agg(F.min("label_class"))
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), count_where(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("shared"), count_where(F.col(a) == F.col(b)).alias("agreed")) for a, b in combinations(methods, 2)]
    return wide.agg(F.array(*pairs).alias("r")).select(F.inline("r"))


def _pair(a: str, b: str) -> tuple:
    """Two hosts in a fixed order; null where either is, as F.least would name one host twice."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, F.least(a, b)).alias("_a"), F.when(both, F.greatest(a, b)).alias("_b")


def _directed(flows: DataFrame, alerts: DataFrame, columns: Sequence[str], start, end) -> DataFrame:
    """Flow-alert pairs of the same two hosts in either order, alert inside [start, end].

    The equi-join is on the ordered pair and a time bucket, so a host pair that floods for days is many keys. A flow's
    level is the first whose buckets are as long as its span, so it lies in two at most; an alert goes into one bucket of
    each level. A pair meets once, as the alert has one bucket of the flow's level.
    """
    f = flows.select(*columns, *_pair("orig_h", "resp_h"), start.alias("_from"), end.alias("_to"))
    wide, level = F.lit(float("inf")), F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        fits = F.col("_to") - F.col("_from") <= FINEST * 4.0**k
        wide, level = F.when(fits, F.lit(FINEST * 4.0**k)).otherwise(wide), F.when(fits, F.lit(k)).otherwise(level)
    at = lambda t, w: F.floor(t / w)
    f = f.withColumn("_level", level).withColumn("_slot", F.explode(F.array_distinct(F.array(at(F.col("_from"), wide), at(F.col("_to"), wide)))))
    places = F.array(*(F.struct(F.lit(k).alias("_level"), at(F.col("ts"), F.lit(FINEST * 4.0**k if k < LEVELS - 1 else float("inf"))).alias("_slot")) for k in range(LEVELS)))
    a = alerts.select(*_pair("src_ip", "dest_ip"), F.col("ts").alias("alert_ts"), "signature", F.inline(places))
    return f.join(a, ["_a", "_b", "_level", "_slot"]).where((F.col("alert_ts") >= F.col("_from")) & (F.col("alert_ts") <= F.col("_to")))


def corroborate(labelled: DataFrame, alerts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """labelled's uid, label_binary, label_class with alerts (number), alerted and one signature (the smallest)."""
    start, end = F.col("ts") - tolerance, F.col("ts") + F.coalesce("duration", F.lit(0.0)) + tolerance
    hit = _directed(labelled, alerts, ["uid"], start, end).groupBy("uid").agg(F.count(F.lit(1)).alias("alerts"), F.min("signature").alias("signature"))
    out = labelled.select("uid", "ts", "orig_h", "resp_h", "label_binary", "label_class").join(hit, "uid", "left")
    return out.withColumn("alerts", F.coalesce("alerts", F.lit(0))).withColumn("alerted", F.col("alerts") > 0)


def corroboration_counts(hits: DataFrame) -> DataFrame:
    """attack_flows, attack_corroborated, benign_flows, benign_alerted, flows_alerted."""
    attack, alerted = F.col("label_binary"), F.col("alerted")
    return hits.agg(count_where(attack).alias("attack_flows"), count_where(attack & alerted).alias("attack_corroborated"), count_where(~attack).alias("benign_flows"), count_where(~attack & alerted).alias("benign_alerted"), count_where(alerted).alias("flows_alerted"))


def top_signatures(hits: DataFrame, k: int = 10) -> DataFrame:
    return hits.where("alerted").groupBy("signature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(k)


def dissent(hits: DataFrame, k: int = 5) -> DataFrame:
    return hits.where("alerted and not label_binary").select("uid", "ts", "signature").orderBy("ts", "uid").limit(k)


def offset_probe(alerts: DataFrame, windows: Sequence, offsets: Sequence[int] = OFFSETS) -> DataFrame:
    """offset_hours, n: alerts that fall in a declared window if their clock is that many hours off."""
    from tributary.operators.schedule import claims

    shifted = alerts.select("ts", F.col("src_ip").alias("orig_h"), F.col("dest_ip").alias("resp_h"), F.explode(F.array(*(F.lit(o) for o in offsets))).alias("offset_hours"))
    shifted = shifted.withColumn("ts", F.col("ts") + F.col("offset_hours") * 3600.0)
    hit = F.greatest(*(claims(w) for w in windows), F.lit(False))
    return shifted.groupBy("offset_hours").agg(count_where(hit).alias("n"))


def offset_verdict(counts: dict[int, int], alerts: int) -> tuple[int | None, bool]:
    """The best offset, and whether it stands out enough to be believed."""
    ranked = sorted(counts.items(), key=lambda x: (-x[1], abs(x[0])))
    if not ranked or not ranked[0][1]:
        return None, False
    second = ranked[1][1] if len(ranked) > 1 else 0
    return ranked[0][0], alerts >= MIN_ALERTS and ranked[0][1] >= MARGIN * second


def neighbours(flows: DataFrame, chosen: DataFrame, window: float = CONTEXT_SECONDS, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """The flows of the same capture and two hosts nearest in time to each chosen one.

    Time goes in buckets as long as the window: a chosen flow looks into its own and the two beside it.
    """
    pair, slot = _pair("orig_h", "resp_h"), F.floor(F.col("ts") / float(window))
    c = chosen.select(F.col("uid").alias("candidate_uid"), F.col("ts").alias("candidate_ts"), "capture", *pair, F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot"))
    f = flows.select("*", *pair, slot.alias("_slot"))
    near = F.abs(F.col("ts") - F.col("candidate_ts"))
    met = f.join(F.broadcast(c) if chosen.limit(CAP + 1).count() <= CAP else c, ["capture", "_a", "_b", "_slot"]).where((near <= window) & (F.col("uid") != F.col("candidate_uid")))
    rank = F.row_number().over(Window.partitionBy("candidate_uid").orderBy(near, "uid"))
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).drop("_a", "_b", "_slot", "candidate_ts")


def adjudication_rows(candidates: DataFrame, alerts: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """candidates with oracle_alerted, oracle_signature and the two columns that an analyst fills in.

    Without an alert log the evidence is null, as nothing was asked; with one, a flow without alerts says false.
    """
    if alerts is None:
        out = candidates.withColumns({"oracle_alerted": F.lit(None).cast("boolean"), "oracle_signature": F.lit(None).cast("string")})
    else:
        start, end = F.col("ts") - tolerance, F.col("ts") + F.coalesce("duration", F.lit(0.0)) + tolerance
        hit = _directed(candidates, alerts, ["uid"], start, end).groupBy("uid").agg(F.lit(True).alias("_hit"), F.min("signature").alias("oracle_signature"))
        out = candidates.join(hit, "uid", "left").withColumn("oracle_alerted", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return out.withColumns({"analyst_class": F.lit(None).cast("string"), "analyst_note": F.lit(None).cast("string")})
