"""Queries of vectorising, pools, fusion, confident learning, audit and corroboration, with their oracle SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import audit as a
from tributary.operators import confident as cl
from tributary.operators import fusion as fu
from tributary.operators import models as m
from tributary.operators import pools as po
from tributary.operators import validity
from tributary.operators import vectorise as v
from tributary.plans.feature_queries import _round
from tributary.plans.label_queries import _CHECKS, LABELLED_SQL, WINDOWS, _claims_sql, _labelled
from tributary.sources.flows import DIRTY_SQL, FLOWS_SQL, dirty_flows, epoch, flows
from tributary.sources.lake import read_table

FEATURES = v.flow_features()
POOLS = po.Partition("xdg-1", (("small", 0.02), ("large", 0.83), ("held", 0.15)))
CLASSES = ("benign", "ddos", "dos", "brute_force", "botnet")
SEED = "audit-7"


def vectorise_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = _round(v.matrix(flows(spark, d), FEATURES), 9)
    return m.select("uid", *(F.col(f"`{c}`") for c in MATRIX))


def one_hot(spark: SparkSession, d: str) -> DataFrame:
    m = v.matrix(flows(spark, d), FEATURES)
    return m.select("uid", *(F.col(f"`{c}`").alias(c.replace("=", "_")) for f in FEATURES.categorical for c in f.columns()))


def constraint_residuals(spark: SparkSession, d: str) -> DataFrame:
    return _round(v.residuals(flows(spark, d), FEATURES), 4)


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select("uid", "label_class", F.when(F.col("uid").cast("bigint") % 10 == 0, "out-of-space").when(F.col("uid").cast("bigint") % 7 != 0, "certain").alias("label_quality"))


def pool_assign(spark: SparkSession, d: str) -> DataFrame:
    return po.assign(_graded(spark, d), POOLS)


def pool_counts(spark: SparkSession, d: str) -> DataFrame:
    return po.counts(_graded(spark, d), POOLS)


def pool_sample(spark: SparkSession, d: str) -> DataFrame:
    return POOLS.rows(_graded(spark, d), "small").select("uid")


def branches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("uid").cast("bigint")
    of = lambda i: F.element_at(F.array(*map(F.lit, CLASSES)), (i % 5 + 1).cast("int"))
    f = flows(spark, d)
    first = f.select("uid", of(n).alias("label_class"), F.when(n % 17 != 0, n % 10 / F.lit(10.0)).alias("label_confidence"), (n % 7 / F.lit(7.0)).alias("label_margin"))
    second = f.where(n % 23 != 0).select("uid", of(n + F.when(n % 3 == 0, 1).otherwise(0)).alias("label_class"), (n % 8 / F.lit(10.0)).alias("label_confidence"), (n % 5 / F.lit(5.0)).alias("label_margin"))
    return first, second


def fuse_labels(spark: SparkSession, d: str) -> DataFrame:
    return fu.fuse(*branches(spark, d))


def fuse_explain(spark: SparkSession, d: str) -> DataFrame:
    return fu.explain(fu.decisions(*branches(spark, d)))


def fuse_confidence_deciles(spark: SparkSession, d: str) -> DataFrame:
    return _round(fu.confidences(fu.decisions(*branches(spark, d))), 9)


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    raw = [(n * (3 + 2 * i) % 11 + 1).cast("double") for i in range(3)]
    total = raw[0] + raw[1] + raw[2]
    return read_table(spark, d, "events").select(n.alias("key"), (n % 3).cast("int").alias("label"), F.array(*(r / total for r in raw)).alias("probs"))


def confident_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _round(cl.thresholds(probabilities(spark, d)), 12)


def confident_mad(spark: SparkSession, d: str) -> DataFrame:
    return _round(cl.scales(probabilities(spark, d)), 12)


def confident_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round(cl.weights(probabilities(spark, d)).select("key", "label", "score", "weight"), 9)


def confident_joint(spark: SparkSession, d: str) -> DataFrame:
    return _round(cl.soft_joint(probabilities(spark, d)), 6)


def confident_hard_joint(spark: SparkSession, d: str) -> DataFrame:
    return cl.hard_joint(probabilities(spark, d))


def balanced_retention(spark: SparkSession, d: str) -> DataFrame:
    return _round(cl.retention(cl.weights(probabilities(spark, d))), 9)


def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round(cl.balanced(cl.weights(probabilities(spark, d))).select("key", "weight"), 9)


def sce_loss(spark: SparkSession, d: str) -> DataFrame:
    return _round(cl.sce_loss(cl.weights(probabilities(spark, d))).select("key", "loss"), 9)


def confident_grid(spark: SparkSession, d: str) -> DataFrame:
    return _round(cl.grid(probabilities(spark, d)), 9)


def audit_candidates(spark: SparkSession, d: str) -> DataFrame:
    return a.candidates(flows(spark, d), SEED, 20).select("uid", "label_class", "bucket", "rank")


def audit_availability(spark: SparkSession, d: str) -> DataFrame:
    return a.availability(flows(spark, d))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("uid").cast("bigint")
    return flows(spark, d).where(n % 9 == 0).select("uid", F.col("label_class").alias("prior_class"), F.when(n % 4 == 0, F.lit("")).when(n % 6 == 0, "unknown").when(n % 5 == 0, "click").otherwise(F.col("label_class")).alias("analyst_class"))


def audit_state(spark: SparkSession, d: str) -> DataFrame:
    return a.state_counts(verdicts(spark, d))


def _method(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("uid").cast("bigint")
    return flows(spark, d).where(n % 11 != 0).select("uid", F.when(n % 13 == 0, "view").otherwise(F.col("label_class")).alias("label_class"))


def benchmark_recall(spark: SparkSession, d: str) -> DataFrame:
    return _round(a.recall(verdicts(spark, d), _method(spark, d)), 9)


def benchmark_confusion(spark: SparkSession, d: str) -> DataFrame:
    return a.confusion(verdicts(spark, d), _method(spark, d))


def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    first, second = branches(spark, d)
    return a.agreement({"a": first, "b": second, "fused": fuse_labels(spark, d)})


def alerts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    jitter = (e % 9 - 4) / F.lit(2.0)
    src, dst = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), F.concat(F.lit("192.168."), (e % 3).cast("string"), F.lit("."), (e % 20).cast("string"))
    flip = e % 2 == 0
    return read_table(spark, d, "events").where("event_type = 'error'").select((epoch(F.col("ts")) + jitter).alias("ts"), F.when(flip, dst).otherwise(src).alias("src_ip"), F.when(flip, src).otherwise(dst).alias("dest_ip"), F.concat(F.lit("sig-"), (e % 12).cast("string")).alias("signature"))


def corroborate_alerts(spark: SparkSession, d: str) -> DataFrame:
    return a.corroborate(_labelled(spark, d), alerts(spark, d)).select("uid", "label_binary", "alerts", "alerted", "signature")


def corroboration_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.corroboration_counts(a.corroborate(_labelled(spark, d), alerts(spark, d)))


def alert_signatures(spark: SparkSession, d: str) -> DataFrame:
    return a.top_signatures(a.corroborate(_labelled(spark, d), alerts(spark, d)))


def alert_dissent(spark: SparkSession, d: str) -> DataFrame:
    return a.dissent(a.corroborate(_labelled(spark, d), alerts(spark, d)))


def offset_probe(spark: SparkSession, d: str) -> DataFrame:
    return a.offset_probe(alerts(spark, d), WINDOWS)


def offset_verdict(spark: SparkSession, d: str) -> DataFrame:
    counts = {r.offset_hours: r.n for r in offset_probe(spark, d).collect()}
    best, sure = a.offset_verdict(counts, alerts(spark, d).count())
    return spark.createDataFrame([(best, sure)], "offset_hours int, conclusive boolean")


def clamp_counts(spark: SparkSession, d: str) -> DataFrame:
    return v.clamp_counts(dirty_flows(spark, d), FEATURES)


def audited_pool(spark: SparkSession, d: str) -> DataFrame:
    return po.audited(POOLS.rows(_graded(spark, d), "large"), verdicts(spark, d)).select("uid", "label_class")


#: A branch with whole weights: two features, a class each for their sum, their difference and neither.
SCORER = m.Branch(["benign", "ddos", "dos"], m.Network([np.array([[1.0, 2.0, 0.5], [1.0, -1.5, 0.25]])], [np.array([0.0, 0.125, 0.0625])]), m.Network([np.array([[1.0, 0.5], [0.0, 0.5]])], [np.array([0.0, 0.25])]), [])


def score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Class, confidence, margin and reconstruction error of every row, by the operator that scores with any branch."""
    n = F.col("event_id")
    rows = read_table(spark, d, "events").select(n.cast("string").alias("uid"), F.array((n % 7).cast("double") / 7, (n % 5).cast("double") / 5).alias("features"))
    return _round(m.predict(rows, SCORER), 9)


def excluded_rows(spark: SparkSession, d: str) -> DataFrame:
    return validity.excluded(dirty_flows(spark, d))


def adjudication_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What the alert log says beside each flow to audit, and what is said where there is none."""
    chosen = a.candidates(flows(spark, d), SEED, 20)
    with_log = a.adjudication_rows(chosen, alerts(spark, d)).select("uid", "oracle_alerted", "oracle_signature", "analyst_class", F.lit(True).alias("asked"))
    return with_log.union(a.adjudication_rows(chosen).select("uid", "oracle_alerted", "oracle_signature", "analyst_class", F.lit(False)))


def context_neighbours(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).select("uid", "ts", "capture", "orig_h", "resp_h")
    return a.neighbours(f, f.where(F.col("uid").cast("bigint") % 40 == 0), 86400.0 * 3, 3).select("candidate_uid", "uid", "ts", "rank")


_SQL_RAW = {
    "duration": "duration", "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes", "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts", "orig_ip_bytes": "orig_ip_bytes", "resp_ip_bytes": "resp_ip_bytes", "missed_bytes": "missed_bytes",
    "orig_rate": "orig_bytes / nullif(duration, 0)", "resp_rate": "resp_bytes / nullif(duration, 0)", "bytes_per_pkt_orig": "orig_bytes / nullif(orig_pkts, 0)", "bytes_per_pkt_resp": "resp_bytes / nullif(resp_pkts, 0)",
    "ratio_orig_resp": "(orig_bytes + 1.0::DOUBLE) / (resp_bytes + 1.0::DOUBLE)", "overhead_orig": "orig_ip_bytes - orig_bytes", "history_len": "coalesce(length(history), 0)::DOUBLE",
} | {f.name: f.expr.replace("'')), 0)", "'')), 0)::DOUBLE") for f in FEATURES.numeric if f.name.startswith("hist_")}
MATRIX = [c for c in FEATURES.columns() if "=" not in c]


def _encoded_sql() -> str:
    out = []
    for f in FEATURES.numeric:
        x = f"coalesce({_SQL_RAW[f.name]}, {float(f.missing)}::DOUBLE)"
        out.append(f"round({f'ln(1 + greatest({x}, 0))' if f.log else x}, 9) AS {f.name}")
        if f.indicator:
            out.append(f"CASE WHEN {_SQL_RAW[f.name]} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {f.name}__missing")
    return ", ".join(out)


def _one_hot_sql() -> str:
    out = []
    for f in FEATURES.categorical:
        x = f"CAST({f.name} AS VARCHAR)"
        out += [f"CASE WHEN {x} = '{w}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{f.name}_{w}\"" for w in f.vocabulary]
        words = ", ".join(f"'{w}'" for w in f.vocabulary)
        out.append(f"CASE WHEN coalesce({x} IN ({words}), false) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS \"{f.name}_{v.OTHER}\"")
    return ", ".join(out)


def _residual_sql() -> str:
    rows = []
    for c in FEATURES.constraints:
        t, left, right = (_SQL_RAW[x] for x in (c.target, c.left, c.right))
        off = f"({left}) / nullif({right}, 0) - ({t})" if c.kind == "ratio" else f"({left}) + ({right}) - ({t})"
        rows.append(f"SELECT '{c.name}' AS \"constraint\", count(o) AS n, round(avg(abs(o)), 4) AS mean_abs, round(avg(o * o), 4) AS mean_square, round(avg(ln(1 + abs(o)) ** 2), 4) AS mean_log_square FROM (SELECT {off} AS o FROM flows)")
    return " UNION ALL ".join(rows)


def _bucket_sql(seed: str, key: str = "uid") -> str:
    return f"CAST('0x' || substr(md5('{seed}' || {key}), 1, 15) AS BIGINT) % 1000000"


_GRADED = f"{FLOWS_SQL}, g AS (SELECT uid, label_class, CASE WHEN CAST(uid AS BIGINT) % 10 = 0 THEN 'out-of-space' WHEN CAST(uid AS BIGINT) % 7 <> 0 THEN 'certain' END AS label_quality, {_bucket_sql('xdg-1')} AS bucket FROM flows)"
_POOL = "CASE WHEN coalesce(label_quality, '') = 'out-of-space' THEN NULL WHEN bucket < 20000 THEN 'small' WHEN bucket < 850000 THEN 'large' ELSE 'held' END"
_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
_N = "CAST(uid AS BIGINT)"
_BRANCHES = f"""{FLOWS_SQL}, a AS (SELECT uid, ({_LIST})[{_N} % 5 + 1] AS label_class, CASE WHEN {_N} % 17 <> 0 THEN {_N} % 10 / 10.0::DOUBLE END AS label_confidence, {_N} % 7 / 7.0::DOUBLE AS label_margin FROM flows),
  b AS (SELECT uid, ({_LIST})[({_N} + CASE WHEN {_N} % 3 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS label_class, {_N} % 8 / 10.0::DOUBLE AS label_confidence, {_N} % 5 / 5.0::DOUBLE AS label_margin FROM flows WHERE {_N} % 23 <> 0),
  j AS (SELECT a.uid, a.label_class AS ac, b.label_class AS bc, a.label_confidence AS af, b.label_confidence AS bf, a.label_margin AS am, b.label_margin AS bm FROM a JOIN b ON a.uid = b.uid),
  dec AS (SELECT *, CASE WHEN ac = bc THEN 'agreed' WHEN af > bf THEN 'first-confidence' WHEN bf > af THEN 'second-confidence' WHEN am >= bm THEN 'first-margin' ELSE 'second-fallback' END AS decision FROM j),
  fused AS (SELECT uid, CASE WHEN decision IN ('agreed', 'first-confidence', 'first-margin') THEN ac ELSE bc END AS label_class, ac = bc AS branches_agreed, greatest(af, bf) AS label_confidence, greatest(am, bm) AS label_margin FROM dec)"""
_DEC = ", ".join(f"round(quantile_cont(c, {q}), 9) AS p{round(100 * q)}" for q in fu.DECILES)
_RAW = [f"CAST(event_id * {3 + 2 * i} % 11 + 1 AS DOUBLE)" for i in range(3)]
_PROBS = f"""t AS (SELECT event_id AS key, CAST(event_id % 3 AS INTEGER) AS label, {', '.join(f'{r} / ({_RAW[0]} + {_RAW[1]} + {_RAW[2]}) AS p{i}' for i, r in enumerate(_RAW))} FROM events),
  s AS (SELECT *, CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score FROM t),
  th AS (SELECT label, min(score) AS threshold FROM (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) AS r, count(*) OVER (PARTITION BY label) AS n FROM s) WHERE r >= ceil(0.7::DOUBLE * n) GROUP BY 1),
  sc AS (SELECT label, greatest(median(abs(score - m)), 1e-6) AS scale FROM (SELECT *, median(score) OVER (PARTITION BY label) AS m FROM s) GROUP BY 1),
  w AS (SELECT s.*, 0.2::DOUBLE + 0.8::DOUBLE / (1 + exp(-(score - threshold) / (4.0::DOUBLE * scale))) AS weight FROM s JOIN th ON s.label = th.label JOIN sc ON s.label = sc.label),
  joint AS (SELECT label, 0 AS k, sum(p0) AS mass FROM t GROUP BY 1 UNION ALL SELECT label, 1, sum(p1) FROM t GROUP BY 1 UNION ALL SELECT label, 2, sum(p2) FROM t GROUP BY 1),
  rho AS (SELECT label, sum(CASE WHEN k = label THEN mass END) / sum(mass) AS rho FROM joint GROUP BY 1),
  ret AS (SELECT rho.label, any_value(rho.rho) AS rho, any_value(rho.rho) * count(*) / greatest(sum(weight), 1e-6) AS factor FROM w JOIN rho ON w.label = rho.label GROUP BY rho.label)"""
_VERDICTS = f"""{FLOWS_SQL}, said AS (SELECT uid, label_class AS prior_class, CASE WHEN {_N} % 4 = 0 THEN '' WHEN {_N} % 6 = 0 THEN 'unknown' WHEN {_N} % 5 = 0 THEN 'click' ELSE label_class END AS analyst_class FROM flows WHERE {_N} % 9 = 0),
  method AS (SELECT uid, CASE WHEN {_N} % 13 = 0 THEN 'view' ELSE label_class END AS label_class FROM flows WHERE {_N} % 11 <> 0),
  conf AS (SELECT analyst_class AS truth, m.label_class AS predicted, count(*) AS n FROM said LEFT JOIN method m ON said.uid = m.uid WHERE analyst_class NOT IN ('', 'unknown') GROUP BY ALL)"""
_ALERTS = """alerts AS (SELECT epoch_us(ts) / 1000000.0::DOUBLE + (event_id % 9 - 4) / 2.0::DOUBLE AS ts, CASE WHEN event_id % 2 = 0 THEN d ELSE s END AS src_ip, CASE WHEN event_id % 2 = 0 THEN s ELSE d END AS dest_ip, concat('sig-', CAST(event_id % 12 AS VARCHAR)) AS signature
  FROM (SELECT *, concat('10.0.0.', CAST(user_id AS VARCHAR)) AS s, concat('192.168.', CAST(event_id % 3 AS VARCHAR), '.', CAST(event_id % 20 AS VARCHAR)) AS d FROM events WHERE event_type = 'error'))"""
_HITS = f"""{LABELLED_SQL}, {_ALERTS}, m AS (
  SELECT f.uid, a.signature FROM flows f JOIN alerts a ON a.src_ip = f.orig_h AND a.dest_ip = f.resp_h AND a.ts >= f.ts - 2.0 AND a.ts <= f.ts + coalesce(f.duration, 0) + 2.0
  UNION ALL SELECT f.uid, a.signature FROM flows f JOIN alerts a ON a.src_ip = f.resp_h AND a.dest_ip = f.orig_h AND a.ts >= f.ts - 2.0 AND a.ts <= f.ts + coalesce(f.duration, 0) + 2.0 AND f.orig_h <> f.resp_h),
  h AS (SELECT uid, count(*) AS alerts, min(signature) AS signature FROM m GROUP BY 1),
  c AS (SELECT l.uid, l.ts, l.label_binary, coalesce(h.alerts, 0) AS alerts, coalesce(h.alerts, 0) > 0 AS alerted, h.signature FROM labelled l LEFT JOIN h ON l.uid = h.uid)"""
_PAIR_AGREE = lambda x, y, nx, ny: f"SELECT '{nx}' AS first, '{ny}' AS second, count(*) AS shared, count(*) FILTER (x.label_class = y.label_class) AS agreed FROM {x} x JOIN {y} y ON x.uid = y.uid"

SQL = {
    "clamp_counts": f"WITH {DIRTY_SQL} " + " UNION ALL ".join(f"SELECT '{f.name}' AS feature, {f'count(*) FILTER ({_SQL_RAW[f.name]} < 0)' if f.log else 'CAST(0 AS BIGINT)'} AS n_clamped FROM dirty{'' if f.log else ' LIMIT 1'}".replace("FROM dirty LIMIT 1", "FROM (SELECT 1)") for f in FEATURES.numeric),
    "audited_pool": f"WITH {_VERDICTS}, g AS (SELECT uid, {_bucket_sql('xdg-1')} AS bucket FROM flows WHERE {_N} % 10 <> 0) SELECT g.uid, analyst_class AS label_class FROM g JOIN said ON g.uid = said.uid WHERE bucket >= 20000 AND bucket < 850000 AND analyst_class NOT IN ('', 'unknown')",
    "score_rows": """WITH x AS (SELECT CAST(event_id AS VARCHAR) AS uid, (event_id % 7)::DOUBLE / 7 AS a, (event_id % 5)::DOUBLE / 5 AS b FROM events),
      z AS (SELECT *, exp(a + b) AS z0, exp(2 * a - 1.5::DOUBLE * b + 0.125::DOUBLE) AS z1, exp(0.5::DOUBLE * a + 0.25::DOUBLE * b + 0.0625::DOUBLE) AS z2 FROM x), p AS (SELECT *, z0 / (z0 + z1 + z2) AS p0, z1 / (z0 + z1 + z2) AS p1, z2 / (z0 + z1 + z2) AS p2 FROM z)
      SELECT uid, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'benign' WHEN p1 >= p2 THEN 'ddos' ELSE 'dos' END AS label_class, round(greatest(p0, p1, p2), 9) AS label_confidence, round(greatest(p0, p1, p2) - (list_sort([p0, p1, p2]))[2], 9) AS label_margin, round(((a - a) ** 2 + (0.5::DOUBLE * a + 0.5::DOUBLE * b + 0.25::DOUBLE - b) ** 2) / 2, 9) AS recon_error FROM p""",
    "adjudication_evidence": f"""{_HITS}, b AS (SELECT uid, {_bucket_sql(SEED)} AS bucket, label_class FROM flows), chosen AS (SELECT uid FROM b QUALIFY row_number() OVER (PARTITION BY label_class ORDER BY bucket, uid) <= 20)
      SELECT uid, alerted AS oracle_alerted, signature AS oracle_signature, CAST(NULL AS VARCHAR) AS analyst_class, true AS asked FROM c JOIN chosen USING (uid) UNION ALL SELECT uid, CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false FROM chosen""",
    "offset_verdict": f"""WITH {_ALERTS}, o AS (SELECT unnest([0, -1, -2, -3, -4, -5]) AS offset_hours), flows AS (SELECT CAST(row_number() OVER () AS VARCHAR) AS uid, ts + offset_hours * 3600.0::DOUBLE AS ts, src_ip AS orig_h, dest_ip AS resp_h, offset_hours FROM alerts, o),
      hits AS (SELECT DISTINCT uid FROM ({' UNION ALL '.join(map(_claims_sql, WINDOWS))})), n AS (SELECT offset_hours, count(hits.uid) AS n FROM flows LEFT JOIN hits ON flows.uid = hits.uid GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, abs(offset_hours)) AS r FROM n)
      SELECT CAST(CASE WHEN a.n > 0 THEN a.offset_hours END AS INTEGER) AS offset_hours, a.n > 0 AND (SELECT count(*) FROM alerts) >= 20 AND a.n >= 1.5 * b.n AS conclusive FROM r a, r b WHERE a.r = 1 AND b.r = 2""",
    "excluded_rows": f"WITH {DIRTY_SQL} SELECT count(*) FILTER (NOT (" + " AND ".join(f"coalesce({p}, true)" for p in _CHECKS.values()) + ")) AS excluded, count(*) AS total FROM dirty",
    "vectorise_matrix": f"WITH {FLOWS_SQL} SELECT uid, {_encoded_sql()} FROM flows",
    "one_hot": f"WITH {FLOWS_SQL} SELECT uid, {_one_hot_sql()} FROM flows",
    "constraint_residuals": f"WITH {FLOWS_SQL} {_residual_sql()}",
    "pool_assign": f"WITH {_GRADED} SELECT uid, label_class, label_quality, bucket, {_POOL} AS pool FROM g",
    "pool_counts": f"WITH {_GRADED} SELECT {_POOL} AS pool, label_class, count(*) AS n FROM g WHERE ({_POOL}) IS NOT NULL GROUP BY 1, 2",
    "pool_sample": f"WITH {_GRADED} SELECT uid FROM g WHERE bucket < 20000 AND coalesce(label_quality, '') <> 'out-of-space'",
    "fuse_labels": f"WITH {_BRANCHES} SELECT * FROM fused",
    "fuse_explain": f"WITH {_BRANCHES} SELECT decision, CASE WHEN decision IN ('first-margin', 'second-fallback') THEN CASE WHEN af IS NULL OR bf IS NULL THEN 'null-confidence' ELSE 'tied' END END AS margin_cause, ac AS first_class, bc AS second_class, count(*) AS n FROM dec GROUP BY ALL",
    "fuse_confidence_deciles": f"WITH {_BRANCHES}, l AS (SELECT 'first' AS branch, ac AS class, af AS c FROM dec UNION ALL SELECT 'second', bc, bf FROM dec) SELECT branch, class, count(*) AS n, round(avg(c), 9) AS mean, {_DEC} FROM l WHERE c IS NOT NULL GROUP BY 1, 2",
    "confident_thresholds": f"WITH {_PROBS} SELECT label, round(threshold, 12) AS threshold FROM th",
    "confident_mad": f"WITH {_PROBS} SELECT label, round(scale, 12) AS scale FROM sc",
    "confident_weights": f"WITH {_PROBS} SELECT key, label, round(score, 9) AS score, round(weight, 9) AS weight FROM w",
    "confident_joint": f"WITH {_PROBS} SELECT label, k, round(mass, 6) AS mass FROM joint",
    "confident_hard_joint": f"""WITH {_PROBS}, me AS (SELECT label, avg(score) AS mean FROM s GROUP BY 1), l AS (SELECT key, label, 0 AS k, p0 AS p FROM t UNION ALL SELECT key, label, 1, p1 FROM t UNION ALL SELECT key, label, 2, p2 FROM t),
      b AS (SELECT l.key, l.label, l.k FROM l JOIN me ON l.k = me.label WHERE p >= mean QUALIFY row_number() OVER (PARTITION BY key ORDER BY p DESC, k) = 1) SELECT label, k, count(*) AS n FROM b GROUP BY 1, 2""",
    "balanced_retention": f"WITH {_PROBS} SELECT label, round(rho, 9) AS rho, round(factor, 9) AS factor FROM ret",
    "balanced_weights": f"WITH {_PROBS} SELECT key, round(greatest(0.2::DOUBLE, least(1.0::DOUBLE, weight * factor)), 9) AS weight FROM w JOIN ret ON w.label = ret.label",
    "sce_loss": f"WITH {_PROBS} SELECT key, round(weight * (-0.3::DOUBLE * ({' + '.join(f'(CASE WHEN label = {i} THEN 0.99::DOUBLE ELSE 0.005::DOUBLE END) * ln(p{i})' for i in range(3))}) - 2.0::DOUBLE * ({' + '.join(f'p{i} * ln(CASE WHEN label = {i} THEN 0.99::DOUBLE ELSE 0.005::DOUBLE END)' for i in range(3))})), 9) AS loss FROM w",
    "confident_grid": f"""WITH {_PROBS}, cells(q, w_min, gamma) AS (VALUES {', '.join(f'({q}::DOUBLE, {w}::DOUBLE, {g}::DOUBLE)' for q, w, g in cl.GRID)}), o AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) AS r, count(*) OVER (PARTITION BY label) AS n FROM s),
      tq AS (SELECT q, label, min(score) AS threshold FROM o, (SELECT DISTINCT q FROM cells) WHERE r >= ceil(q * n) GROUP BY 1, 2),
      b AS (SELECT c.q, c.w_min, c.gamma, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = s.label AS hit, c.w_min + (1 - c.w_min) / (1 + exp(-(s.score - threshold) / (c.gamma * scale))) AS w FROM s JOIN tq ON s.label = tq.label JOIN sc ON s.label = sc.label JOIN cells c ON c.q = tq.q)
      SELECT q, w_min, gamma, round(coalesce(avg(w) FILTER (hit), 0) - coalesce(avg(w) FILTER (NOT hit), 0), 9) AS objective FROM b GROUP BY 1, 2, 3""",
    "audit_candidates": f"WITH {FLOWS_SQL}, b AS (SELECT uid, label_class, {_bucket_sql(SEED)} AS bucket FROM flows) SELECT uid, label_class, bucket, CAST(row_number() OVER (PARTITION BY label_class ORDER BY bucket, uid) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY label_class ORDER BY bucket, uid) <= 20",
    "audit_availability": f"WITH {FLOWS_SQL} SELECT label_class, count(*) AS available, least(count(*), 200) AS taken, 200 - least(count(*), 200) AS shortfall FROM flows GROUP BY 1",
    "audit_state": f"WITH {_VERDICTS} SELECT CASE WHEN analyst_class IS NULL OR analyst_class = '' THEN 'unadjudicated' WHEN analyst_class = prior_class THEN 'confirmed' ELSE 'corrected' END AS state, count(*) AS n FROM said GROUP BY 1",
    "benchmark_confusion": f"WITH {_VERDICTS} SELECT * FROM conf",
    "benchmark_recall": f"WITH {_VERDICTS} SELECT truth, CAST(sum(n) AS BIGINT) AS audited, CAST(coalesce(sum(n) FILTER (truth = predicted), 0) AS BIGINT) AS correct, round(coalesce(sum(n) FILTER (truth = predicted), 0) / sum(n), 9) AS recall, sum(n) < 30 AS thin FROM conf GROUP BY 1",
    "pairwise_agreement": f"WITH {_BRANCHES} {_PAIR_AGREE('a', 'b', 'a', 'b')} UNION ALL {_PAIR_AGREE('a', 'fused', 'a', 'fused')} UNION ALL {_PAIR_AGREE('b', 'fused', 'b', 'fused')}",
    "corroborate_alerts": f"{_HITS} SELECT uid, label_binary, alerts, alerted, signature FROM c",
    "corroboration_counts": f"{_HITS} SELECT count(*) FILTER (label_binary) AS attack_flows, count(*) FILTER (label_binary AND alerted) AS attack_corroborated, count(*) FILTER (NOT label_binary) AS benign_flows, count(*) FILTER (NOT label_binary AND alerted) AS benign_alerted, count(*) FILTER (alerted) AS flows_alerted FROM c",
    "alert_signatures": f"{_HITS} SELECT signature, count(*) AS n FROM c WHERE alerted GROUP BY 1 ORDER BY n DESC, signature LIMIT 10",
    "alert_dissent": f"{_HITS} SELECT uid, ts, signature FROM c WHERE alerted AND NOT label_binary ORDER BY ts, uid LIMIT 5",
    "offset_probe": f"""WITH {_ALERTS}, o AS (SELECT unnest([0, -1, -2, -3, -4, -5]) AS offset_hours), flows AS (SELECT CAST(row_number() OVER () AS VARCHAR) AS uid, ts + offset_hours * 3600.0::DOUBLE AS ts, src_ip AS orig_h, dest_ip AS resp_h, offset_hours FROM alerts, o),
      hits AS (SELECT DISTINCT uid FROM ({' UNION ALL '.join(map(_claims_sql, WINDOWS))})) SELECT CAST(offset_hours AS INTEGER) AS offset_hours, count(hits.uid) AS n FROM flows LEFT JOIN hits ON flows.uid = hits.uid GROUP BY 1""",
    "context_neighbours": f"""WITH {FLOWS_SQL}, m AS (SELECT c.uid AS candidate_uid, f.uid, f.ts, abs(f.ts - c.ts) AS d FROM flows c JOIN flows f ON c.capture = f.capture AND ((c.orig_h = f.orig_h AND c.resp_h = f.resp_h) OR (c.orig_h = f.resp_h AND c.resp_h = f.orig_h)) AND f.uid <> c.uid AND abs(f.ts - c.ts) <= 259200.0 WHERE CAST(c.uid AS BIGINT) % 40 = 0)
      SELECT candidate_uid, uid, ts, CAST(row_number() OVER (PARTITION BY candidate_uid ORDER BY d, uid) AS INTEGER) AS rank FROM m QUALIFY row_number() OVER (PARTITION BY candidate_uid ORDER BY d, uid) <= 3""",
}

QUERIES = (
    vectorise_matrix, one_hot, constraint_residuals, pool_assign, pool_counts, pool_sample, fuse_labels, fuse_explain, fuse_confidence_deciles, confident_thresholds, confident_mad, confident_weights, confident_joint,
    confident_hard_joint, balanced_retention, balanced_weights, sce_loss, confident_grid, audit_candidates, audit_availability, audit_state, benchmark_recall, benchmark_confusion, pairwise_agreement, corroborate_alerts,
    corroboration_counts, alert_signatures, alert_dissent, offset_probe, context_neighbours, offset_verdict, clamp_counts, audited_pool, score_rows, excluded_rows, adjudication_evidence,
)
