"""Queries of schedule labelling and row validity, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import schedule as s
from tributary.operators import validity as v
from tributary.sources.flows import DIRTY_SQL, FLOWS_SQL, dirty_flows, flows
from tributary.sources.lake import read_table

VICTIMS = ("192.168.0.3", "192.168.2.5")
ATTACKERS = ("10.0.0.1", "10.0.0.2", "10.0.0.3")
WINDOWS = (
    s.Window(0, "Flood", "ddos", 1704412800.0, 1704844800.0, ATTACKERS, VICTIMS, needs_payload=True),
    s.Window(1, "Reflection", "dos", 1704412800.0, 1705276800.0, None, VICTIMS, needs_payload=True),
    s.Window(2, "Sweep", "portscan", 1704412800.0, 1705276800.0, ATTACKERS, None, "192.168.1."),
)
REGIONS = (s.Window(0, "Outage", "capture-gap", 1704844800.0, 1705276800.0, None, ("192.168.0.3", "192.168.1.4")),)
EXCLUDED = {"portscan": "single-domain"}


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return s.label(flows(spark, d), WINDOWS, REGIONS, EXCLUDED)


def schedule_label(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("uid", "label_binary", "label_class", "label_source", "rule", "rules_matched", "label_executed")


def quarantine_quality(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("uid", "label_class", "label_quality", "quarantine_reason")


def schedule_summary(spark: SparkSession, d: str) -> DataFrame:
    return s.summary(_labelled(spark, d)).select("label_class", "rule", "n", "overlaps", "executed", "attempted")


def rule_breadth(spark: SparkSession, d: str) -> DataFrame:
    return s.breadth(_labelled(spark, d))


def benign_bursts(spark: SparkSession, d: str) -> DataFrame:
    return s.bursts(_labelled(spark, d), WINDOWS)


def validity_counts(spark: SparkSession, d: str) -> DataFrame:
    return v.violations(dirty_flows(spark, d))


def validity_filter(spark: SparkSession, d: str) -> DataFrame:
    return v.valid_rows(dirty_flows(spark, d)).select("uid", "orig_bytes", "duration")


def nonfinite_counts(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "events").select(F.when(F.col("event_id") % 50 == 0, float("nan")).when(F.col("event_id") % 70 == 0, float("inf")).otherwise(F.col("value")).alias("value"), F.col("value").alias("plain"))
    return v.non_finite(df)


def letter_alphabet(spark: SparkSession, d: str) -> DataFrame:
    return v.alphabet(flows(spark, d), "history")


def _claims_sql(w: s.Window) -> str:
    q = lambda xs: ", ".join(f"'{x}'" for x in xs)
    vic = lambda h: f"({h} IN ({q(w.victims)}))" if w.victims else f"starts_with({h}, '{w.subnet_prefix}')" if w.subnet_prefix else "true"
    if w.attackers:
        ends = f"(orig_h IN ({q(w.attackers)}) AND {vic('resp_h')}) OR (resp_h IN ({q(w.attackers)}) AND {vic('orig_h')})"
    else:
        ends = f"orig_h IN ({q(w.victims)}) OR resp_h IN ({q(w.victims)})"
    return f"SELECT uid, {w.rid} AS rid FROM flows WHERE ts >= {w.t0} AND ts < {w.t1} AND ({ends})"


_RULES = "rules(rid, rule, kind, needs) AS (VALUES " + ", ".join(f"({w.rid}, '{w.name}', '{w.kind}', {str(w.needs_payload).lower()})" for w in WINDOWS) + ")"
LABELLED_SQL = f"""WITH {FLOWS_SQL}, {_RULES},
hits AS ({' UNION ALL '.join(map(_claims_sql, WINDOWS))}), won AS (SELECT uid, min(rid) AS rid, count(*) AS nrules FROM hits GROUP BY uid),
region AS (SELECT DISTINCT uid FROM ({_claims_sql(REGIONS[0])})),
labelled AS (SELECT f.* EXCLUDE (label_class), w.rid, w.rid IS NOT NULL AS label_binary, coalesce(r.kind, 'benign') AS label_class,
  CASE WHEN w.rid IS NOT NULL THEN 'matched' ELSE 'closed-world' END AS label_source, r.rule, coalesce(w.nrules, 0) AS rules_matched,
  CASE WHEN w.rid IS NULL THEN NULL WHEN NOT r.needs THEN true WHEN orig_bytes IS NULL THEN NULL ELSE orig_bytes > 0 END AS label_executed,
  CASE WHEN r.kind = 'portscan' THEN 'out-of-space' WHEN q.uid IS NOT NULL THEN 'uncertain' ELSE 'certain' END AS label_quality,
  coalesce(CASE WHEN q.uid IS NOT NULL THEN 'capture-gap' END, CASE WHEN r.kind = 'portscan' THEN 'single-domain' END) AS quarantine_reason
  FROM flows f LEFT JOIN won w ON f.uid = w.uid LEFT JOIN rules r ON w.rid = r.rid LEFT JOIN region q ON f.uid = q.uid)"""

_CHECKS = {
    "non_negative_orig_bytes": "orig_bytes >= 0",
    "non_negative_resp_bytes": "resp_bytes >= 0",
    "non_negative_duration": "duration >= 0",
    "orig_ip_bytes_cover_payload": "orig_ip_bytes >= orig_bytes",
    "resp_ip_bytes_cover_payload": "resp_ip_bytes >= resp_bytes",
    "orig_bytes_need_packets": "NOT (orig_bytes > 0 AND orig_pkts = 0)",
    "resp_bytes_need_packets": "NOT (resp_bytes > 0 AND resp_pkts = 0)",
    "orig_rate_below_line_rate": "NOT coalesce(duration > 0 AND orig_bytes / nullif(duration, 0) > 1.25e10, false)",
}

SQL = {
    "schedule_label": LABELLED_SQL + " SELECT uid, label_binary, label_class, label_source, rule, rules_matched, label_executed FROM labelled",
    "quarantine_quality": LABELLED_SQL + " SELECT uid, label_class, label_quality, quarantine_reason FROM labelled",
    "schedule_summary": LABELLED_SQL + " SELECT label_class, rule, count(*) AS n, count(*) FILTER (rules_matched > 1) AS overlaps, count(*) FILTER (label_executed) AS executed, count(*) FILTER (NOT label_executed) AS attempted FROM labelled WHERE rid IS NOT NULL GROUP BY 1, 2",
    "rule_breadth": LABELLED_SQL + " SELECT rule, count(DISTINCT orig_h) AS srcs, count(DISTINCT resp_h) AS dsts FROM labelled WHERE rid IS NOT NULL GROUP BY 1",
    "benign_bursts": LABELLED_SQL + """ SELECT capture, strftime(to_timestamp(floor(ts / 600) * 600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS bucket, count(*) AS n,
      count(*) FILTER (orig_h IN ('192.168.0.3', '192.168.2.5') OR resp_h IN ('192.168.0.3', '192.168.2.5') OR starts_with(orig_h, '192.168.1.') OR starts_with(resp_h, '192.168.1.')) AS victim_flows
      FROM labelled WHERE rid IS NULL GROUP BY 1, 2 ORDER BY n DESC, capture, bucket LIMIT 10""",
    "validity_counts": f"WITH {DIRTY_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS invariant, count(*) FILTER (NOT ({p})) AS violations, count(*) AS rows, count(*) FILTER (NOT ({p})) / count(*)::DOUBLE AS share FROM dirty" for n, p in _CHECKS.items()),
    "validity_filter": f"WITH {DIRTY_SQL} SELECT uid, orig_bytes, duration FROM dirty WHERE " + " AND ".join(f"coalesce({p}, true)" for p in _CHECKS.values()),
    "nonfinite_counts": """WITH t AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE WHEN event_id % 70 = 0 THEN 'inf'::DOUBLE ELSE value END AS value, value AS plain FROM events)
      SELECT 'value' AS "column", count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (isinf(value)) AS n_inf FROM t UNION ALL SELECT 'plain', count(*) FILTER (isnan(plain)), count(*) FILTER (isinf(plain)) FROM t""",
    "letter_alphabet": f"WITH {FLOWS_SQL}, l AS (SELECT unnest(string_split(history, '')) AS letter FROM flows) SELECT letter, count(*) AS n FROM l WHERE letter <> '' GROUP BY 1",
}

QUERIES = (schedule_label, quarantine_quality, schedule_summary, rule_breadth, benign_bursts, validity_counts, validity_filter, nonfinite_counts, letter_alphabet)
