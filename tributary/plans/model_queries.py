"""Queries of models, sources, discovery and streaming, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import governance as g
from tributary.operators import models as m
from tributary.operators import schedule
from tributary.operators import vectorise as v
from tributary.plans.decision_queries import _ALERTS, _BRANCHES, FEATURES, alerts, branches
from tributary.plans.label_queries import LABELLED_SQL, WINDOWS, _labelled
from tributary.plans.profile_queries import SQL as PROFILE_SQL
from tributary.plans.profile_queries import RULER
from tributary.sources import alerts as alert_log
from tributary.sources import lake
from tributary.sources.flows import FLOWS_SQL, flows
from tributary.sources.scratch import scratch
from tributary.streaming import flows as streaming

TABLES = "region nation customer supplier part orders lineitem events".split()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return v.vectors(flows(spark, d), FEATURES, ("uid", "label_class"))


def _sound(labelled: DataFrame, classes: list[str], extra: str) -> DataFrame:
    """What must hold of any model's labels: a row for each flow, a known class, a confidence no less than chance and its margin."""
    sure, margin = F.col("label_confidence"), F.col("label_margin")
    return labelled.select("uid", F.col("label_class").isin(*classes).alias("known"), ((sure >= 1 / len(classes) - 1e-9) & (sure <= 1)).alias("sure"), ((margin >= 0) & (margin <= sure)).alias("margin"), (F.col(extra) >= 0).alias(extra))


def behavioural_label(spark: SparkSession, d: str) -> DataFrame:
    phi = {c.name: 0.1 for c in FEATURES.constraints}
    return _sound(m.LABELLERS.get("behavioural").label(_vectors(spark, d), FEATURES, most=4_000, epochs=3, phi=phi), _classes(spark, d), "recon_error")


def contrastive_label(spark: SparkSession, d: str) -> DataFrame:
    return _sound(m.LABELLERS.get("contrastive").label(_vectors(spark, d), FEATURES, most=2_000, reservoir=256, rounds=2, epochs=2), _classes(spark, d), "view_agreement")


def _classes(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in flows(spark, d).select("label_class").distinct().collect()]


def oos_probe(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled row with its class's number, and whether its probabilities are some."""
    out = m.out_of_fold(_vectors(spark, d), epochs=2)
    total = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p)
    return out.select(F.col("key").alias("uid"), "label", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), F.forall("probs", lambda p: (p >= 0) & (p <= 1)).alias("probabilities"))


def class_reservoir(spark: SparkSession, d: str) -> DataFrame:
    return m.reservoirs(flows(spark, d).select("uid", "label_class"), "reservoir", 100)


def label_churn(spark: SparkSession, d: str) -> DataFrame:
    return m.churn(*branches(spark, d))


def ndjson_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "ndjson")
    source = lake.read_table(spark, d, "conversations")
    source.write.json(path)
    return lake.read_ndjson(spark, path, source.schema)


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "captures")
    e = lake.read_table(spark, d, "events")
    e.where("event_id % 2 = 0").select("event_id", "value").write.parquet(f"{base}/cap-a/conn.parquet")
    e.where("event_id % 2 = 1").select("event_id", "event_type").write.parquet(f"{base}/cap-b/conn.parquet")
    df = lake.read_union(spark, [f"{base}/cap-a/conn.parquet", f"{base}/cap-b/conn.parquet"])
    return lake.with_capture(df, base).select("event_id", "value", "event_type", "capture")


def footer_inventory(spark: SparkSession, d: str) -> DataFrame:
    return lake.footer_inventory(spark, [f"{d}/{t}.parquet" for t in TABLES])


def eve_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts written as an intrusion detection log, beside events of another kind, and read back."""
    path = scratch(spark, "eve")
    made = alerts(spark, d)
    at = F.date_format(F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    log = made.select(F.concat(at, F.lit("+0000")).alias("timestamp"), F.lit("alert").alias("event_type"), "src_ip", "dest_ip", F.struct("signature").alias("alert"))
    other = made.limit(5).select(F.lit("2024-01-01").alias("timestamp"), F.lit("dns").alias("event_type"), "src_ip", "dest_ip", F.struct("signature").alias("alert"))
    log.union(other).write.json(path)
    return alert_log.read_alerts(spark, path).withColumn("ts", F.round("ts", 4))


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV, with the number of rows that the writer gave, and read back as strings."""
    path, source = scratch(spark, "csv"), lake.read_table(spark, d, "nation")
    n = lake.write_csv(source, path)
    return lake.read_text_csv(spark, path).withColumn("rows_written", F.lit(n).cast("long"))


def lake_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Logs of a mirror by data set and kind, with what their footers say."""
    base, f = scratch(spark, "mirror"), flows(spark, d)
    for name in ("dom-0", "dom-1"):
        f.where(F.col("dataset") == name).drop("history" if name == "dom-1" else "none").write.parquet(f"{base}/{name}/cap/conn.parquet")
    f.select("uid").write.parquet(f"{base}/dom-1/cap/dns.parquet")
    rows = []
    for dataset, kinds in lake.catalog(spark, base).items():
        for kind, paths in kinds.items():
            s = lake.summarize(spark, paths)
            rows.append((dataset, kind, s["files"], s["rows"], s["signatures"], "history" in s["columns"]))
    return spark.createDataFrame(rows, "dataset string, log string, files long, n_rows long, signatures long, has_history boolean")


def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    diff = lake.schema_diff(lake.read_table(spark, d, "customer").schema, lake.read_table(spark, d, "supplier").schema)
    rows = [("left", c) for c in diff["only_left"]] + [("right", c) for c in diff["only_right"]]
    return spark.createDataFrame(rows, "side string, column string")


def provenance_stamp(spark: SparkSession, d: str) -> DataFrame:
    sha = g.composite_sha({"windows": [w.__dict__ for w in WINDOWS]})
    out = g.stamp(_labelled(spark, d), "schedule", sha, "dom")
    g.verify_schema(out)
    return out.select("uid", "label_binary", "label_class", "label_method", "label_confidence", "label_weight", "dataset", "capture")


def label_gate(spark: SparkSession, d: str) -> DataFrame:
    labelled = _labelled(spark, d).persist()
    try:
        total = labelled.count()
        burst = schedule.suspicious(schedule.bursts(labelled, WINDOWS), total).count()
        result = g.run_gate(g.LABEL_CHECKS, g.gate_context(labelled, [w.name for w in WINDOWS], burst))
    finally:
        labelled.unpersist()
    rows = [(n, "fatal", w) for n, w in result.failures] + [(n, "advice", w) for n, w in result.advice] + [("gate", "result", "passed" if result.passed else "failed")]
    return spark.createDataFrame(rows, "name string, kind string, what string")


def stream_label(spark: SparkSession, d: str) -> DataFrame:
    """Labels an event table as a stream and returns what was written."""
    base = scratch(spark, "stream")
    flows(spark, d).write.parquet(f"{base}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    q = streaming.label_stream(source, WINDOWS).select("uid", "label_class").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_profile(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "stream-profile")
    flows(spark, d).repartition(3).write.parquet(f"{base}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streaming.profile_stream(source, RULER, f"{base}/parts", f"{base}/state").awaitTermination()
    merged = streaming.merged_moments(spark.read.parquet(f"{base}/parts"))
    return merged.select("label_class", "feature", "n", "n_null", "n_zero", *(F.round(c, k).alias(c) for c, k in (("lo", 6), ("hi", 6), ("sum_t", 4), ("sumsq_t", 4))))


def profile_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample by design: that it is one of the valid rows, and about half of them."""
    f = flows(spark, d)
    part = lake.scan(f, F.col("duration").isNotNull(), 50.0, None, 3)
    total, some, valid, inside = f.where("duration is not null").count(), part.count(), part.where("duration is null").count() == 0, part.join(f, "uid", "left_anti").count() == 0
    few = lake.scan(f, None, 50.0, 7, 3).count()
    return spark.createDataFrame([(valid and inside, abs(some - total / 2) <= 4 * (total / 4) ** 0.5, few)], "of_the_rows boolean, about_half boolean, limited long")


_KNOWN = "true AS known, true AS sure, true AS margin"
SQL = {
    "behavioural_label": f"WITH {FLOWS_SQL} SELECT uid, {_KNOWN}, true AS recon_error FROM flows",
    "contrastive_label": f"WITH {FLOWS_SQL} SELECT uid, {_KNOWN}, true AS view_agreement FROM flows",
    "oos_probe": f"WITH {FLOWS_SQL}, c AS (SELECT label_class, CAST(row_number() OVER (ORDER BY label_class) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT label_class FROM flows)) SELECT uid, label, true AS sums_to_one, true AS probabilities FROM flows JOIN c ON flows.label_class = c.label_class",
    "profile_sample": "SELECT true AS of_the_rows, true AS about_half, CAST(7 AS BIGINT) AS limited",
    "eve_alerts": f"WITH {_ALERTS} SELECT round(ts, 4) AS ts, src_ip, dest_ip, signature FROM alerts",
    "csv_roundtrip": "SELECT CAST(COLUMNS(*) AS VARCHAR), (SELECT count(*) FROM nation) AS rows_written FROM nation",
    "lake_catalogue": f"WITH {FLOWS_SQL} SELECT dataset, 'conn' AS log, 1::BIGINT AS files, count(*) AS n_rows, 1::BIGINT AS signatures, dataset = 'dom-0' AS has_history FROM flows WHERE dataset IN ('dom-0', 'dom-1') GROUP BY dataset UNION ALL SELECT 'dom-1', 'dns', 1, count(*), 1, false FROM flows",
    "label_gate": f"""{LABELLED_SQL}, r AS (SELECT rule, count(DISTINCT orig_h) AS srcs, count(DISTINCT resp_h) AS dsts FROM labelled WHERE label_binary GROUP BY 1),
      silent AS (SELECT string_agg(name, ', ' ORDER BY name) AS s FROM (VALUES {', '.join(f"('{w.name}')" for w in WINDOWS)}) v(name) WHERE name NOT IN (SELECT rule FROM r)), n AS (SELECT count(*) AS n, count(DISTINCT uid) AS d FROM labelled),
      b AS (SELECT capture, floor(ts / 600) AS slot, count(*) AS n, count(*) FILTER (orig_h IN ('192.168.0.3', '192.168.2.5') OR resp_h IN ('192.168.0.3', '192.168.2.5') OR starts_with(orig_h, '192.168.1.') OR starts_with(resp_h, '192.168.1.')) AS v FROM labelled WHERE NOT label_binary GROUP BY 1, 2),
      top AS (SELECT * FROM b ORDER BY n DESC, capture, slot LIMIT 10), odd AS (SELECT count(*) AS k FROM top, n WHERE top.n > greatest(10000, 0.005 * n.n) AND v > 0.9 * top.n),
      f AS (SELECT 'every rule claims a flow' AS name, 'fatal' AS kind, 'silent: ' || s AS what FROM silent WHERE s IS NOT NULL UNION ALL SELECT 'uid is unique', 'fatal', (n - d) || ' rows repeat a uid' FROM n WHERE n <> d)
      SELECT * FROM f UNION ALL (SELECT 'rule breadth', 'advice', 'widest is ' || rule || ': ' || srcs || ' sources, ' || dsts || ' destinations' FROM r ORDER BY srcs + dsts DESC, rule LIMIT 1) UNION ALL SELECT 'no undeclared burst', 'advice', k || ' buckets look like an attack' FROM odd WHERE k > 0
      UNION ALL SELECT 'gate', 'result', CASE WHEN EXISTS (SELECT 1 FROM f) THEN 'failed' ELSE 'passed' END""",
    "class_reservoir": f"WITH {FLOWS_SQL} SELECT uid, label_class FROM flows QUALIFY row_number() OVER (PARTITION BY label_class ORDER BY CAST('0x' || substr(md5('reservoir' || uid), 1, 15) AS BIGINT) % 1099511627776, uid) <= 100",
    "label_churn": f"WITH {_BRANCHES} SELECT count(*) AS compared, count(*) FILTER (ac <> bc) AS changed FROM j",
    "ndjson_roundtrip": "SELECT * FROM conversations",
    "union_by_name": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type, CASE WHEN event_id % 2 = 0 THEN 'cap-a' ELSE 'cap-b' END AS capture FROM events",
    "footer_inventory": "SELECT table_name || '.parquet' AS file, count(*) AS n_columns, string_agg(column_name, ',' ORDER BY column_name) AS signature FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ") GROUP BY table_name",
    "schema_drift": """WITH c AS (SELECT table_name AS t, column_name AS n FROM duckdb_columns()) SELECT 'left' AS side, n AS "column" FROM c WHERE t = 'customer' AND n NOT IN (SELECT n FROM c WHERE t = 'supplier')
      UNION ALL SELECT 'right', n FROM c WHERE t = 'supplier' AND n NOT IN (SELECT n FROM c WHERE t = 'customer')""",
    "provenance_stamp": LABELLED_SQL + " SELECT uid, label_binary, label_class, 'schedule' AS label_method, CAST(NULL AS DOUBLE) AS label_confidence, CAST(NULL AS DOUBLE) AS label_weight, 'dom' AS dataset, capture FROM labelled",
    "stream_label": LABELLED_SQL + " SELECT uid, label_class FROM labelled",
    "stream_profile": PROFILE_SQL["profile_moments"],
}

QUERIES = (behavioural_label, contrastive_label, oos_probe, class_reservoir, label_churn, ndjson_roundtrip, union_by_name, footer_inventory, schema_drift, provenance_stamp, label_gate, stream_label, stream_profile, profile_sample, eve_alerts, csv_roundtrip, lake_catalogue)
