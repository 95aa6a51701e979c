"""The flow table and its declared columns, and a flow view derived from a plain event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.sources.lake import read_table


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1000000.0)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as network flows: endpoints, volumes (null, zero and positive), states and a class for each."""
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    pick = lambda n, values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (e % n + 1).cast("int"))
    orig_bytes = F.when(e % 11 == 0, F.lit(None)).when(e % 5 == 0, F.lit(0.0)).otherwise(F.floor(F.col("value") * 10).cast("double"))
    return read_table(spark, sf_dir, "events").select(
        text(e).alias("uid"),
        epoch(F.col("ts")).alias("ts"),
        F.concat(F.lit("cap-"), text(e % 4)).alias("capture"),
        F.concat(F.lit("dom-"), text(F.col("user_id") % 2)).alias("dataset"),
        F.concat(F.lit("10.0.0."), text(F.col("user_id"))).alias("orig_h"),
        F.concat(F.lit("192.168."), text(e % 3), F.lit("."), text(e % 20)).alias("resp_h"),
        F.when(e % 7 != 0, F.col("value") / 10.0).alias("duration"),
        orig_bytes.alias("orig_bytes"),
        F.floor(F.col("value") * 3).cast("double").alias("resp_bytes"),
        (e % 9).cast("double").alias("orig_pkts"),
        (e % 6).cast("double").alias("resp_pkts"),
        (F.coalesce(orig_bytes, F.lit(0.0)) + 40.0 * (e % 9)).alias("orig_ip_bytes"),
        (F.floor(F.col("value") * 3) + 20.0 * (e % 6)).cast("double").alias("resp_ip_bytes"),
        F.when(e % 13 == 0, (e % 100).cast("double")).otherwise(F.lit(0.0)).alias("missed_bytes"),
        pick(3, ("tcp", "udp", "icmp")).alias("proto"),
        pick(4, (None, "http", "dns", "ssh")).alias("service"),
        pick(5, ("SF", "S0", "REJ", "RSTO", None)).alias("conn_state"),
        pick(6, ("ShADadFf", "S", "ShR", "D", None, "^dd")).alias("history"),
        F.when(e % 10 != 0, e % 2 == 0).alias("local_orig"),
        ((e * 37) % 65536).cast("int").alias("resp_p"),
        F.col("event_type").alias("label_class"),
    )


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows with rows that break the declared invariants."""
    e = F.col("uid").cast("bigint")
    return flows(spark, sf_dir).withColumns({
        "orig_bytes": F.when(e % 97 == 0, -F.col("orig_bytes")).otherwise(F.col("orig_bytes")),
        "duration": F.when(e % 89 == 0, -F.col("duration")).otherwise(F.col("duration")),
        "resp_ip_bytes": F.when(e % 83 == 0, F.col("resp_bytes") - 1).otherwise(F.col("resp_ip_bytes")),
    })


FLOWS_SQL = """flows AS (SELECT CAST(event_id AS VARCHAR) AS uid, epoch_us(ts) / 1000000.0 AS ts,
  concat('cap-', CAST(event_id % 4 AS VARCHAR)) AS capture, concat('dom-', CAST(user_id % 2 AS VARCHAR)) AS dataset,
  concat('10.0.0.', CAST(user_id AS VARCHAR)) AS orig_h,
  concat('192.168.', CAST(event_id % 3 AS VARCHAR), '.', CAST(event_id % 20 AS VARCHAR)) AS resp_h,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 10.0 END AS duration,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE floor(value * 10) END AS orig_bytes,
  floor(value * 3) AS resp_bytes, CAST(event_id % 9 AS DOUBLE) AS orig_pkts, CAST(event_id % 6 AS DOUBLE) AS resp_pkts,
  coalesce(CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE floor(value * 10) END, 0.0::DOUBLE) + 40.0::DOUBLE * (event_id % 9) AS orig_ip_bytes,
  floor(value * 3) + 20.0::DOUBLE * (event_id % 6) AS resp_ip_bytes,
  CASE WHEN event_id % 13 = 0 THEN CAST(event_id % 100 AS DOUBLE) ELSE 0.0::DOUBLE END AS missed_bytes,
  (['tcp', 'udp', 'icmp'])[event_id % 3 + 1] AS proto, ([NULL, 'http', 'dns', 'ssh'])[event_id % 4 + 1] AS service,
  (['SF', 'S0', 'REJ', 'RSTO', NULL])[event_id % 5 + 1] AS conn_state,
  (['ShADadFf', 'S', 'ShR', 'D', NULL, '^dd'])[event_id % 6 + 1] AS history,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 2 = 0 END AS local_orig,
  CAST((event_id * 37) % 65536 AS INTEGER) AS resp_p, event_type AS label_class FROM events)"""

DIRTY_SQL = FLOWS_SQL + """, dirty AS (SELECT * REPLACE (
  CASE WHEN CAST(uid AS BIGINT) % 97 = 0 THEN -orig_bytes ELSE orig_bytes END AS orig_bytes,
  CASE WHEN CAST(uid AS BIGINT) % 89 = 0 THEN -duration ELSE duration END AS duration,
  CASE WHEN CAST(uid AS BIGINT) % 83 = 0 THEN resp_bytes - 1 ELSE resp_ip_bytes END AS resp_ip_bytes) FROM flows)"""
