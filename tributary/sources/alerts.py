"""Alert logs of an intrusion detection system: newline-delimited JSON with a nested alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp string, event_type string, src_ip string, dest_ip string, alert struct<signature: string>"
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """ts (epoch seconds), src_ip, dest_ip, signature of each alert; a torn line is dropped.

    A log whose times carry no UTC offset names no instants and is refused.
    """
    events = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where("event_type = 'alert'")
    bare = events.where(~F.col("timestamp").rlike(OFFSET)).select("timestamp").first()
    if bare:
        raise ValueError(f"alert time {bare.timestamp!r} carries no UTC offset, so it names no instant")
    at = F.unix_micros(F.to_timestamp(F.regexp_replace("timestamp", r"([+-]\d{2})(\d{2})$", "$1:$2"))) / F.lit(1000000.0)
    return events.select(at.alias("ts"), "src_ip", "dest_ip", F.col("alert.signature").alias("signature"))


def alert_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A few alerts as rows; none give an empty table with its types."""
    return spark.createDataFrame(rows, "ts double, src_ip string, dest_ip string, signature string")
