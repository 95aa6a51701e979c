"""Streaming forms of what is stateless or additive: labels, profiles by class, bursts by event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.operators import profile, schedule


def label_stream(flows: DataFrame, windows: Sequence[schedule.Window], regions: Sequence[schedule.Window] = ()) -> DataFrame:
    """Labels each flow as it comes: windows are part of the expression, so there is no state."""
    return schedule.label(flows, windows, regions)


def burst_stream(labelled: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Unmatched flows by capture and ten minutes of event time, once the watermark has passed."""
    at = labelled.where("rid is null").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return at.groupBy(F.window("at", "10 minutes"), "capture").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "capture", "n")


def profile_stream(flows: DataFrame, ruler: profile.Ruler, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's moments, which add up to the profile of all that came; a batch run again replaces its part."""

    def write(batch: DataFrame, number: int) -> None:
        profile.moments(batch, ruler).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return flows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_moments(parts: DataFrame, group: str = "label_class") -> DataFrame:
    """Moments of several batches or data sets as one."""
    return parts.groupBy(group, "feature").agg(*(F.sum(c).alias(c) for c in ("n", "n_null", "n_zero")), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sum_t").alias("sum_t"), F.sum("sumsq_t").alias("sumsq_t"))
