"""Row validity: declared invariants, as counts or as a filter. A null never breaks an invariant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.exprs import all_of, col, count_where, ratio

LINE_RATE = 1.25e10


def invariants() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Name to (columns it needs, predicate that must hold)."""
    c = col
    rate = F.coalesce((c("duration") > 0) & (ratio(c("orig_bytes"), c("duration")) > LINE_RATE), F.lit(False))
    return {
        "non_negative_orig_bytes": (("orig_bytes",), c("orig_bytes") >= 0),
        "non_negative_resp_bytes": (("resp_bytes",), c("resp_bytes") >= 0),
        "non_negative_duration": (("duration",), c("duration") >= 0),
        "orig_ip_bytes_cover_payload": (("orig_ip_bytes", "orig_bytes"), c("orig_ip_bytes") >= c("orig_bytes")),
        "resp_ip_bytes_cover_payload": (("resp_ip_bytes", "resp_bytes"), c("resp_ip_bytes") >= c("resp_bytes")),
        "orig_bytes_need_packets": (("orig_bytes", "orig_pkts"), ~((c("orig_bytes") > 0) & (c("orig_pkts") == 0))),
        "resp_bytes_need_packets": (("resp_bytes", "resp_pkts"), ~((c("resp_bytes") > 0) & (c("resp_pkts") == 0))),
        "orig_rate_below_line_rate": (("orig_bytes", "duration"), ~rate),
    }


def applicable(df: DataFrame) -> tuple[dict[str, Column], list[str]]:
    """The invariants whose columns df has, and the names of the others."""
    have = {c.lower() for c in df.columns}
    fits = {n: p for n, (needs, p) in invariants().items() if all(x in have for x in needs)}
    return fits, [n for n in invariants() if n not in fits]


def is_valid(df: DataFrame) -> Column:
    return all_of([F.coalesce(p, F.lit(True)) for p in applicable(df)[0].values()])


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where(is_valid(df))


def excluded(df: DataFrame) -> DataFrame:
    """excluded, total: one pass over the rows that a filter on validity would read."""
    return df.agg(F.count_if(~is_valid(df)).alias("excluded"), F.count(F.lit(1)).alias("total"))


def violations(df: DataFrame) -> DataFrame:
    """invariant, violations, rows, share: one pass for all."""
    fits, _ = applicable(df)
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *(count_where(~p).alias(n) for n, p in fits.items()))
    long = wide.unpivot(["rows"], list(fits), "invariant", "violations")
    return long.select("invariant", "violations", "rows", F.try_divide(F.col("violations").cast("double"), F.col("rows").cast("double")).alias("share"))


def non_finite(df: DataFrame) -> DataFrame:
    """column, n_nan, n_inf of floating columns."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    rows = [F.struct(F.lit(n).alias("column"), count_where(F.isnan(col(n))).alias("n_nan"), count_where(F.abs(col(n)) == float("inf")).alias("n_inf")) for n in names]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def alphabet(df: DataFrame, column: str) -> DataFrame:
    """letter, n: how often each character occurs in a column."""
    return df.select(F.explode(F.split(col(column), "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
