"""Declared feature sets as matrices: imputed, clamped logs, standardised, one-hot; and the residuals of constraints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.exprs import col, log1p_clamped, ratio

OTHER = "__other"


@dataclass(frozen=True)
class Numeric:
    name: str
    expr: str
    missing: float = 0.0
    log: bool = True
    indicator: bool = False
    centre: float = 0.0
    scale: float = 1.0
    verdict: str = "keep"

    def raw(self) -> Column:
        return F.expr(self.expr).cast("double")

    def encoded(self) -> Column:
        x = F.coalesce(self.raw(), F.lit(float(self.missing)))
        x = log1p_clamped(x) if self.log else x
        return (x - self.centre) / self.scale

    def clamped(self) -> Column:
        """Whether the log had to count a negative as 0."""
        return F.coalesce((self.raw() < 0) & F.lit(self.log), F.lit(False))


@dataclass(frozen=True)
class Categorical:
    name: str
    vocabulary: tuple[str, ...]
    expr: str | None = None
    verdict: str = "keep"

    def columns(self) -> list[str]:
        return [f"{self.name}={v}" for v in (*self.vocabulary, OTHER)]

    def encoded(self) -> list[Column]:
        """One column a word and one for all else, null included; exactly one is 1."""
        x = F.expr(self.expr or f"`{self.name}`").cast("string")
        known = F.coalesce(x.isin(*self.vocabulary), F.lit(False))
        return [F.when(x == v, 1.0).otherwise(0.0) for v in self.vocabulary] + [F.when(known, 0.0).otherwise(1.0)]


@dataclass(frozen=True)
class Constraint:
    """target = left / right, or left + right, in original units."""

    name: str
    target: str
    left: str
    right: str
    kind: str = "ratio"


@dataclass(frozen=True)
class FeatureSet:
    name: str
    numeric: tuple[Numeric, ...]
    categorical: tuple[Categorical, ...] = ()
    constraints: tuple[Constraint, ...] = ()

    def __post_init__(self) -> None:
        names = [f.name for f in (*self.numeric, *self.categorical)]
        errors = []
        if not names:
            errors.append("no features")
        if len(set(names)) < len(names):
            errors.append("a feature is declared twice")
        elif len({n.lower() for n in names}) < len(names):
            errors.append("features differ by case alone")
        errors += [f"{f.name}: scale is zero" for f in self.numeric if f.scale == 0]
        errors += [f"{f.name}: empty vocabulary" for f in self.categorical if not f.vocabulary]
        errors += [f"{f.name}: a word is declared twice" for f in self.categorical if len(set(f.vocabulary)) < len(f.vocabulary)]
        errors += [f"{f.name}: {OTHER} is reserved" for f in self.categorical if OTHER in f.vocabulary]
        known = {f.name for f in self.numeric}
        for c in self.constraints:
            errors += [f"{c.name}: unknown feature {x}" for x in (c.target, c.left, c.right) if x not in known]
            errors += [f"{c.name}: unknown kind {c.kind}"] if c.kind not in ("ratio", "sum") else []
        if errors:
            raise ValueError(f"feature set {self.name!r}: " + "; ".join(errors))

    def active(self) -> "FeatureSet":
        """Without features whose verdict is drop, and constraints that need one."""
        numeric = tuple(f for f in self.numeric if f.verdict != "drop")
        left = {f.name for f in numeric}
        return replace(self, numeric=numeric, categorical=tuple(f for f in self.categorical if f.verdict != "drop"), constraints=tuple(c for c in self.constraints if {c.target, c.left, c.right} <= left))

    def columns(self) -> list[str]:
        """The order of the matrix: numeric features, each with its indicator, then the blocks of words."""
        out = [x for f in self.numeric for x in ([f.name, f"{f.name}__missing"] if f.indicator else [f.name])]
        return out + [c for f in self.categorical for c in f.columns()]


def _named(fs: FeatureSet) -> list[Column]:
    exprs = []
    for f in fs.numeric:
        exprs.append(f.encoded())
        if f.indicator:
            exprs.append(F.when(f.raw().isNull(), 1.0).otherwise(0.0))
    exprs += [e for f in fs.categorical for e in f.encoded()]
    return [e.alias(n) for e, n in zip(exprs, fs.columns())]


def matrix(df: DataFrame, fs: FeatureSet, carry: Sequence[str] = ("uid",)) -> DataFrame:
    """Carried columns and one double column a matrix column."""
    return df.select(*(col(c) for c in carry), *_named(fs))


def vectors(df: DataFrame, fs: FeatureSet, carry: Sequence[str] = ("uid",)) -> DataFrame:
    """Carried columns and `features`, an array of doubles in matrix order."""
    return df.select(*(col(c) for c in carry), F.array(*_named(fs)).alias("features"))


def batches(df: DataFrame, fs: FeatureSet, rows: int = 8_192) -> Iterator[np.ndarray]:
    """The matrix as pieces of at most `rows` rows, packed by the executors; the driver holds one partition's pieces."""
    width = len(fs.columns())

    def pack(parts):
        import pyarrow as pa

        for b in parts:
            for i in range(0, b.num_rows, rows):
                piece = b.slice(i, rows).column(0)
                yield pa.RecordBatch.from_arrays([pa.array([len(piece)], pa.int32()), pa.array([piece.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary())], ["n", "data"])

    for r in vectors(df, fs, ()).mapInArrow(pack, "n int, data binary").toLocalIterator(prefetchPartitions=False):
        yield np.frombuffer(r.data, "<f8").reshape(r.n, width)


def clamp_counts(df: DataFrame, fs: FeatureSet) -> DataFrame:
    wide = df.agg(*(F.count_if(f.clamped()).alias(f.name) for f in fs.numeric))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(f.name).alias("feature"), col(f.name).alias("n_clamped")) for f in fs.numeric))))


def residuals(df: DataFrame, fs: FeatureSet) -> DataFrame:
    """constraint, n, mean_abs, mean_square, mean_log_square: what targets are off by where all operands were measured."""
    raw = {f.name: f.raw() for f in fs.numeric}
    parts = []
    for c in fs.constraints:
        t, left, right = raw[c.target], raw[c.left], raw[c.right]
        want = ratio(left, right) if c.kind == "ratio" else left + right
        off = F.when(t.isNotNull(), want - t)
        parts.append(F.struct(F.lit(c.name).alias("constraint"), F.count(off).alias("n"), F.avg(F.abs(off)).alias("mean_abs"), F.avg(off * off).alias("mean_square"), F.avg(F.pow(F.log(F.lit(1.0) + F.abs(off)), F.lit(2))).alias("mean_log_square")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def project(x: np.ndarray, fs: FeatureSet) -> np.ndarray:
    """Rows of a matrix with the targets of constraints made to agree with their operands, where these are defined."""
    out, at = x.copy(), {n: i for i, n in enumerate(fs.columns())}
    of = {f.name: f for f in fs.numeric}

    def raw(name: str) -> np.ndarray:
        f = of[name]
        v = out[:, at[name]] * f.scale + f.centre
        return np.expm1(v) if f.log else v

    for c in fs.constraints:
        left, right, f = raw(c.left), raw(c.right), of[c.target]
        fine = np.abs(right) > 1e-12 if c.kind == "ratio" else np.ones(len(x), bool)
        want = np.where(fine, left / np.where(fine, right, 1.0), 0.0) if c.kind == "ratio" else left + right
        want = np.log1p(np.maximum(want, 0)) if f.log else want
        out[fine, at[c.target]] = ((want - f.centre) / f.scale)[fine]
    return out


def flow_features() -> FeatureSet:
    """The declared features of a flow table, with states of its own table as vocabulary."""
    volumes = ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "missed_bytes")
    numeric = [Numeric(n, n, indicator=n in volumes[:3]) for n in volumes]
    numeric += [
        Numeric("orig_rate", "try_divide(orig_bytes, duration)"), Numeric("resp_rate", "try_divide(resp_bytes, duration)"), Numeric("bytes_per_pkt_orig", "try_divide(orig_bytes, orig_pkts)"), Numeric("bytes_per_pkt_resp", "try_divide(resp_bytes, resp_pkts)"),
        Numeric("ratio_orig_resp", "(orig_bytes + 1.0) / (resp_bytes + 1.0)", missing=1.0), Numeric("overhead_orig", "orig_ip_bytes - orig_bytes"), Numeric("history_len", "coalesce(length(history), 0)", log=False),
    ]
    numeric += [Numeric(f"hist_{'caret' if c == '^' else ('lo_' if c.islower() else 'up_') + c.lower()}", f"coalesce(length(history) - length(replace(history, '{c}', '')), 0)", log=False) for c in "ShADadFf^"]
    words = (Categorical("proto", ("tcp", "udp", "icmp")), Categorical("conn_state", ("SF", "S0", "REJ")), Categorical("local_orig", ("true", "false")))
    rules = (
        Constraint("rate", "orig_rate", "orig_bytes", "duration"), Constraint("rate_resp", "resp_rate", "resp_bytes", "duration"), Constraint("per_packet", "bytes_per_pkt_orig", "orig_bytes", "orig_pkts"),
        Constraint("per_packet_resp", "bytes_per_pkt_resp", "resp_bytes", "resp_pkts"), Constraint("ip_bytes", "orig_ip_bytes", "orig_bytes", "overhead_orig", "sum"),
    )
    return FeatureSet("flow", tuple(numeric), words, rules)
