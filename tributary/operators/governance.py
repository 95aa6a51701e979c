"""What guards a labelled table: declared columns, content hashes, stale output, validation gates, plug-in points."""

from __future__ import annotations

import hashlib
import importlib.util
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators.schedule import breadth

# The columns every labelled table has.
LABEL_SCHEMA = T.StructType([
    T.StructField("label_binary", T.BooleanType()),
    T.StructField("label_class", T.StringType()),
    T.StructField("label_source", T.StringType()),
    T.StructField("label_method", T.StringType()),
    T.StructField("method_sha", T.StringType()),
    T.StructField("label_confidence", T.DoubleType()),
    T.StructField("label_weight", T.DoubleType()),
    T.StructField("label_quality", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("capture", T.StringType()),
    T.StructField("labelled_at", T.StringType()),
])
SOURCES = ("matched", "closed-world", "predicted", "fused")


def content_sha(document: object) -> str:
    """Twelve hex digits of a declaration's content; the order of keys doesn't matter."""
    text = document if isinstance(document, str) else json.dumps(document, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def composite_sha(parts: Mapping[str, object]) -> str:
    """A hash over named parts, whatever their order."""
    return content_sha("\n".join(f"{k}={content_sha(v)}" for k, v in sorted(parts.items())))


def stamp(df: DataFrame, method: str, sha: str, dataset: str, at: datetime | None = None) -> DataFrame:
    """df with provenance columns, and typed nulls for label columns that its method does not measure."""
    literal = {"label_method": method, "method_sha": sha, "dataset": dataset, "labelled_at": (at or datetime.now(timezone.utc)).isoformat(timespec="seconds")}
    out = df.withColumns({k: F.lit(v) for k, v in literal.items()})
    missing = {f.name: F.lit(None).cast(f.dataType) for f in LABEL_SCHEMA if f.name not in out.columns}
    return out.withColumns(missing) if missing else out


def verify_schema(df: DataFrame, extras: Mapping[str, str] | None = None) -> None:
    """Every label column (and each extra of the method) is there, with its type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in LABEL_SCHEMA} | dict(extras or {})
    wrong = [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in want.items() if have.get(n) != t]
    if wrong:
        raise ValueError("label columns differ: " + "; ".join(wrong))


def replace_labels(df: DataFrame, labels: Mapping[str, Column] | None = None) -> DataFrame:
    """df without any label column, then the new ones."""
    known = {f.name for f in LABEL_SCHEMA} - {"dataset", "capture"} | {"label_margin", "label_executed", "rule", "rules_matched", "quarantine_reason"}
    return df.drop(*known).select("*", *(c.alias(n) for n, c in (labels or {}).items()))


def refuse_stale(spark: SparkSession, path: str, sha: str, force: bool = False) -> None:
    """An output that another declaration made is not overwritten silently; one row is read."""
    from tributary.sources.lake import list_files

    if force or not list_files(spark, path):
        return
    row = spark.read.parquet(path).select("method_sha").first()
    if row and row.method_sha != sha:
        raise ValueError(f"{path} was made by declaration {row.method_sha}, not {sha}")


@dataclass(frozen=True)
class Check:
    name: str
    test: Callable[[Mapping], str | None]  # what is wrong, or None
    fatal: bool = True
    needs: tuple[str, ...] = ()


@dataclass
class GateResult:
    failures: list[tuple[str, str]] = field(default_factory=list)
    advice: list[tuple[str, str]] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.failures


def run_gate(checks: list[Check], context: Mapping) -> GateResult:
    """All checks run, whatever fails; a check whose input is missing is a fault of the harness."""
    out = GateResult()
    for c in checks:
        absent = [n for n in c.needs if n not in context]
        if absent:
            raise KeyError(f"check {c.name} was not given {', '.join(absent)}")
        if (wrong := c.test(context)) is not None:
            (out.failures if c.fatal else out.advice).append((c.name, wrong))
    return out


LABEL_CHECKS = [
    Check("every rule claims a flow", lambda c: f"silent: {', '.join(s)}" if (s := sorted(set(c["rules"]) - set(c["claimed"]))) else None, needs=("rules", "claimed")),
    Check("uid is unique", lambda c: None if c["distinct"] == c["rows"] else f"{c['rows'] - c['distinct']} rows repeat a uid", needs=("rows", "distinct")),
    Check("counts reconcile", lambda c: None if c["attack"] + c["benign"] == c["rows"] else "attack and benign do not sum to all rows", needs=("rows", "attack", "benign")),
    Check("rule breadth", lambda c: f"widest is {w[0]}: {w[1]} sources, {w[2]} destinations" if (w := c["widest"]) else None, False, ("widest",)),
    Check("no undeclared burst", lambda c: f"{c['suspicious']} buckets look like an attack" if c["suspicious"] else None, False, ("suspicious",)),
]


def gate_context(labelled: DataFrame, rules: list[str], suspicious: int = 0, orig: str = "orig_h", resp: str = "resp_h") -> dict:
    """What LABEL_CHECKS need, in two passes over the labelled table. The widest rule has most sources and destinations together."""
    r = labelled.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("uid").alias("distinct"), F.count_if("label_binary").alias("attack"), F.count_if(~F.col("label_binary")).alias("benign")).first()
    wide = [tuple(x) for x in breadth(labelled, orig, resp).collect()]  # a row for each rule
    widest = min(wide, key=lambda x: (-x[1] - x[2], x[0]), default=None)
    return r.asDict() | {"rules": rules, "claimed": [x[0] for x in wide], "suspicious": suspicious, "widest": widest}


class Point:
    """A named place where implementations are registered, by code or from a folder of Python files or YAML declarations."""

    def __init__(self, name: str) -> None:
        self.name, self.items, self.origin = name, {}, {}

    def register(self, item, origin: str = "built-in"):
        key = getattr(item, "name", None) or item.__name__
        if key in self.items and self.origin[key] == origin:
            raise ValueError(f"{self.name} {key!r} is registered twice")
        self.items[key], self.origin[key] = item, origin
        return item

    def get(self, key: str):
        if key not in self.items:
            raise KeyError(f"no {self.name} {key!r}; there are: {', '.join(sorted(self.items)) or 'none'}")
        return self.items[key]

    def load_code(self, folder: str) -> None:
        """Runs each Python file of a folder that the user trusts; what it registers wins over what is built in."""
        for path in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(f"plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            module.POINT = self
            spec.loader.exec_module(module)

    def load_declarations(self, folder: str, make: Callable[[dict], object]) -> None:
        import yaml

        for path in sorted(Path(folder).glob("*.yaml")):
            self.items[path.stem], self.origin[path.stem] = make(yaml.safe_load(path.read_text())), str(path)


@dataclass(frozen=True)
class Experiment:
    """Which data sets train, which are held out and why."""

    name: str
    roles: Mapping[str, str]
    reasons: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        wrong = {r for r in self.roles.values()} - {"train", "holdout", "audit", "unassigned"}
        if wrong:
            raise ValueError(f"unknown roles: {sorted(wrong)}")
        silent = [d for d, r in self.roles.items() if r == "holdout" and not self.reasons.get(d)]
        if silent:
            raise ValueError(f"a holdout needs a reason: {silent}")

    def role(self, dataset: str) -> str:
        return self.roles.get(dataset, "unassigned")

    def datasets(self, role: str) -> list[str]:
        return sorted(d for d, r in self.roles.items() if r == role)


def load_experiment(path: str | Path, known: Mapping[str, object] | None = None) -> Experiment:
    """An experiment's YAML: name, datasets: {name: role, or {role, reason}}. Data sets that `known` lacks are refused."""
    import yaml

    d = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not d.get("datasets"):
        raise ValueError(f"{path}: an experiment needs datasets")
    entries = {n: v if isinstance(v, dict) else {"role": v} for n, v in d["datasets"].items()}
    strange = sorted(set(entries) - set(known)) if known is not None else []
    if strange:
        raise ValueError(f"{path}: unknown data sets {strange}")
    return Experiment(str(d.get("name") or Path(path).stem), {n: str(v.get("role", "unassigned")) for n, v in entries.items()}, {n: v["reason"] for n, v in entries.items() if v.get("reason")})
