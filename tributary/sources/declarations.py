"""Declarations: zones of a lake, label space, taxonomy, feature sets, partitions, schedules; and readers of their YAML."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from tributary.operators.governance import content_sha
from tributary.operators.pools import Partition
from tributary.operators.schedule import Window, manifest_regions, manifest_windows
from tributary.operators.vectorise import Categorical, Constraint, FeatureSet, Numeric

# Canonical classes, and raw attack names whose execution needs payload.
CANONICAL = ("benign", "brute_force", "dos", "ddos", "web_attack", "heartbleed", "infiltration", "botnet", "portscan")
NEEDS_PAYLOAD = (
    "FTP-Patator", "SSH-Patator", "FTP-BruteForce", "SSH-Bruteforce", "WebAttack-BruteForce", "WebAttack-XSS", "WebAttack-SQLInjection", "BruteForce-Web", "BruteForce-XSS",
    "SQL-Injection", "Botnet-ARES", "Bot", "Infiltration", "Heartbleed", "DoS-Hulk", "DoS-GoldenEye", "DDoS-LOIT", "DDoS-LOIC-HTTP", "DDoS-HOIC",
)
# The classes that are labelled by default, and why the others are not.
CORE_CLASSES = ("benign", "ddos", "dos", "brute_force", "botnet")
CORE_EXCLUDED = {"portscan": "single-domain", "web_attack": "too-few-executed", "infiltration": "too-few", "heartbleed": "unestimable"}


@dataclass(frozen=True)
class Zone:
    """A stage of a lake. `folders` are the keys that lead to a table, outermost first, so they are also what it needs.

    by_capture: files lie by capture below the table's folder, else the table is one file. population: what its rows
    are, with keys filled in; only equal populations may be compared.
    """

    folders: tuple[str, ...]
    by_capture: bool = False
    population: str = "{zone}"


# The zones, their folders, and what each one's rows are called.
ZONES = {
    "raw": Zone(("source", "dataset")),
    "extracted": Zone(("source", "feature_space", "dataset")),
    "parquet": Zone(("source", "feature_space", "dataset"), True, "prelabel"),
    "labelled": Zone(("source", "feature_space", "method", "dataset"), False, "postlabel-{method}"),
    "canonical": Zone(("source", "feature_space", "dataset")),
    "csv": Zone(("source", "feature_space", "dataset")),
}


def folder(root: str, zone: str, partial: bool = False, **keys: str) -> str:
    """Where a table of a zone lies. A missing key is refused, as a shorter path would read too much.

    partial: for listing, the path ends before the first key that is missing.
    """
    want = ZONES[zone].folders
    strange, missing = sorted(set(keys) - set(want)), [k for k in want if not keys.get(k)]
    if strange or (missing and not partial):
        raise ValueError(f"zone {zone!r} needs {', '.join(want)}; " + "; ".join([f"{k} is missing" for k in missing] + [f"{k} is none of them" for k in strange]))
    stop = want.index(missing[0]) if missing else len(want)
    return "/".join([root.rstrip("/"), zone, *(keys[k] for k in want[:stop])])


def files(root: str, zone: str, captures: Sequence[str] = (), log: str = "conn", **keys: str) -> list[str]:
    """The files or patterns to read a table of a zone from."""
    base = folder(root, zone, **keys)
    return [f"{base}/{c}/**/{log}.parquet" for c in captures or ("*",)] if ZONES[zone].by_capture else [f"{base}/{log}.parquet"]


def population(zone: str, **keys: str) -> str:
    """What a zone's rows are: what may be compared with what."""
    return ZONES[zone].population.format(zone=zone, **keys)


@dataclass(frozen=True)
class LabelSpace:
    """Classes in the order of a matrix, and excluded ones with their reasons."""

    classes: tuple[str, ...] = CORE_CLASSES
    excluded: Mapping[str, str] = field(default_factory=lambda: dict(CORE_EXCLUDED))

    def __post_init__(self) -> None:
        if "benign" not in self.classes:
            raise ValueError("a label space needs benign: unmatched flows fall to it")
        if set(self.classes) & set(self.excluded):
            raise ValueError("a class is both in the space and excluded")

    def index(self, name: str) -> int:
        return self.classes.index(name)


def _load(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def load_feature_set(path: str | Path) -> FeatureSet:
    d = _load(path)
    numeric = tuple(Numeric(n, f.get("expr", n), f.get("missing", 0.0), f.get("transform", "log1p") == "log1p", bool(f.get("missing_indicator")), f.get("centre", 0.0), f.get("scale", 1.0), f.get("verdict", "keep")) for n, f in d.get("numeric", {}).items())
    words = tuple(Categorical(n, tuple(f["vocabulary"]), f.get("expr"), f.get("verdict", "keep")) for n, f in d.get("categorical", {}).items())
    rules = tuple(Constraint(c["name"], c["target"], c["left"], c["right"], c.get("kind", "ratio")) for c in d.get("constraints", ()))
    return FeatureSet(d.get("name", Path(path).stem), numeric, words, rules)


def load_partition(path: str | Path) -> Partition:
    d = _load(path)
    return Partition(str(d.get("seed") or ""), tuple((n, float(p["share"])) for n, p in d["pools"].items()), int(d.get("buckets", 1_000_000)), d.get("partition_by", "uid"), tuple(d.get("exclude", ())))


def load_taxonomy(path: str | Path) -> tuple[dict[str, str], tuple[str, ...]]:
    """Raw attack name to class, and the raw names that need payload; a class that is not declared is refused."""
    d = _load(path)
    wrong = {c for c in d["raw_to_canonical"].values() if c not in d["canonical_classes"]}
    if wrong:
        raise ValueError(f"undeclared classes: {sorted(wrong)}")
    return dict(d["raw_to_canonical"]), tuple(d.get("requires_payload", ()))


def load_schedule(path: str | Path, taxonomy: dict[str, str] | None = None, needs_payload: tuple[str, ...] = NEEDS_PAYLOAD) -> tuple[tuple[Window, ...], tuple[Window, ...], str]:
    """Attack windows, quarantine regions, and the declaration's hash."""
    return read_schedule(_load(path), taxonomy, needs_payload)


def read_schedule(manifest: dict, taxonomy: dict[str, str] | None = None, needs_payload: tuple[str, ...] = NEEDS_PAYLOAD) -> tuple[tuple[Window, ...], tuple[Window, ...], str]:
    """The same of a manifest in memory, as those of tributary.sources.schedules."""
    return manifest_windows(manifest, taxonomy, needs_payload), manifest_regions(manifest), content_sha(manifest)


def annotated(document: dict, verdicts: Mapping[str, str], measures: Mapping[str, Mapping[str, float | None]] | None = None) -> dict:
    """A feature set's document with what screen and relevance found written beside each feature; nothing is taken out.

    FeatureSet.active() leaves out what a verdict drops when the file is loaded. Only keep, drop and hold are verdicts of a
    declaration; any other finding (missing, zero-variance) drops, with itself as reason.
    """
    out = json.loads(json.dumps(document))
    for part in ("numeric", "categorical"):
        for name, feature in (out.get(part) or {}).items():
            if name in verdicts:
                said = verdicts[name]
                feature = out[part][name] = dict(feature or {})
                feature["verdict"] = said if said in ("keep", "drop", "hold") else "keep" if said == "unmeasured" else "drop"
                if feature["verdict"] != said:
                    feature["reason"] = said
                feature |= {k: round(v, 6) for k, v in (measures or {}).get(name, {}).items() if v is not None}
    return out


def write_feature_set(path: str | Path, document: dict) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(document, sort_keys=False, allow_unicode=True), encoding="utf-8")
