"""Schedule labelling: a range join of flows to declared time-and-endpoint windows, closed-world labels, its checks.

Windows are a declaration of tens of rows. A flow is matched inside its own row, by a filter over the array of
windows, so labelling needs no shuffle at all: the lowest rule that claims the flow, and how many claim it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.exprs import any_of, col, count_where

BENIGN, CERTAIN, UNCERTAIN, OUT_OF_SPACE = "benign", "certain", "uncertain", "out-of-space"
#: A window covers its last minute whole, unless the next one starts there.
LAST_MINUTE = 60.0
BURST_SECONDS, BURST_FLOWS, BURST_SHARE, VICTIM_SHARE = 600, 10_000, 0.005, 0.9
#: Windows past this many come by a broadcast table of time buckets instead of being held in each row's expression.
MAX_INLINE = 200
#: Buckets grow until the broadcast table has at most so many entries, or twice as many as there are windows.
MAX_ENTRIES = 100_000


@dataclass(frozen=True)
class Window:
    """[t0, t1) with the endpoints it claims; quarantine regions are windows whose `kind` is the reason.

    No victims (None) means any peer; an empty list of them is met by no peer.
    """

    rid: int
    name: str
    kind: str
    t0: float
    t1: float
    attackers: tuple[str, ...] | None = None
    victims: tuple[str, ...] | None = None
    subnet_prefix: str | None = None
    needs_payload: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "attackers", None if self.attackers is None else tuple(self.attackers))
        object.__setattr__(self, "victims", None if self.victims is None else tuple(self.victims))
        if self.subnet_prefix and not self.subnet_prefix.endswith("."):
            raise ValueError(f"window {self.name!r}: prefix {self.subnet_prefix!r} without a last dot would take in other subnets")
        if not (self.attackers or self.victims or self.subnet_prefix):
            raise ValueError(f"window {self.name!r} has no endpoint: it would claim every flow in its span")
        if self.t1 <= self.t0:
            raise ValueError(f"window {self.name!r} ends before it starts")


_OFFSET = re.compile(r"([+-]?)([0-9]{1,2}):([0-9]{2})")


def offset_hours(text: str) -> float:
    """'+02:00' or '-03:30' as hours; anything else is refused."""
    found = _OFFSET.fullmatch(text.strip())
    if not found:
        raise ValueError(f"{text!r} is no UTC offset of the form -03:00")
    value = int(found[2]) + int(found[3]) / 60
    if value >= 24:
        raise ValueError(f"offset {text!r} is a day or more")
    return -value if found[1] == "-" else value


def to_epoch(date: str, clock: str, offset: float) -> float:
    """Local wall-clock time, to the minute, as epoch seconds. Seconds are refused: ends are extended by a minute."""
    return (datetime.strptime(f"{date} {clock}", "%Y-%m-%d %H:%M") - timedelta(hours=offset)).replace(tzinfo=timezone.utc).timestamp()


def extend_windows(windows: Sequence[Window], stops: Sequence[float] | None = None) -> tuple[Window, ...]:
    """Ends moved to the end of their last minute, but not past the next of `stops` (else the windows' own starts)."""
    starts = sorted(w.t0 for w in windows) if stops is None else sorted(stops)
    out = []
    for w in windows:
        later = next((s for s in starts if s >= w.t1), None)
        out.append(replace(w, t1=w.t1 + LAST_MINUTE if later is None else min(w.t1 + LAST_MINUTE, later)))
    return tuple(out)


def _when(entry: dict, manifest: dict) -> tuple[str, float]:
    """An entry's date and UTC offset: by its day, where days have offsets of their own, else by date."""
    if manifest.get("days") is not None:
        day = manifest["days"][entry["day"]]
        return str(day["date"]), offset_hours(str(day["utc_offset"]))
    return str(entry["date"]), offset_hours(str(manifest["utc_offset"]))


def _built(entries: Sequence[dict], manifest: dict, name: str, kinds: dict[str, str], payload: Sequence[str]) -> list[Window]:
    out, errors = [], []
    for i, a in enumerate(entries):
        try:
            date, offset = _when(a, manifest)
            subnet = a.get("victim_subnet")
            if subnet and not subnet.endswith("/24"):
                raise ValueError(f"subnet {subnet!r}: only /24 can be told by a prefix")
            prefix = ".".join(subnet.split("/")[0].split(".")[:3]) + "." if subnet else None
            out.append(Window(i, a[name], kinds.get(a[name], a[name]), to_epoch(date, str(a["start"]), offset), to_epoch(date, str(a["end"]), offset), a.get("attacker_ips") or None, a.get("victim_ips") or None, prefix, a[name] in payload))
        except (KeyError, ValueError) as e:
            errors.append(f"attack {i}: {e!r}" if isinstance(e, KeyError) else f"attack {i}: {e}")
    if errors:
        raise ValueError("; ".join(errors))
    return out


def manifest_windows(manifest: dict, taxonomy: dict[str, str] | None = None, payload: Sequence[str] = ()) -> tuple[Window, ...]:
    """Windows of a manifest's attacks: name, date (or day), start, end, attacker_ips, victim_ips, victim_subnet.

    payload: names whose execution needs payload. All errors are reported together.
    """
    out = _built(manifest.get("attacks", ()), manifest, "name", taxonomy or {}, payload)
    if not out:
        raise ValueError("no windows: everything would silently be benign")
    return extend_windows(out)


def manifest_regions(manifest: dict) -> tuple[Window, ...]:
    """Quarantine regions of a manifest; they stop where an attack starts, as the schedule accounts for what follows."""
    attacks = _built(manifest.get("attacks", ()), manifest, "name", {}, ())
    return extend_windows(_built(manifest.get("quarantine") or (), manifest, "reason", {}, ()), [w.t0 for w in attacks])


def _victim(w: Window, host: Column) -> Column:
    if w.victims is None and not w.subnet_prefix:
        return F.lit(True)
    tests = [host.isin(*w.victims)] if w.victims else [F.lit(False)]
    tests += [host.startswith(w.subnet_prefix)] if w.subnet_prefix else []
    return any_of([F.coalesce(t, F.lit(False)) for t in tests])


def claims(w: Window, ts: str = "ts", orig: str = "orig_h", resp: str = "resp_h") -> Column:
    """Whether a window claims a flow: inside [t0, t1), endpoints in either direction."""
    o, r = col(orig), col(resp)
    if w.attackers is not None:
        ends = (o.isin(*w.attackers) & _victim(w, r)) | (r.isin(*w.attackers) & _victim(w, o))
    elif w.victims:
        ends = o.isin(*w.victims) | r.isin(*w.victims)
    else:
        ends = F.lit(False)
    return F.coalesce((col(ts) >= w.t0) & (col(ts) < w.t1) & ends, F.lit(False))


def match(flows: DataFrame, windows: Sequence[Window], prefix: str = "", **names: str) -> DataFrame:
    """flows with {prefix}rid (lowest window that claims the flow, else null) and {prefix}nrules."""
    if not windows:
        raise ValueError("no windows: everything would silently be benign")
    if len(windows) > MAX_INLINE:
        return _match_by_time(flows, windows, prefix, **names)
    ordered = sorted(windows, key=lambda w: w.rid)
    hits = F.array_compact(F.array(*(F.when(claims(w, **names), F.lit(w.rid)) for w in ordered)))
    return _with_hits(flows, flows, hits, prefix)


def _with_hits(flows: DataFrame, source: DataFrame, hits: Column, prefix: str) -> DataFrame:
    held = _unused("hits", flows)
    out = source.withColumn(held, hits)
    return out.select(*(col(c) for c in flows.columns), F.get(col(held), F.lit(0)).alias(f"{prefix}rid"), F.size(col(held)).cast("long").alias(f"{prefix}nrules"))


def _unused(name: str, df: DataFrame) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def _match_by_time(flows: DataFrame, windows: Sequence[Window], prefix: str, ts: str = "ts", orig: str = "orig_h", resp: str = "resp_h") -> DataFrame:
    """The same for schedules too long for one expression: each flow meets the one row of its time bucket, which holds
    the windows that touch it. Every flow stays a row of its own, so repeated or null uids do no harm."""
    width = BURST_SECONDS
    while sum(int(w.t1 // width) - int(w.t0 // width) + 1 for w in windows) > max(MAX_ENTRIES, 2 * len(windows)):
        width *= 2
    rules: dict[int, list] = {}
    for w in sorted(windows, key=lambda w: w.rid):
        row = (w.rid, w.t0, w.t1, None if w.attackers is None else list(w.attackers), None if w.victims is None else list(w.victims), w.subnet_prefix)
        for bucket in range(int(w.t0 // width), int(w.t1 // width) + 1):
            rules.setdefault(bucket, []).append(row)
    bucket, held = _unused("bucket", flows), _unused("rules", flows)
    kind = "array<struct<rid: int, t0: double, t1: double, atk: array<string>, vic: array<string>, pfx: string>>"
    table = flows.sparkSession.createDataFrame(list(rules.items()), f"{bucket} long, {held} {kind}")
    o, r = col(orig), col(resp)
    has = lambda c, h: F.coalesce(F.array_contains(c, h), F.lit(False))

    def claim(w: Column) -> Column:
        vic = lambda h: (w["vic"].isNull() & w["pfx"].isNull()) | has(w["vic"], h) | F.coalesce(h.startswith(w["pfx"]), F.lit(False))
        ends = F.when(w["atk"].isNotNull(), (has(w["atk"], o) & vic(r)) | (has(w["atk"], r) & vic(o))).otherwise(has(w["vic"], o) | has(w["vic"], r))
        return (col(ts) >= w["t0"]) & (col(ts) < w["t1"]) & ends

    met = flows.withColumn(bucket, F.floor(col(ts) / width)).join(F.broadcast(table), bucket, "left")
    hits = F.transform(F.filter(F.coalesce(col(held), F.array().cast(kind)), claim), lambda w: w["rid"])
    return _with_hits(flows, met, hits, prefix)


def lookup(key: Column, values: dict[int, object], kind: str = "string") -> Column:
    if not values:
        return F.lit(None).cast(kind)
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), key)


def executed(payload: Column, needed: Column) -> Column:
    """Whether an attack's payload went out: null where unmeasured, true where none is needed or some bytes went."""
    return F.when(~needed, F.lit(True)).when(payload.isNull(), F.lit(None).cast("boolean")).otherwise(payload > 0)


def label(flows: DataFrame, windows: Sequence[Window], regions: Sequence[Window] = (), excluded: dict[str, str] | None = None, **names: str) -> DataFrame:
    """Closed-world labels: every flow is kept, an unmatched one is benign.

    excluded: classes outside the label space with their reasons. A region's reason is the one reported where both
    hold, while the quality names the space first.
    """
    out = match(flows, windows, **names)
    out = match(out, regions, "q", **names) if regions else out.withColumns({"qrid": F.lit(None).cast("int"), "qnrules": F.lit(0).cast("long")})
    rid = F.col("rid")
    kind = F.coalesce(lookup(rid, {w.rid: w.kind for w in windows}), F.lit(BENIGN))
    needs = F.coalesce(lookup(rid, {w.rid: w.needs_payload for w in windows}, "boolean"), F.lit(False))
    region = lookup(F.col("qrid"), {w.rid: w.kind for w in regions})
    beyond = F.lit(None).cast("string")
    for name, reason in (excluded or {}).items():
        beyond = F.when(kind == name, F.lit(reason)).otherwise(beyond)
    ran = F.when(rid.isNotNull(), executed(F.col("orig_bytes"), needs))
    return out.drop("label_class").withColumns({
        "label_binary": rid.isNotNull(),
        "label_class": kind,
        "label_source": F.when(rid.isNotNull(), "matched").otherwise("closed-world"),
        "label_quality": F.when(beyond.isNotNull(), OUT_OF_SPACE).when(region.isNotNull(), UNCERTAIN).otherwise(CERTAIN),
        "quarantine_reason": F.coalesce(region, beyond),
        "label_executed": ran,
        "rule": lookup(rid, {w.rid: w.name for w in windows}),
        "rules_matched": F.col("nrules"),
    }).drop("qrid", "qnrules", "nrules")


def summary(labelled: DataFrame) -> DataFrame:
    """Per rule: flows, overlaps, executed and attempted."""
    return labelled.where("rid is not null").groupBy("label_class", "rule", "rid").agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("rules_matched") > 1).alias("overlaps"), count_where(F.col("label_executed")).alias("executed"), count_where(~F.col("label_executed")).alias("attempted")
    )


def breadth(labelled: DataFrame, orig: str = "orig_h", resp: str = "resp_h") -> DataFrame:
    """How many sources and destinations each rule claims."""
    return labelled.where("rid is not null").groupBy("rule").agg(F.countDistinct(col(orig)).alias("srcs"), F.countDistinct(col(resp)).alias("dsts"))


def bursts(labelled: DataFrame, windows: Sequence[Window], top: int = 10, orig: str = "orig_h", resp: str = "resp_h") -> DataFrame:
    """The largest ten-minute buckets of unmatched flows, with those that touch a known victim."""
    ips = sorted({v for w in windows for v in w.victims or ()})
    prefixes = sorted({w.subnet_prefix for w in windows if w.subnet_prefix})
    ends = (col(orig), col(resp))
    touched = any_of([h.isin(*ips) for h in ends if ips] + [h.startswith(p) for p in prefixes for h in ends])
    bucket = F.date_format(F.timestamp_seconds(F.floor(F.col("ts") / BURST_SECONDS) * BURST_SECONDS), "yyyy-MM-dd HH:mm")
    counted = labelled.where("rid is null").groupBy("capture", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), count_where(touched).alias("victim_flows"))
    return counted.orderBy(F.desc("n"), "capture", "bucket").limit(top)


def suspicious(buckets: DataFrame, flows: int) -> DataFrame:
    """Buckets that look like an attack nobody declared."""
    return buckets.where((F.col("n") > max(BURST_FLOWS, BURST_SHARE * flows)) & (F.col("victim_flows") > VICTIM_SHARE * F.col("n")))
