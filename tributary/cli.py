"""Commands over a lake: python -m tributary.cli COMMAND ... Exit codes: 0 fine, 1 a gate failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tributary.operators import audit, compare, fusion, governance, models, pools, profile, relevance, schedule, screen, validity, vectorise
from tributary.session import session
from tributary.sources import alerts, declarations, lake, report, schedules


def _out(df) -> None:
    for r in df.collect():
        print(json.dumps(r.asDict(), default=str))


def _label(spark, a) -> int:
    windows, regions, sha = _schedule(a.manifest, a.taxonomy)
    labelled = schedule.label(lake.read_union(spark, a.paths), windows, regions, declarations.CORE_EXCLUDED, orig=a.orig, resp=a.resp).persist()
    _out(schedule.summary(labelled))
    total = labelled.count()
    burst = schedule.suspicious(schedule.bursts(labelled, windows, orig=a.orig, resp=a.resp), total).count() if "capture" in labelled.columns else 0
    result = governance.run_gate(governance.LABEL_CHECKS, governance.gate_context(labelled, [w.name for w in windows], burst, a.orig, a.resp))
    for name, wrong in result.failures + result.advice:
        print(f"{name}: {wrong}", file=sys.stderr)
    if not result.passed:
        return 1
    if a.out:
        governance.refuse_stale(spark, a.out, sha, a.force)
        stamped = governance.stamp(labelled, "schedule", sha, a.dataset)
        governance.verify_schema(stamped)
        print(lake.write_parquet(stamped, a.out), "rows written")
    return 0


def _run(spark, a) -> int:
    if a.command == "label":
        return _label(spark, a)
    if a.command == "ingest":
        done = lake.ingest(spark, a.files, a.folder, {"utc_offset": a.utc_offset} if a.utc_offset else None, a.replace)
        print(json.dumps({"copied": done["copied"], "replaced": done["replaced"]}))
        if a.seal:
            lake.seal(spark, a.folder)
        return 0
    if a.command == "behave":
        if a.plugins:
            models.LABELLERS.load_code(a.plugins)
        fs = declarations.load_feature_set(a.declaration).active() if a.declaration else vectorise.flow_features()
        df = lake.read_union(spark, a.paths)
        out = models.LABELLERS.get(a.method).label(vectorise.vectors(df, fs, ("uid", "label_class")), fs)
        if a.out:
            print(lake.write_parquet(out, a.out), "rows written")
        else:
            _out(out.groupBy("label_class").agg(F.count(F.lit(1)).alias("n"), F.avg("label_confidence").alias("confidence")))
        return 0
    if a.command == "convert":
        done = lake.convert_tree(spark, a.source, a.target, formats=a.formats.split(","))
        for r in done:
            print(json.dumps(r))
        return int(any(r["error"] for r in done))
    if a.command == "discover":
        for dataset, kinds in lake.catalog(spark, a.root).items():
            for kind, paths in kinds.items():
                print(json.dumps({"dataset": dataset, "log": kind} | lake.summarize(spark, paths)))
        return 0
    df = lake.read_union(spark, a.paths)
    if a.command == "verify":
        _out(validity.violations(df))
    elif a.command == "eda":
        df = df if a.include_invalid else validity.valid_rows(df)
        doc = profile.profile(lake.scan(df, None, a.sample, a.limit), None, a.view) | {"partial": bool(a.sample or a.limit)}
        lake.write_json(spark, a.out, doc)
        if a.html:
            views = compare.view(doc)
            lake.write_text(spark, a.html, report.profile_page(a.out, doc, views, compare.correlations(views["all"]), compare.rank_correlations(views["all"])))
    elif a.command == "screen":
        numeric, words = screen.candidates(df)
        found = screen.screen(df, numeric, words)
        print(json.dumps(found | {"spearman": None}, default=str))
        if a.declaration:
            _annotate(a, found["verdicts"], {n: {"vif": v} for n, v in found["vif"].items()})
    elif a.command == "relevance":
        numeric, words = screen.candidates(df)
        rows = relevance.analyse(df, numeric, words).collect()
        for r in rows:
            print(json.dumps(r.asDict()))
        if a.declaration:
            _annotate(a, {r.feature: r.verdict for r in rows}, {r.feature: {"relevance": r.relevance, "auc": r.auc} for r in rows})
    elif a.command == "pools":
        _out(pools.counts(df, declarations.load_partition(a.partition)))
    elif a.command == "fuse":
        other = lake.read_union(spark, [a.other])
        _out(fusion.explain(fusion.decisions(df, other)))
        if a.out:
            print(lake.write_parquet(fusion.fuse(df, other), a.out), "rows written")
    elif a.command == "audit":
        return _audit(spark, a, df)
    elif a.command == "oracle":
        log = alerts.read_alerts(spark, a.alerts)
        if a.manifest:  # whether the log's clock is that of the schedule
            windows = _schedule(a.manifest, None)[0]
            counts = {r.offset_hours: r.n for r in audit.offset_probe(log, windows).collect()}
            best, sure = audit.offset_verdict(counts, log.count())
            print(json.dumps({"counts": counts, "offset_hours": best, "conclusive": sure}))
            return 0
        hits = audit.corroborate(df, log).persist()
        _out(audit.corroboration_counts(hits))
        _out(audit.top_signatures(hits))
        _out(audit.dissent(hits))
    return 0


def _schedule(name: str, taxonomy: str | None):
    named = declarations.load_taxonomy(taxonomy)[0] if taxonomy else schedules.RAW_TO_CANONICAL
    known = schedules.SCHEDULES.get(name)  # a published schedule's name, else a file
    return declarations.read_schedule(known, named) if known else declarations.load_schedule(name, named)


def _annotate(a, verdicts, measures) -> None:
    import yaml

    with open(a.declaration, encoding="utf-8") as f:
        declarations.write_feature_set(a.declaration, declarations.annotated(yaml.safe_load(f), verdicts, measures))


def _audit(spark, a, df) -> int:
    """Candidates with evidence, as CSV and as a page; or the state and the benchmark of verdicts that came back."""
    if a.verdicts:
        verdicts = lake.read_text_csv(spark, a.verdicts)
        prior = df.select("uid", F.col("label_class").alias("prior_class"))
        said = verdicts.select("uid", "analyst_class").join(prior, "uid", "left").persist()
        _out(audit.state_counts(said))
        _out(audit.recall(said, df))
        _out(audit.confusion(said, df))
        others = {p: lake.read_union(spark, [p]) for p in (a.compare or "").split(",") if p}
        if others:
            _out(audit.agreement({"prior": df} | others))
        return 0
    _out(audit.availability(df, a.floor))
    if a.out or a.html:
        log = alerts.read_alerts(spark, a.alerts) if a.alerts else None
        chosen = audit.adjudication_rows(audit.candidates(df, a.seed, a.floor), log).drop("bucket").persist()
        if a.out:
            print(lake.write_csv(chosen.select(*(F.col(f"`{f.name}`") for f in chosen.schema if f.dataType.typeName() not in ("array", "map", "struct"))), a.out), "rows written")
        if a.html:
            context: dict[str, list] = {}
            if a.context > 0 and "capture" in df.columns:
                for r in audit.neighbours(df.select("uid", "ts", "capture", "orig_h", "resp_h", "label_class"), chosen, a.context).orderBy("candidate_uid", "rank").collect():
                    context.setdefault(r.candidate_uid, []).append(r.asDict())
            classes = [r[0] for r in df.select("label_class").distinct().orderBy("label_class").collect()]
            lake.write_text(spark, a.html, report.adjudication_page("Audit", [r.asDict() for r in chosen.collect()], classes, context))
    return 0


TEMPLATES = {
    "schedule.yaml": 'utc_offset: "+00:00"\nattacks:\n  - {name: Example, date: 2024-01-05, start: "09:00", end: "10:00", attacker_ips: [10.0.0.1], victim_ips: [10.0.0.2]}\nquarantine: []\n',
    "taxonomy.yaml": "canonical_classes: {" + ", ".join(f"{c}: {c}" for c in declarations.CANONICAL) + "}\nraw_to_canonical: {Example: dos}\nrequires_payload: []\n",
    "partition.yaml": "seed: change-me\npools: {train: {share: 0.8}, held: {share: 0.2}}\nexclude: [out-of-space]\n",
    "features.yaml": "name: example\nnumeric: {duration: {}, orig_bytes: {missing_indicator: true}}\ncategorical: {proto: {vocabulary: [tcp, udp]}}\n",
    "experiment.yaml": "name: example\ndatasets: {first: train, second: {role: holdout, reason: unseen network}}\n",
}


def _init(folder: str) -> int:
    """A folder of declarations to begin with; files that are there stay."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, text in TEMPLATES.items():
        path = Path(folder) / name
        print(path, "stays" if path.exists() else "written")
        if not path.exists():
            path.write_text(text, encoding="utf-8")
    return 0


def _config(spark, root: str) -> int:
    for name, zone in declarations.ZONES.items():
        print(json.dumps({"zone": name, "folder": "/".join([root, name, *(f"{{{k}}}" for k in zone.folders)]), "population": zone.population}))
    keys = ("spark.master", "spark.sql.shuffle.partitions", "spark.checkpoint.dir", "spark.sql.session.timeZone")
    print(json.dumps({k: spark.conf.get(k, None) for k in keys}))
    return 0


def _compare(spark, a) -> int:
    """One profile against others; --out writes each against the rest and takes away what an earlier run left there."""
    docs = compare.of_view({p: json.loads(lake.read_text(spark, p)) for p in dict.fromkeys([a.profile, *a.others])}, a.view)
    if a.profile not in docs:
        raise ValueError(f"{a.profile} is not of population {a.view!r}")
    found = compare.report(docs[a.profile], [d for p, d in docs.items() if p != a.profile] or [docs[a.profile]])
    for r in found["features"]:
        print(json.dumps(r))
    if a.html:
        lake.write_text(spark, a.html, report.comparison_page(a.profile, found))
    if a.out:
        made, entries = set(), []
        for p, d in docs.items():
            rest = [x for q, x in docs.items() if q != p]
            if rest:
                name, one = f"compare_{Path(p).stem}", compare.report(d, rest)
                lake.write_json(spark, f"{a.out}/{name}.json", one)
                lake.write_text(spark, f"{a.out}/{name}.html", report.comparison_page(p, one))
                made |= {f"{name}.json", f"{name}.html"}
                entries.append({"href": f"{name}.html", "name": Path(p).stem, "drift": one["correlation_drift"][0]["change"] if one["correlation_drift"] else None, "flips": len(one["flips"])})
        lake.write_text(spark, f"{a.out}/index.html", report.index_page("Comparisons", entries))
        for path, _ in lake.list_files(spark, a.out):
            name = path.rsplit("/", 1)[-1]
            if name.startswith("compare_") and name not in made:
                lake.remove(spark, path)
                print("removed", name, file=sys.stderr)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tributary", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    flags = {
        "label": ("--manifest! --taxonomy --out --dataset=data --orig=orig_h --resp=resp_h", ("--force",)),
        "behave": ("--method=behavioural --declaration --plugins --out", ()), "verify": ("", ()), "eda": ("--out! --html --view --sample:float --limit:int", ("--include-invalid",)), "screen": ("--declaration", ()), "relevance": ("--declaration", ()), "pools": ("--partition!", ()),
        "fuse": ("--other! --out", ()), "audit": ("--seed=audit --floor:int=200 --out --html --alerts --context:float=600 --verdicts --compare", ()), "oracle": ("--alerts! --manifest", ()),
    }
    for name, (valued, plain) in flags.items():
        q = sub.add_parser(name)
        q.add_argument("paths", nargs="+")
        for spec in valued.split():
            flag, _, default = spec.partition("=")
            flag, _, kind = flag.rstrip("!").partition(":")
            of = {"int": int, "float": float}.get(kind, str)
            q.add_argument(flag, type=of, required=spec.endswith("!"), default=of(default) if default else None)
        for flag in plain:
            q.add_argument(flag, action="store_true")
    q = sub.add_parser("convert")
    q.add_argument("source"), q.add_argument("target"), q.add_argument("--formats", default="parquet")
    sub.add_parser("discover").add_argument("root")
    q = sub.add_parser("compare")
    q.add_argument("profile"), q.add_argument("others", nargs="+"), q.add_argument("--html"), q.add_argument("--out"), q.add_argument("--view")
    q = sub.add_parser("ingest")
    q.add_argument("folder"), q.add_argument("files", nargs="+"), q.add_argument("--utc-offset"), q.add_argument("--replace", action="store_true"), q.add_argument("--seal", action="store_true")
    sub.add_parser("init").add_argument("folder")
    sub.add_parser("config").add_argument("root", nargs="?", default=".")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "init":
            return _init(a.folder)
        spark = session("tributary")
        if a.command == "compare":
            return _compare(spark, a)
        if a.command == "config":
            return _config(spark, a.root)
        return _run(spark, a)
    except (KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
