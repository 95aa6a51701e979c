"""Alerts, declarations, catalogues, reports and the command line."""

import json

import pytest

from tributary import cli
from tributary.sources import alerts, declarations, lake, report

MANIFEST = """
utc_offset: "+00:00"
attacks:
  - {name: DoS-Hulk, date: 2024-01-05, start: "00:00", end: "23:58", attacker_ips: [10.0.0.1], victim_ips: [192.168.0.3]}
  - {name: Sweep, date: 2024-01-05, start: "00:00", end: "23:58", attacker_ips: [10.0.0.1], victim_subnet: 192.168.1.0/24}
quarantine:
  - {reason: gap, date: 2024-01-06, start: "00:00", end: "01:00", victim_ips: [192.168.0.3]}
"""


def test_alerts(spark, tmp_path):
    rows = [{"timestamp": "2017-07-04T09:20:15.250000-0300", "event_type": "alert", "src_ip": "a", "dest_ip": "b", "alert": {"signature": "s"}}, {"timestamp": "2017-07-04T12:20:15.250000Z", "event_type": "alert", "src_ip": "a", "dest_ip": "b", "alert": {}}, {"timestamp": "x", "event_type": "dns"}]
    f = tmp_path / "eve.json"
    f.write_text("\n".join(map(json.dumps, rows)) + '\n{"timestamp": "2017-')
    got = alerts.read_alerts(spark, str(f)).collect()
    assert [(r.ts, r.signature) for r in got] == [(1499170815.25, "s"), (1499170815.25, None)]
    f.write_text(json.dumps(rows[0] | {"timestamp": "2017-07-04T09:20:15"}))
    with pytest.raises(ValueError, match="offset"):
        alerts.read_alerts(spark, str(f))
    assert alerts.alert_table(spark, []).count() == 0


def test_zones_say_what_they_need():
    keys = {"source": "s", "feature_space": "z_v1", "dataset": "d"}
    assert declarations.files("/lake/", "parquet", ("c1", "c2"), **keys) == ["/lake/parquet/s/z_v1/d/c1/**/conn.parquet", "/lake/parquet/s/z_v1/d/c2/**/conn.parquet"]
    assert declarations.files("/lake", "canonical", **keys) == ["/lake/canonical/s/z_v1/d/conn.parquet"]
    with pytest.raises(ValueError, match="method is missing"):
        declarations.folder("/lake", "labelled", **keys)
    with pytest.raises(ValueError, match="method is none"):
        declarations.folder("/lake", "raw", source="s", dataset="d", method="m")
    assert declarations.folder("/lake", "parquet", partial=True, source="s") == "/lake/parquet/s"
    assert [declarations.population("parquet"), declarations.population("labelled", method="fused"), declarations.population("csv")] == ["prelabel", "postlabel-fused", "csv"]


def test_declarations_are_annotated_and_experiments_load(tmp_path):
    from tributary.operators import governance

    doc = {"name": "x", "numeric": {"a": {"expr": "a"}, "b": None, "c": {}}, "categorical": {"p": {"vocabulary": ["t"]}}}
    out = declarations.annotated(doc, {"a": "hold", "b": "zero-variance", "p": "unmeasured"}, {"a": {"auc": 0.8123456789, "vif": None}})
    assert out["numeric"] == {"a": {"expr": "a", "verdict": "hold", "auc": 0.812346}, "b": {"verdict": "drop", "reason": "zero-variance"}, "c": {}} and out["categorical"]["p"]["verdict"] == "keep" and doc["numeric"]["b"] is None
    declarations.write_feature_set(tmp_path / "f.yaml", out)
    assert declarations.load_feature_set(tmp_path / "f.yaml").active().columns() == ["a", "c", "p=t", "p=__other"]
    (tmp_path / "e.yaml").write_text("datasets: {x: train, y: {role: holdout, reason: unseen}}\n")
    e = governance.load_experiment(tmp_path / "e.yaml", {"x": 1, "y": 1})
    assert (e.name, e.role("y"), e.role("z"), e.datasets("train")) == ("e", "holdout", "unassigned", ["x"])
    with pytest.raises(ValueError, match="unknown"):
        governance.load_experiment(tmp_path / "e.yaml", {"x": 1})
    (tmp_path / "e.yaml").write_text("datasets: {y: holdout}\n")
    with pytest.raises(ValueError, match="reason"):
        governance.load_experiment(tmp_path / "e.yaml")


def test_declarations_load(tmp_path):
    (tmp_path / "m.yaml").write_text(MANIFEST)
    windows, regions, sha = declarations.load_schedule(tmp_path / "m.yaml", {"DoS-Hulk": "dos", "Sweep": "portscan"})
    assert [(w.kind, w.needs_payload) for w in windows] == [("dos", True), ("portscan", False)] and regions[0].kind == "gap" and len(sha) == 12
    (tmp_path / "f.yaml").write_text("numeric: {a: {missing_indicator: true}, b: {transform: none}}\ncategorical: {p: {vocabulary: [x]}}\n")
    assert declarations.load_feature_set(tmp_path / "f.yaml").columns() == ["a", "a__missing", "b", "p=x", "p=__other"]
    (tmp_path / "p.yaml").write_text("seed: s\npools: {a: {share: 0.25}, b: {share: 0.75}}\nexclude: [out-of-space]\n")
    assert declarations.load_partition(tmp_path / "p.yaml").ranges() == [("a", 0, 250000), ("b", 250000, 1000000)]
    (tmp_path / "t.yaml").write_text("canonical_classes: {dos: x}\nraw_to_canonical: {a: ddos}\n")
    with pytest.raises(ValueError, match="ddos"):
        declarations.load_taxonomy(tmp_path / "t.yaml")
    with pytest.raises(ValueError, match="benign"):
        declarations.LabelSpace(("dos",))


def test_catalog_and_latest_extraction(spark, tmp_path):
    for d, c in (("x", "c1"), ("x", "c2"), ("y", "c1")):
        spark.range(3).write.parquet(str(tmp_path / "lake" / d / c / "conn.parquet"))
    got = lake.catalog(spark, str(tmp_path / "lake"))
    assert {d: {k: len(p) for k, p in v.items()} for d, v in got.items()} == {"x": {"conn": 2}, "y": {"conn": 1}}
    s = lake.summarize(spark, got["x"]["conn"])
    assert (s["files"], s["rows"], s["signatures"], s["partial"]) == (2, 6, 1, [])
    for space, at, whole in (("z_v1", "2024-01", True), ("z_v2", "2024-02", True), ("z_v3", "2024-03", False)):
        (tmp_path / "ex" / space / "x").mkdir(parents=True)
        (tmp_path / "ex" / space / "x" / "_extractor_meta.json").write_text(json.dumps({"feature_space": space, "extracted_at_utc": at, "complete": whole}))
    assert lake.latest_extraction(spark, str(tmp_path / "ex"), "x") == "z_v2"
    assert lake.latest_extraction(spark, str(tmp_path / "ex"), "x", allow_incomplete=True) in ("z_v2", "z_v3")
    with pytest.raises(ValueError, match="no extractions"):
        lake.latest_extraction(spark, str(tmp_path / "ex"), "nope")


def test_ingest_merges_a_manifest_and_seals(spark, tmp_path):
    a, b = tmp_path / "a.pcap", tmp_path / "b.pcap"
    a.write_bytes(b"one"), b.write_bytes(b"two")
    to = str(tmp_path / "raw")
    assert lake.ingest(spark, [a], to, {"utc_offset": "-03:00"})["copied"] == ["a.pcap"]
    assert lake.ingest(spark, [a, b], to)["copied"] == ["b.pcap"]
    m = json.loads((tmp_path / "raw" / "_manifest.json").read_text())
    assert sorted(m["files"]) == ["a.pcap", "b.pcap"] and m["utc_offset"] == "-03:00" and m["files"]["a.pcap"]["bytes"] == 3
    with pytest.raises(ValueError, match="utc_offset"):
        lake.ingest(spark, [a], to, {"utc_offset": "-04:00"})
    a.write_bytes(b"other")
    with pytest.raises(ValueError, match="a.pcap"):
        lake.ingest(spark, [a], to)
    assert lake.ingest(spark, [a], to, replace=True)["replaced"] == ["a.pcap"] and (tmp_path / "raw" / "a.pcap").read_bytes() == b"other"
    lake.seal(spark, to)
    with pytest.raises(ValueError, match="sealed"):
        lake.put_tree(spark, tmp_path / "raw", to)
    lake.unseal(spark, to)
    (tmp_path / "t" / "x").mkdir(parents=True)
    (tmp_path / "t" / "x" / "y.txt").write_text("z")
    assert lake.put_tree(spark, tmp_path / "t", to) == 1 and (tmp_path / "raw" / "x" / "y.txt").read_text() == "z"
    assert cli.main(["ingest", to, str(b), "--seal"]) == 0 and cli.main(["ingest", to, str(b)]) == 2


def test_reports_escape():
    html = report.adjudication_page("<t>", [{"uid": "<b>", "x": 1.23456}], ["dos"], {"<b>": [{"y": None}]})
    assert "<b>" not in html and "&lt;b&gt;" in html and "1.235" in html and "<rect" in report.bars([1, 2])


def test_commands(spark, sf, tmp_path, capsys):
    from tributary.sources.flows import flows

    f = str(tmp_path / "flows")
    flows(spark, sf).drop("resp_p").write.parquet(f)
    (tmp_path / "m.yaml").write_text(MANIFEST)
    assert cli.main(["verify", f]) == 0
    assert cli.main(["label", f, "--manifest", str(tmp_path / "m.yaml"), "--out", str(tmp_path / "out")]) in (0, 1)
    assert cli.main(["eda", f, "--out", str(tmp_path / "p.json"), "--html", str(tmp_path / "p.html")]) == 0
    assert cli.main(["compare", str(tmp_path / "p.json"), str(tmp_path / "p.json"), "--html", str(tmp_path / "c.html")]) == 0
    assert (tmp_path / "p.html").exists() and (tmp_path / "c.html").exists()
    other = str(tmp_path / "q.json")
    assert cli.main(["eda", f, "--out", other, "--view", "prelabel"]) == 0
    (tmp_path / "cmp").mkdir()
    (tmp_path / "cmp" / "compare_old.json").write_text("{}")
    assert cli.main(["compare", str(tmp_path / "p.json"), other]) == 2 and "population" in capsys.readouterr().err
    assert cli.main(["compare", other, other, "--view", "prelabel"]) == 0
    (tmp_path / "r.json").write_text((tmp_path / "q.json").read_text())
    assert cli.main(["compare", other, str(tmp_path / "r.json"), "--out", str(tmp_path / "cmp")]) == 0
    assert sorted(p.name for p in (tmp_path / "cmp").glob("[ci]*")) == ["compare_q.html", "compare_q.json", "compare_r.html", "compare_r.json", "index.html"]
    log = tmp_path / "eve.json"
    log.write_text(json.dumps({"timestamp": "2024-01-05T00:00:00+0000", "event_type": "alert", "src_ip": "10.0.0.1", "dest_ip": "192.168.0.3", "alert": {"signature": "s"}}) + "\n")
    assert cli.main(["audit", f, "--floor", "3", "--out", str(tmp_path / "a.csv"), "--html", str(tmp_path / "a.html"), "--alerts", str(log)]) == 0 and "oracle_alerted" in (tmp_path / "a.html").read_text()
    (tmp_path / "v.csv").write_text("uid,analyst_class\n1,click\n2,\n")
    assert cli.main(["audit", f, "--verdicts", str(tmp_path / "v.csv"), "--compare", f]) == 0 and "unadjudicated" in capsys.readouterr().out
    assert cli.main(["oracle", f, "--alerts", str(log), "--manifest", str(tmp_path / "m.yaml")]) == 0 and "conclusive" in capsys.readouterr().out
    assert cli.main(["init", str(tmp_path / "new")]) == 0 and declarations.load_schedule(tmp_path / "new" / "schedule.yaml") and declarations.load_partition(tmp_path / "new" / "partition.yaml")
    assert cli.main(["config", "/lake"]) == 0 and "{method}" in capsys.readouterr().out
    (tmp_path / "fs.yaml").write_text("name: x\nnumeric: {duration: {}, orig_bytes: {}}\n")
    assert cli.main(["screen", f, "--declaration", str(tmp_path / "fs.yaml")]) == 0 and "verdict: keep" in (tmp_path / "fs.yaml").read_text()
    (tmp_path / "plug").mkdir()
    (tmp_path / "plug" / "mine.py").write_text("from pyspark.sql import functions as F\nclass Mine:\n    name = 'mine'\n    def label(self, vectors, fs, **options):\n        return vectors.select('uid', F.lit('dos').alias('label_class'), F.lit(1.0).alias('label_confidence'))\nPOINT.register(Mine(), 'mine.py')\n")
    assert cli.main(["behave", f, "--method", "mine", "--plugins", str(tmp_path / "plug"), "--out", str(tmp_path / "mine.parquet")]) == 0
    assert cli.main(["behave", f, "--method", "nope"]) == 2 and "there are" in capsys.readouterr().err
    (tmp_path / "p.yaml").write_text("pools: {a: {share: 1}}\n")
    assert cli.main(["pools", f, "--partition", str(tmp_path / "p.yaml")]) == 2 and "seed" in capsys.readouterr().err


def test_published_schedules():
    from tributary.sources.schedules import RAW_TO_CANONICAL, SCHEDULES

    got = {n: declarations.read_schedule(m, RAW_TO_CANONICAL) for n, m in SCHEDULES.items()}
    assert {n: (len(w), len(r)) for n, (w, r, _) in got.items()} == {"cic-ids-2017": (18, 0), "cic-ids-2018": (22, 4), "cic-ddos-2019": (19, 15)}
    assert all(w.kind in declarations.CANONICAL for ws, _, _ in got.values() for w in ws)
    first = got["cic-ids-2017"][0][0]
    assert (first.t0, first.t1, first.needs_payload) == (1499170800.0, 1499174400.0 + 60, True)
    web, syn = got["cic-ddos-2019"][0][-3:-1]
    assert web.t1 == syn.t0  # back to back: the earlier window stops where the next begins
    attacks, regions, _ = got["cic-ddos-2019"]
    assert all(r.t1 <= min((a.t0 for a in attacks if a.t0 >= r.t0), default=r.t1) for r in regions)
