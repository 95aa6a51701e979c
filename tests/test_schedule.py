"""Windows, the range join, closed-world labels."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import schedule as s

ATTACK = s.Window(0, "a", "ddos", 100.0, 200.0, ("10.0.0.1",), ("10.0.0.2",), needs_payload=True)


def flow(uid, ts, orig, resp, orig_bytes=1):
    return (uid, float(ts), orig, resp, orig_bytes, "x")


def table(spark, rows):
    return spark.createDataFrame(rows, "uid string, ts double, orig_h string, resp_h string, orig_bytes long, label_class string")


def claimed(spark, windows, rows):
    return {r.uid: (r.rid, r.nrules) for r in s.match(table(spark, rows), windows).collect() if r.rid is not None}


def test_window_is_half_open_and_goes_both_ways(spark):
    rows = [flow("start", 100, "10.0.0.1", "10.0.0.2"), flow("end", 200, "10.0.0.1", "10.0.0.2"), flow("reply", 150, "10.0.0.2", "10.0.0.1"), flow("other", 150, "10.0.0.9", "10.0.0.2"), flow("null", 150, None, "10.0.0.2")]
    assert claimed(spark, [ATTACK], rows) == {"start": (0, 1), "reply": (0, 1)}


def test_lowest_rule_wins_and_overlaps_are_counted(spark):
    both = [s.Window(3, "late", "dos", 100.0, 200.0, None, ("10.0.0.2",)), ATTACK]
    assert claimed(spark, both, [flow("x", 150, "10.0.0.1", "10.0.0.2")]) == {"x": (0, 2)}


def test_subnet_without_attacker_claims_nothing(spark):
    w = s.Window(0, "sweep", "scan", 0.0, 999.0, None, None, "192.168.1.")
    assert claimed(spark, [w], [flow("x", 150, "1.1.1.1", "192.168.1.7")]) == {}


def test_subnet_with_attacker(spark):
    w = s.Window(0, "sweep", "scan", 0.0, 999.0, ("1.1.1.1",), None, "192.168.1.")
    assert claimed(spark, [w], [flow("x", 1, "1.1.1.1", "192.168.1.7"), flow("y", 1, "1.1.1.1", "192.168.2.7")]) == {"x": (0, 1)}


def test_a_window_needs_an_endpoint_and_a_span():
    with pytest.raises(ValueError, match="endpoint"):
        s.Window(0, "a", "b", 0.0, 1.0)
    with pytest.raises(ValueError, match="before"):
        s.Window(0, "a", "b", 1.0, 1.0, ("x",))


def test_no_windows_is_refused(spark):
    with pytest.raises(ValueError, match="benign"):
        s.match(table(spark, []), [])


def test_no_victims_and_any_peer_are_told_apart(spark, monkeypatch):
    rows = [flow("x", 1, "1.1.1.1", "2.2.2.2")]
    anyone, none = (s.Window(0, "a", "b", 0.0, 9.0, ("1.1.1.1",), v) for v in (None, ()))
    for most in (200, 0):
        monkeypatch.setattr(s, "MAX_INLINE", most)
        assert claimed(spark, [anyone], rows) == {"x": (0, 1)} and claimed(spark, [none], rows) == {}
        assert claimed(spark, [s.Window(0, "a", "b", 0.0, 9.0, (), ("2.2.2.2",))], rows) == {}


def test_prefixes_offsets_and_clocks_are_strict():
    with pytest.raises(ValueError, match="dot"):
        s.Window(0, "a", "b", 0.0, 1.0, ("x",), None, "192.168.10")
    assert [s.offset_hours(x) for x in ("-03:00", "+05:30", "00:00")] == [-3.0, 5.5, 0.0]
    for bad in ("-3", "UTC", "", "3", "+24:00", "-03:00:00"):
        with pytest.raises(ValueError):
            s.offset_hours(bad)
    with pytest.raises(ValueError):
        s.to_epoch("2017-07-04", "09:20:30", 0.0)
    entry = {"name": "A", "date": "2017-07-04", "start": "09:20", "end": "10:20", "attacker_ips": ["1.1.1.1"], "victim_subnet": "10.0.0.0/16"}
    with pytest.raises(ValueError, match="/24"):
        s.manifest_windows({"utc_offset": "-03:00", "attacks": [entry]})


def test_many_windows_keep_each_row_whatever_its_uid(spark, monkeypatch):
    windows = [s.Window(i, f"w{i}", "k", 100.0 * i, 100.0 * i + 150, ("10.0.0.1",)) for i in range(20)] + [s.Window(20, "year", "k", 0.0, 3.2e7, None, ("7.7.7.7",))]
    rows = [flow(None, 120, "10.0.0.1", "x"), flow("a", 120, "10.0.0.1", "x"), flow("a", 120, "10.0.0.1", "x"), flow("a", 990, "z", "z"), flow("b", 3.1e7, "q", "7.7.7.7"), flow("c", 130, None, None)]
    df = table(spark, rows).withColumn("bucket", F.lit("mine")).withColumn("rules", F.lit(1))
    want = sorted(map(str, s.match(df, windows).collect()))
    monkeypatch.setattr(s, "MAX_INLINE", 5)
    for most in (100_000, 10):
        monkeypatch.setattr(s, "MAX_ENTRIES", most)
        got = s.match(df, windows)
        assert sorted(map(str, got.collect())) == want and got.columns == [*df.columns, "rid", "nrules"] and len(want) == 6
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_execution_is_three_valued(spark):
    rows = [flow("ran", 150, "10.0.0.1", "10.0.0.2", 5), flow("tried", 150, "10.0.0.1", "10.0.0.2", 0), flow("unknown", 150, "10.0.0.1", "10.0.0.2", None), flow("benign", 1, "10.0.0.1", "10.0.0.2", 5)]
    got = {r.uid: (r.label_executed, r.label_class) for r in s.label(table(spark, rows), [ATTACK]).collect()}
    assert got == {"ran": (True, "ddos"), "tried": (False, "ddos"), "unknown": (None, "ddos"), "benign": (None, "benign")}


def test_quality_names_the_space_first_and_the_region_as_reason(spark):
    region = s.Window(0, "gap", "capture gap", 0.0, 999.0, None, ("10.0.0.2",))
    rows = [flow("x", 150, "10.0.0.1", "10.0.0.2"), flow("y", 1, "10.0.0.3", "10.0.0.2"), flow("z", 1, "1.1.1.1", "2.2.2.2")]
    got = {r.uid: (r.label_quality, r.quarantine_reason) for r in s.label(table(spark, rows), [ATTACK], [region], {"ddos": "too few"}).collect()}
    assert got == {"x": ("out-of-space", "capture gap"), "y": ("uncertain", "capture gap"), "z": ("certain", None)}


def test_manifest_times_and_extension():
    m = {"utc_offset": "-03:00", "attacks": [
        {"name": "A", "date": "2017-07-04", "start": "09:20", "end": "10:20", "attacker_ips": ["1.1.1.1"], "victim_ips": []},
        {"name": "B", "date": "2017-07-04", "start": "10:20", "end": "11:00", "attacker_ips": ["1.1.1.1"], "victim_subnet": "192.168.10.0/24"},
    ]}
    a, b = s.manifest_windows(m, {"A": "ddos"})
    assert (a.kind, a.victims, b.subnet_prefix) == ("ddos", None, "192.168.10.")
    assert a.t0 == 1499170800.0 and a.t1 == b.t0 and b.t1 - b.t0 == 40 * 60 + 60


def test_manifest_reports_all_errors():
    with pytest.raises(ValueError, match="attack 0.*attack 1"):
        s.manifest_windows({"utc_offset": "0", "attacks": [{"name": "x"}, {"name": "y", "date": "2017-01-01", "start": "1:00", "end": "2:00"}]})


def test_many_windows_give_the_same_by_time(spark, monkeypatch):
    windows = [s.Window(i, f"w{i}", "k", 50.0 * i, 50.0 * i + 700, ("10.0.0.1",), ("10.0.0.2",)) for i in range(30)]
    rows = [flow(str(t), t, "10.0.0.1", "10.0.0.2") for t in range(0, 2500, 37)]
    inline = claimed(spark, windows, rows)
    monkeypatch.setattr(s, "MAX_INLINE", 5)
    assert claimed(spark, windows, rows) == inline


def test_labelling_does_not_shuffle(spark, sf):
    from tributary.plans.label_queries import schedule_label

    assert "Exchange" not in schedule_label(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_bursts(spark):
    rows = [flow(str(i), 1200 + i, "9.9.9.9", "10.0.0.2") for i in range(5)]
    df = s.label(table(spark, rows).withColumn("capture", F.lit("c")), [ATTACK])
    (r,) = s.bursts(df, [ATTACK]).collect()
    assert (r.bucket, r.n, r.victim_flows) == ("1970-01-01 00:20", 5, 5)
