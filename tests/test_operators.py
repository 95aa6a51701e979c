"""Planted cases of the other operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tributary.functions.ranks import binned_counts, quantiles, value_ranks
from tributary.operators import audit, compare, confident, fusion, governance, models, pools, profile, relevance, screen, validity, vectorise
from tributary.sources import lake


def test_validity_plants_one_violation_each(spark):
    cols = "uid string, orig_bytes double, resp_bytes double, orig_ip_bytes double, resp_ip_bytes double, orig_pkts double, resp_pkts double, duration double"
    ok = dict(orig_bytes=1.0, resp_bytes=1.0, orig_ip_bytes=50.0, resp_ip_bytes=50.0, orig_pkts=1.0, resp_pkts=1.0, duration=1.0)
    bad = {
        "non_negative_orig_bytes": {"orig_bytes": -1.0}, "non_negative_resp_bytes": {"resp_bytes": -1.0}, "non_negative_duration": {"duration": -1.0}, "orig_ip_bytes_cover_payload": {"orig_ip_bytes": 0.0},
        "resp_ip_bytes_cover_payload": {"resp_ip_bytes": 0.0}, "orig_bytes_need_packets": {"orig_pkts": 0.0}, "resp_bytes_need_packets": {"resp_pkts": 0.0}, "orig_rate_below_line_rate": {"orig_bytes": 1e12, "orig_ip_bytes": 1e13},
    }
    rows = [("ok", *ok.values()), ("null", *[None] * 7)] + [(k, *(ok | v).values()) for k, v in bad.items()]
    df = spark.createDataFrame(rows, cols)
    assert {r.invariant: r.violations for r in validity.violations(df).collect()} == dict.fromkeys(bad, 1)
    assert {r.uid for r in validity.valid_rows(df).collect()} == {"ok", "null"}
    assert validity.applicable(df.drop("duration"))[1] == ["non_negative_duration", "orig_rate_below_line_rate"]


def test_profiles_add_up(spark, sf):
    from tributary.sources.flows import flows
    from tributary.streaming.flows import merged_moments

    f, ruler = flows(spark, sf), profile.Ruler()
    halves = [profile.moments(f.where(F.col("uid").cast("long") % 2 == k), ruler) for k in (0, 1)]
    one = {(r.label_class, r.feature): r for r in profile.moments(f, ruler).collect()}
    for r in merged_moments(halves[0].union(halves[1])).collect():
        w = one[r.label_class, r.feature]
        assert (r.n, r.n_null, r.n_zero, r.lo, r.hi) == (w.n, w.n_null, w.n_zero, w.lo, w.hi) and math.isclose(r.sum_t, w.sum_t)


def test_profile_document_compares_with_itself(spark, sf):
    from tributary.sources.flows import flows

    doc = profile.profile(flows(spark, sf).drop("resp_p"))
    assert doc["skipped_features"] == ["resp_port"]
    json.dumps(doc, default=str)
    rows = compare.compare(doc, [doc])
    assert all(abs(r["js_all"]) < 1e-12 and (r["cohens_d"] or 0) == 0 for r in rows)
    other = json.loads(json.dumps(doc, default=str))
    other["edges"]["duration"] = [0, 1]
    with pytest.raises(ValueError, match="rulers"):
        compare.compare(doc, [other])


def test_views_add_up_and_reports_tell_drift_and_flips(spark):
    n = F.col("id")
    base = spark.range(400).select(n.cast("string").alias("uid"), F.when(n % 4 == 0, "dos").otherwise("benign").alias("label_class"), F.when(n % 4 == 0, "S0").otherwise("SF").alias("conn_state"), (n % 50).cast("double").alias("duration"), (n * 7 % 90).cast("double").alias("orig_bytes"), n.alias("resp_bytes"))
    one = base.withColumn("duration", F.when(F.col("label_class") == "dos", F.col("duration") + 60).otherwise(F.col("duration")))
    two = base.withColumn("duration", F.when(F.col("label_class") == "dos", F.col("duration") / 50).otherwise(F.col("duration") + 20)).withColumn("orig_bytes", F.col("resp_bytes").cast("double"))
    a, b = (profile.profile(x) for x in (one, two))
    whole = compare.view(profile.profile(one.union(two)))["all"]
    both = compare.pool([compare.view(a), compare.view(b)])["all"]
    assert both["n"] == whole["n"] == 800 and both["joint"] == whole["joint"] and both["categorical"] == whole["categorical"]
    for (x, y), r in compare.correlations(whole).items():
        assert (r is None) == (compare.correlations(both)[x, y] is None) and (r is None or abs(r - compare.correlations(both)[x, y]) < 1e-9)
    x = one.union(two).select(F.log(F.lit(1.0) + F.col("duration")).alias("x"), F.log(F.lit(1.0) + F.col("orig_bytes")).alias("y")).toPandas()
    assert abs(compare.correlations(whole)["duration", "orig_bytes"] - np.corrcoef(x.x, x.y)[0, 1]) < 1e-9
    out = compare.report(a, [b])
    assert [r["feature"] for r in out["flips"]] == ["duration"] and out["correlation_drift"][0]["change"] > 0.3 and len(out["rank_drift"]) <= 25
    assert [r["n"] for r in out["classes"]] == [400, 300, 100] and abs(out["categorical"][0]["js_all"]) < 1e-12 and out["macro"][0]["feature"] == "duration"
    with pytest.raises(ValueError, match="several populations"):
        compare.of_view({"a": a | {"view": "x"}, "b": b | {"view": "y"}})
    with pytest.raises(ValueError, match="sample"):
        compare.of_view({"a": a | {"partial": True}})
    assert list(compare.of_view({"a": a | {"view": "x"}, "b": b | {"view": "y"}}, "y")) == ["b"]


def test_rulers_of_many_bins_count_right(spark):
    edges = tuple(range(150))
    f = [profile.Feature(n, lambda n=n: F.col(n).cast("double"), edges, (n,)) for n in ("u", "v")]
    df = spark.range(3000).select(F.lit("c").alias("label_class"), (F.col("id") % 151).alias("u"), (F.col("id") * 7 % 149).alias("v"))
    got = {(r.cell // profile.CELL, r.cell % profile.CELL): r["count"] for r in profile.joint_histograms(df, profile.Ruler(f, (), (), ())).collect()}
    want = {(r.u + 1 if r.u < 150 else 150, r.v + 1): r["count"] for r in df.groupBy(F.least("u", F.lit(149)).alias("u"), "v").count().collect()}
    assert got == want
    with pytest.raises(ValueError, match="does not fit"):
        profile.joint_histograms(df, profile.Ruler([profile.Feature("u", f[0].expr, tuple(range(1000)), ("u",))], (), (), ()), [("u", "u")])


def test_a_flood_between_two_hosts_meets_by_time(spark):
    import time

    flows = spark.range(1_000_000).select(F.col("id").cast("string").alias("uid"), (F.col("id") / 8.0).alias("ts"), F.lit("a").alias("orig_h"), F.lit("b").alias("resp_h"), F.when(F.col("id") % 100_000 == 0, 3000.0).alias("duration"), F.lit(True).alias("label_binary"), F.lit("dos").alias("label_class"), F.lit("c").alias("capture"))
    log = spark.range(100_000).select((F.col("id") * 1.0).alias("ts"), F.lit("b").alias("src_ip"), F.lit("a").alias("dest_ip"), F.lit("s").alias("signature"))
    hits = audit.corroborate(flows, log)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "(_slot" in plan and "(_level" in plan
    began = time.perf_counter()
    r = hits.agg(F.sum("alerts").alias("n"), F.max("alerts").alias("most"), F.count(F.lit(1)).alias("rows")).first()
    assert r.rows == 1_000_000 and r.most == 3005 and abs(r.n - (800_000 * 4.125 + 8 * 3000)) < 3_000 and time.perf_counter() - began < 90
    near = audit.neighbours(flows.where("ts < 20000"), flows.where("uid in ('5', '70000')"), 600.0, 3)
    assert "(_slot" in near._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.candidate_uid, x.uid, x.rank) for x in near.collect()) == [("5", "3", 3), ("5", "4", 1), ("5", "6", 2), ("70000", "69998", 3), ("70000", "69999", 1), ("70000", "70001", 2)]


def test_every_class_is_scored_and_matrices_come_in_pieces(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), rng.normal(size=3).tolist(), "rare" if i % 500 == 0 else "often" if i % 2 else "other") for i in range(1500)] + [("x", [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "uid string, features array<double>, label_class string")
    got = models.out_of_fold(df, folds=3, epochs=1, most=60).collect()
    assert len(got) == 1500 and {r.label for r in got} == {0, 1, 2}
    fs = vectorise.FeatureSet("x", (vectorise.Numeric("a", "a", log=False), vectorise.Numeric("b", "b", log=False)))
    parts = list(vectorise.batches(spark.range(1000).selectExpr("cast(id as double) a", "cast(-id as double) b"), fs, 64))
    assert all(p.shape[0] <= 64 and p.shape[1] == 2 for p in parts) and sorted(np.concatenate(parts)[:, 0].tolist()) == list(range(1000))


def test_label_space_and_domains_are_looked_at_whole(spark):
    many = spark.range(3000).select(F.concat(F.lit("c"), F.col("id")).alias("label_class"))
    with pytest.raises(ValueError, match="c0"):
        fusion.refuse_unknown_classes(many, {f"c{i}" for i in range(1, 3000)})
    fusion.refuse_unknown_classes(many, {f"c{i}" for i in range(3000)})
    with pytest.raises(ValueError, match="domains"):
        relevance.worst_domain_auc(many.withColumn("x", F.lit(1.0)), ["x"], [], "label_class")


def test_js_divergence_bounds():
    assert compare.js_divergence([1, 0], [0, 1]) == 1.0 and compare.js_divergence([1, 1], [2, 2]) == 0.0 and compare.js_divergence([0], [1]) is None


@pytest.mark.parametrize("given,want", [((0.5, 1, 0, 0, 1), "mostly undefined"), ((0, 0, 0, 0, 1), "dead"), ((0, 1, 0.99, 0, 0), "dead (zeros)"), ((0, 1, 0, 0.2, 1), "domain-biased"), ((0, 1, 0, 0, 0.01), "uninformative"), ((0, 1, 0, 0.01, 0.2), "transfers"), ((0, 1, 0, 0.1, 0.2), "ok")])
def test_verdicts(given, want):
    assert compare.verdict(*given) == want


def test_value_ranks_have_no_single_partition_window(spark):
    df = spark.range(1000).select(F.lit("f").alias("feature"), (F.col("id") * 7 % 101).cast("double").alias("value")).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = value_ranks(df, ["feature"], "value", "n")
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.value, r.n, r.before) for r in ranked.collect())
    assert all(b == sum(x[1] for x in rows[:i]) for i, (_, _, b) in enumerate(rows))


def test_ntile_equals_window(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") % 10 != 0, F.col("id") % 13).cast("double").alias("x"))
    df = df.withColumn("y", F.col("uid").cast("long") % 3)
    got = {(r.bin, r.y): r.n for r in binned_counts(df, ["x"], "uid", 7, "y").collect()}
    want = {(r.bin or 0, r.y): r["count"] for r in df.withColumn("bin", F.when(F.col("x").isNotNull(), F.ntile(7).over(Window.partitionBy(F.col("x").isNull()).orderBy("x", "uid")))).groupBy("bin", "y").count().collect()}
    assert got == want


def test_quantiles_equal_percentiles_without_their_buffers(spark):
    df = spark.range(997).select((F.col("id") % 5).alias("g"), F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101).cast("double")).alias("x"))
    df = df.withColumn("g", F.when(F.col("g") != 3, F.concat(F.lit("g"), F.col("g"))))
    shares = (0.0, 0.01, 0.5, 0.77, 1.0)
    made = quantiles(df, ["g"], "x", shares)
    assert "percentile" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.g, r.q): r.value for r in made.collect()}
    for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("v")).collect():
        assert [got[r.g, i] for i in range(5)] == pytest.approx(list(r.v))


def test_screen_clusters_and_inflation():
    pairs = [("a", "b", 0.95), ("b", "c", -0.92), ("a", "d", 0.90), ("c", "d", None)]
    (c,) = screen.clusters(pairs, ["a", "b", "c", "d"])
    assert c == {"keep": "a", "members": ["a", "b", "c"], "strongest": 0.95}
    vif, singular = screen.inflation([("a", "b", 0.5)], ["a", "b"])
    assert not singular and abs(vif["a"] - 1 / 0.75) < 1e-12
    assert screen.inflation([("a", "b", 1.0)], ["a", "b"])[1]


def test_screen_runs(spark, sf):
    from tributary.sources.flows import flows

    out = screen.screen(flows(spark, sf), ["duration", "orig_bytes", "resp_bytes", "orig_ip_bytes"], ["proto"])
    assert out["verdicts"]["proto"] == "keep" and len(out["pearson"]) == 6
    with pytest.raises(ValueError, match="missing"):
        screen.screen(flows(spark, sf), ["nope"])


def test_relevance_tells_label_from_domain(spark):
    n = F.col("id")
    df = spark.range(2000).select(n.cast("string").alias("uid"), F.concat(F.lit("d"), n % 2).alias("dataset"), F.concat(F.lit("c"), F.floor(n / 2) % 2).alias("label_class"))
    df = df.withColumns({"label": F.hash("uid") % 10 + F.when(F.col("label_class") == "c1", 100).otherwise(0), "domain": F.hash("uid") % 10 + F.when(F.col("dataset") == "d1", 100).otherwise(0), "noise": F.hash("uid") % 1000})
    got = {r.feature: r.verdict for r in relevance.analyse(df, ["label", "domain", "noise"], []).collect()}
    assert got["label"] == "keep" and got["domain"] in ("drop", "hold") and got["noise"] == "keep"


def test_feature_set_refusals():
    n = vectorise.Numeric
    for numeric, words, match in (((), (), "no features"), ((n("a", "a"), n("a", "b")), (), "twice"), ((n("a", "a"), n("A", "b")), (), "case"), ((n("a", "a", scale=0.0),), (), "scale"), ((n("a", "a"),), (vectorise.Categorical("c", ()),), "vocabulary")):
        with pytest.raises(ValueError, match=match):
            vectorise.FeatureSet("x", tuple(numeric), tuple(words))


def test_matrix_of_nulls_and_unknown_words(spark):
    fs = vectorise.FeatureSet("x", (vectorise.Numeric("a", "a", indicator=True, centre=1.0, scale=2.0),), (vectorise.Categorical("p", ("tcp",)),))
    df = spark.createDataFrame([("1", None, None), ("2", -5.0, "tcp"), ("3", math.e - 1, "sctp")], "uid string, a double, p string")
    got = {r[0]: r[1:] for r in vectorise.matrix(df, fs).collect()}
    assert got == {"1": (-0.5, 1.0, 0.0, 1.0), "2": (-0.5, 0.0, 1.0, 0.0), "3": (0.0, 0.0, 0.0, 1.0)}
    assert vectorise.clamp_counts(df, fs).collect()[0].n_clamped == 1


def test_pools_are_disjoint_and_whole(spark):
    p = pools.Partition("s", (("a", 0.1), ("b", 0.9)), 1000)
    df = spark.range(5000).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") % 5 == 0, "out-of-space").alias("label_quality"))
    a, b = ({r.uid for r in p.rows(df, n).collect()} for n in "ab")
    assert not a & b and len(a | b) == 4000 and 300 < len(a) < 500
    for shares, buckets, match in (((("a", 0.5),), 1000, "sum"), ((("a", 1.0),), 50, "100"), ((("a", 1e-6), ("b", 1 - 1e-6)), 100, "no bucket")):
        with pytest.raises(ValueError, match=match):
            pools.Partition("s", shares, buckets)


def test_fusion_ladder(spark):
    rows = {"agree": ("x", 0.1, 0.1, "x", 0.9, 0.9), "a_conf": ("x", 0.9, 0.0, "y", 0.1, 1.0), "b_conf": ("x", 0.1, 1.0, "y", 0.9, 0.0), "a_margin": ("x", 0.5, 0.6, "y", 0.5, 0.5), "b_margin": ("x", 0.5, 0.4, "y", 0.5, 0.5), "tie": ("x", 0.5, 0.5, "y", 0.5, 0.5), "null": ("x", None, 0.1, "y", 0.5, 0.5)}
    schema = "uid string, label_class string, label_confidence double, label_margin double"
    a, b = (spark.createDataFrame([(k, *v[i : i + 3]) for k, v in rows.items()], schema) for i in (0, 3))
    got = {r.uid: (r.decision, r.margin_cause) for r in fusion.decisions(a, b).collect()}
    assert {k: v[0] for k, v in got.items()} == {"agree": "agreed", "a_conf": "first-confidence", "b_conf": "second-confidence", "a_margin": "first-margin", "b_margin": "second-fallback", "tie": "first-margin", "null": "second-fallback"}
    assert got["null"][1] == "null-confidence" and got["tie"][1] == "tied"
    with pytest.raises(ValueError, match="unique"):
        fusion.refuse_duplicates(a.union(a))


def test_confident_weights_centre_on_the_threshold(spark):
    rows = [(i, 0, [s, 1 - s]) for i, s in enumerate((0.1, 0.5, 0.7, 0.8, 0.9))]
    df = spark.createDataFrame(rows, "key long, label int, probs array<double>")
    assert confident.thresholds(df, 0.6).first().threshold == 0.7
    w = {r.key: r.weight for r in confident.weights(df, 0.6).collect()}
    assert abs(w[2] - 0.6) < 1e-12 and w[0] < w[1] < w[2] < w[3] < w[4] <= 1


def test_audit_guards(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("uid"), F.lit("c").alias("label_class"))
    with pytest.raises(ValueError, match="cap"):
        audit.availability(df, 20, 10)
    assert audit.offset_verdict({0: 40, -1: 20}, 50) == (0, True) and audit.offset_verdict({0: 40, -1: 30}, 50) == (0, False) and audit.offset_verdict({0: 19}, 19) == (0, False)


def test_self_pair_is_counted_once(spark):
    f = spark.createDataFrame([("1", 10.0, "a", "a", None, True, "x")], "uid string, ts double, orig_h string, resp_h string, duration double, label_binary boolean, label_class string")
    al = spark.createDataFrame([(12.0, "a", "a", "s")], "ts double, src_ip string, dest_ip string, signature string")
    assert audit.corroborate(f, al).first().alerts == 1


def test_models_learn_and_label_every_row(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 0] + x[:, 1] > 0, "a", "b")
    branch = models.fit_branch(x, y.tolist(), epochs=15)
    df = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(x)], "uid string, features array<double>")
    got = models.predict(df, branch).toPandas().set_index("uid").loc[[str(i) for i in range(600)]]
    assert (got.label_class.to_numpy() == y).mean() > 0.9 and (got.label_margin >= 0).all() and got.label_confidence.between(0.5, 1).all()
    assert models.Inert(3)(x).shape == (600, 3) and np.allclose(models.Inert(3).probabilities(x, 4), 0.25)
    a, b = models.views(x, x, 0.3, rng)
    assert a.shape == b.shape == x.shape and models.nt_xent(x, x, 0.5) < models.nt_xent(x, x[::-1].copy(), 0.5)


def test_reconstruction_judges_each_part_and_its_gradient_is_right():
    n, c = vectorise.Numeric, vectorise.Constraint
    fs = vectorise.FeatureSet("x", (n("t", "t", indicator=True), n("l", "l", centre=0.5, scale=2.0), n("r", "r"), n("s", "s", log=False)), (vectorise.Categorical("p", ("a", "b")),), (c("ratio", "t", "l", "r"), c("sum", "s", "l", "r", "sum")))
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(7, len(fs.columns()))))
    x[:, 1] = rng.integers(0, 2, 7)
    x[:, 5:] = np.eye(3)[rng.integers(0, 3, 7)]
    phi = {"ratio": 0.3, "sum": 0.2}
    z = x + rng.normal(size=x.shape) * 0.3
    z[:, 3] = np.abs(z[:, 3]) + 0.5
    loss, g = models.reconstruction(x, fs, phi)(z)
    step = rng.normal(size=z.shape) * 1e-6
    up, down = (models.reconstruction(x, fs, phi)(z + k * step)[0] for k in (1, -1))
    assert loss > 0 and abs((up - down) / 2 - (g * step).sum()) < 1e-6 * abs((g * step).sum())
    assert models.reconstruction(x, fs, phi)(z)[0] > models.reconstruction(x, fs)(z)[0]
    net, losses, encodes = models.pretrain_autoencoder(x, 4, 60, fs=fs, phi=phi, rate=1e-2)
    assert losses[-1] < 0.7 * losses[0] and encodes == 2


def test_parts_are_looked_up_and_held_to_their_contract():
    x = np.random.default_rng(0).normal(size=(60, 5))
    y = ["a" if r[0] > 0 else "b" for r in x]
    assert models.fit_branch(x, y, kind="inert", epochs=2).network(x).shape == (60, 2)
    with pytest.raises(KeyError, match="dense"):
        models.part("nope")

    class Narrow(models.Dense):
        name = "narrow"

        def head(self, latent, classes, seed):
            return models.Network.of([latent, classes + 1], seed)

    models.PARTS.register(Narrow())
    with pytest.raises(ValueError, match="head gives 3"):
        models.part("narrow")
    del models.PARTS.items["narrow"]


def test_contrastive_gradient_and_labels(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(8, 3))
    loss, g = models.contrast()(z)
    step = rng.normal(size=z.shape) * 1e-6
    assert abs((models.contrast()(z + step)[0] - loss) - (g * step).sum()) < 1e-10
    x = rng.normal(size=(600, 5))
    y = np.where(x[:, 0] + x[:, 1] > 0, "a", "b")
    branch = models.fit_contrastive(x, y.tolist(), rounds=2, epochs=8)
    df = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(x)], "uid string, features array<double>")
    got = models.predict_contrastive(df, branch).toPandas().set_index("uid").loc[[str(i) for i in range(600)]]
    assert (got.label_class.to_numpy() == y).mean() > 0.9 and got.view_agreement.mean() > 0.6


def test_projection_makes_targets_agree():
    n = vectorise.Numeric
    fs = vectorise.FeatureSet("x", (n("t", "t"), n("l", "l"), n("r", "r")), (), (vectorise.Constraint("c", "t", "l", "r"),))
    x = np.log1p(np.array([[9.0, 6.0, 3.0], [9.0, 6.0, 0.0]]))
    assert np.allclose(np.expm1(vectorise.project(x, fs)), [[2.0, 6.0, 3.0], [9.0, 6.0, 0.0]])


def test_governance(spark, sf, tmp_path):
    assert governance.composite_sha({"a": 1, "b": 2}) == governance.composite_sha({"b": 2, "a": 1}) != governance.composite_sha({"a": 2, "b": 1})
    df = governance.stamp(spark.createDataFrame([(True, "x", "matched", "certain", "c")], "label_binary boolean, label_class string, label_source string, label_quality string, capture string"), "m", "abc", "d")
    governance.verify_schema(df)
    with pytest.raises(ValueError, match="label_weight"):
        governance.verify_schema(df.drop("label_weight"))
    out = str(tmp_path / "out")
    governance.refuse_stale(spark, out, "abc")
    df.write.parquet(out)
    governance.refuse_stale(spark, out, "abc")
    with pytest.raises(ValueError, match="abc"):
        governance.refuse_stale(spark, out, "def")
    good = {"rules": ["a"], "claimed": ["a"], "rows": 2, "distinct": 2, "attack": 1, "benign": 1, "suspicious": 1, "widest": ("a", 2, 3)}
    r = governance.run_gate(governance.LABEL_CHECKS, good)
    assert r.passed and [a for _, a in r.advice] == ['widest is a: 2 sources, 3 destinations', '1 buckets look like an attack'] and len(governance.run_gate(governance.LABEL_CHECKS, good | {"claimed": [], "distinct": 1}).failures) == 2
    with pytest.raises(KeyError, match="not given"):
        governance.run_gate(governance.LABEL_CHECKS, {})
    point = governance.Point("method")
    (tmp_path / "p.py").write_text("@POINT.register\nclass X:\n    name = 'mine'\n")
    (tmp_path / "d.yaml").write_text("a: 1\n")
    point.load_code(str(tmp_path))
    point.load_declarations(str(tmp_path), dict)
    assert point.get("mine").name == "mine" and point.get("d") == {"a": 1}
    with pytest.raises(KeyError, match="there are"):
        point.get("nope")
    with pytest.raises(ValueError, match="reason"):
        governance.Experiment("e", {"x": "holdout"})


def test_conversion_mirrors_the_tree_and_survives_a_torn_line(spark, tmp_path):
    src = tmp_path / "in" / "cap1"
    src.mkdir(parents=True)
    (src / "conn.log").write_text('{"uid":"a","id.orig_h":"1.1.1.1"}\n{"uid":"b","id.orig_h":"2.2.2.2"}\n{"uid":"c","id.or')
    (src / "_meta.json").write_text("{}")
    report = lake.convert_tree(spark, str(tmp_path / "in"), str(tmp_path / "out"), formats=("parquet", "csv"))
    assert report == [{"path": "cap1/conn", "rows": 2, "error": None}]
    df = lake.with_capture(lake.read_union(spark, [str(tmp_path / "out" / "cap1" / "conn.parquet")]), str(tmp_path / "out"))
    assert {(r.uid, r["id.orig_h"], r.capture) for r in df.collect()} == {("a", "1.1.1.1", "cap1"), ("b", "2.2.2.2", "cap1")}
    assert lake.read_text_csv(spark, str(tmp_path / "out" / "cap1" / "conn.csv")).count() == 2
    with pytest.raises(ValueError, match="no paths"):
        lake.read_union(spark, [])


def test_schema_diff(spark):
    d = lake.schema_diff(spark.createDataFrame([], "a int, b string, c int").schema, spark.createDataFrame([], "b int, a int, d int").schema)
    assert d == {"only_left": ["c"], "only_right": ["d"], "types": {"b": ("string", "int")}, "order_differs": True}


def test_nothing_imports_llm_but_the_entry():
    import pathlib

    root = pathlib.Path(lake.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tributary.llm" not in path.read_text(), path
