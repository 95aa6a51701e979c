"""Operator 5 against brute force, and the pipeline against plain versions of its stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import texts
from tests.llm.test_dedup import plain_components
from tests.llm.test_text import plain_spans
from tests.oracle import differences, views
from tributary.llm import language_id, pii, queries, vector_search

ODD = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1e9, -1e9]), (100, [0.0, 0.0]), (150, []), (6, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 3.0]), (7, [float("inf"), 0.0])]


def brute(rows, k=5):
    fine = [(i, np.floor(256 * np.array(e, float)).astype(np.int64)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, q in fine:
        if i % 50 == 0:
            best = sorted((-int(q @ c), j) for j, c in fine if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_search_equals_sql(spark, sf):
    assert differences(queries.op5_vector_search(spark, sf), views(sf), vector_search.ORACLE_SQL) == []


def test_search_of_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_search.op5_vector_search(spark, df).collect())) == brute(ODD)
    assert vector_search.op5_vector_search(spark, df.limit(0)).count() == 0


def test_small_blocks_and_ties_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 8) / 256.0).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_search.op5_vector_search(spark, df).collect())) == brute(rows)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(5)
    q, x = rng.normal(0, 50, (40, 30)), rng.normal(0, 50, (60, 30))
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    for a, b in ((q, x), (q @ turn, x @ turn)):
        last = np.inf
        for single in vector_search.levels(30):
            bound = vector_search.segment_features(a, single) @ vector_search.segment_features(b, single).T
            assert (bound + 1e-6 >= q @ x.T).all()
            last = min(last, bound.sum())
        assert np.allclose(vector_search.segment_features(a, 30) @ vector_search.segment_features(b, 30).T, q @ x.T) and last < np.inf


def met(data, queries, k=5):
    """All blocks one after another, as a task does: what is found, and the share of pairs that reach exact scores."""
    ids = np.arange(len(data))
    basis = np.linalg.eigh(data.T @ data)[1][:, ::-1]
    order = np.argsort(-(data * data).sum(1), kind="stable")
    blocks = [order[i : i + 256] for i in range(0, len(order), 256)]
    seed = ids[:512]
    q = ids[queries]
    asked = vector_search.Asked(q, data[q], vector_search.first_floor(q, data[q], seed, data[seed], k), basis, k)
    for b in blocks:
        asked.meet(b, data[b])
    return asked


def test_clustered_vectors_are_pruned_and_exact():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (24, 48))
    data = np.floor(256 * (centres[rng.integers(0, 24, 4000)] + rng.normal(0, 0.15, (4000, 48))))
    asked = met(data, slice(0, 4000, 50))
    assert asked.scored < 0.2 * asked.pairs, asked.scored / asked.pairs
    want = [(int(i), int(j), int(s)) for i in range(0, 4000, 50) for s, j in sorted(((data[i] @ data[j], -j) for j in range(4000) if j != i), reverse=True)[:5] for j in [-j]]
    assert sorted(asked.rows()) == sorted(want)


def test_slots_are_dealt_one_to_a_partition(spark):
    keys = vector_search.slot_keys(spark, 13)
    rows = keys.repartition(13, "place").select("slot", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.slot, r.part) for r in rows) == [(i, i) for i in range(13)]


def test_clustered_table_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (10, 24))
    rows = [(i, (centres[i % 10] + rng.normal(0, 0.1, 24)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_search.op5_vector_search(spark, df).collect())) == brute(rows)


@pytest.fixture(scope="module")
def stages(spark, sf, docs):
    out, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf).persist()
        out.append((name, at))
    return out


def test_stages_against_plain_versions(spark, sf, docs, stages):
    d = dict(stages)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "pii", "packing"]
    assert all(df.columns == docs.columns for n, df in stages[:-1])
    model = language_id.learn(docs.where(~language_id.held_out()))
    spoken = {i for i, t in texts(docs) if (r := language_id.label(model, [t])[0])[0] != "und" and r[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert {i for i, _ in texts(d["language_id"])} == spoken and len(spoken) > 0.97 * docs.count()
    last = {}
    for i, t in texts(d["language_id"]):
        last[t] = max(i, last.get(t, i))
    assert sorted(texts(d["exact_dedup"])) == sorted((i, t) for t, i in last.items())
    rows = texts(d["exact_dedup"])
    alone = {i for i, _, c in plain_components(rows) if i == c}
    assert sorted(texts(d["jaccard_join"])) == sorted(x for x in rows if x[0] in alone)
    for i, t in texts(d["jaccard_join"]):
        assert set(plain_spans(t)) <= set(pii.find(t)[1])
    assert sorted(texts(d["pii"])) == sorted((i, pii.replace(t, pii.find(t)[1])) for i, t in texts(d["jaccard_join"]))


def test_run_gives_the_last_stage(spark, sf, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(key).collect())) == sorted(map(tuple, stages[-1][1].select(key).collect()))


#: Names that the operators use inside, as columns of the input.
CLASHING = "digest keep_id group_size batch kept doc _k _h_group_size _c_keep_id fp label n spans held_out part bin row".split()


def test_stages_take_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    model = language_id.learn(odd_docs.where(~language_id.held_out()))
    for at in (odd_docs, no_docs):
        wide = at.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHING))
        kept = [(r.doc_id, r.text) for r in wide.collect()]
        for name, stage in corpus_pipeline.STAGES[:-1]:
            wide = stage(spark, wide, sf)
            rows = wide.collect()
            if name == "language_id":
                kept = [(i, t) for i, t in kept if (r := language_id.label(model, [t or ""])[0])[0] != "und" and r[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
            elif name == "exact_dedup":
                kept = [(i, t) for i, t in kept if i == max(j for j, u in kept if (u or "") == (t or ""))]
            elif name == "jaccard_join":
                alone = {i for i, _, c in plain_components([(i, t or "") for i, t in kept]) if i == c}
                kept = [(i, t) for i, t in kept if i in alone]
            else:
                kept = [(i, t and pii.replace(t, pii.find(t)[1])) for i, t in kept]
            assert sorted((r.doc_id, r.text) for r in rows) == sorted(kept), name
            assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHING), name
        got = corpus_pipeline.STAGES[-1][1](spark, wide, sf).collect()
        assert {r.doc_id for r in got} == {i for i, _ in kept}
