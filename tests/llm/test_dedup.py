"""Operators 2 and 4 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import texts
from tests.oracle import differences, views
from tributary.llm import exact_dedup, jaccard_join, queries
from tributary.llm.common import hot_threshold
from tributary.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    sets = defaultdict(list)
    for d, t in rows:
        sets[shingles(t)].append(d)
    keys = list(sets)
    head = list(range(len(keys)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(keys):
        shared = Counter(y for x in s for y in where[x])
        for y, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(keys[y]) - n):
                head[root(k)] = root(y)
        for x in s:
            where[x].append(k)
    least = {}
    for k, s in enumerate(keys):
        least[root(k)] = min(least.get(root(k), 1 << 60), *sets[s])
    return sorted((d, len(s), least[root(k)] if s else d) for k, s in enumerate(keys) for d in sets[s])


def test_exact_dedup_equals_sql(spark, sf):
    assert differences(queries.op2_exact_dedup(spark, sf), views(sf), exact_dedup.ORACLE_SQL) == []


@pytest.mark.parametrize("kind", ["odd_docs", "no_docs"])
def test_exact_dedup_of_odd_rows(spark, kind, request):
    df = request.getfixturevalue(kind)
    groups = defaultdict(list)
    for d, t in texts(df):
        groups[t].append(d)
    want = [(d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g]
    assert sorted(map(tuple, exact_dedup.op2_exact_dedup(spark, df).collect())) == sorted(want)


def test_a_hot_text_is_whole(spark):
    n = 3 * hot_threshold(0)
    df = spark.range(n + 50).selectExpr("id as doc_id", f"if(id < {n}, 'hot', cast(id as string)) as text")
    got = exact_dedup.op2_exact_dedup(spark, df).toPandas()
    assert len(got) == n + 50 and got.kept.sum() == 51 and set(got[got.group_size == n].keep_id) == {n - 1}


def test_the_index_outlives_a_batch_and_a_repeat(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "a"), (5, "c"), (6, None), (7, "")], "doc_id long, text string")
    kept = lambda df, b, i=index: {r.doc_id: (r.kept, r.keep_id) for r in exact_dedup.dedup_batch(df, i, b).collect()}
    assert kept(one, "1") == {1: (False, 3), 2: (True, 2), 3: (True, 3)}
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    assert kept(two, "2", again) == {4: (False, 3), 5: (True, 5), 6: (False, 7), 7: (True, 7)}
    assert kept(two, "2", again) == {4: (False, 3), 5: (True, 5), 6: (False, 7), 7: (True, 7)}
    assert again.rows().count() == 4


def test_batches_of_a_whole_table_equal_brute_force(spark, sf, docs, tmp_path):
    index, seen, rows = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4), {}, texts(docs)
    for b in range(3):
        part = docs.where(F.pmod("doc_id", F.lit(3)) == b)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_batch(part, index, str(b)).collect()}
        mine = defaultdict(list)
        for i, t in rows:
            if i % 3 == b:
                mine[t].append(i)
        for t, ids in mine.items():
            old = t in seen
            keep, size = seen.setdefault(t, (max(ids), len(ids)))
            assert all(got[i] == (keep, size, i == keep and not old) for i in ids)
        assert len(got) == sum(map(len, mine.values()))
    assert index.rows().count() == len(seen)
    joins = exact_dedup.dedup_batch(docs, index, "9")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joins or "Broadcast" in joins
    index.close()
    assert not spark.catalog.tableExists(index.name)


def test_columns_of_any_name_travel_beside_decisions(spark):
    names = "digest keep_id group_size batch kept doc _k".split()
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string").select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    got = exact_dedup.keep_last(df, spark)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, *(r[n] for n in names)) for r in got.collect()) == [(i, t, *(f"{n}{i}" for n in names)) for i, t in ((2, "a"), (3, "b"))]


def test_shingle_sets_are_exact():
    rnd = random.Random(2)
    items = [rnd.choice(["", " ", "\t"]) + rnd.choice((" ", "\n\n", "\x0b")).join(rnd.choice("ab A É x　y".split(" ")) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    assert [len(s) for s in shingle_sets(items)] == [len(shingles(t)) for t in items]
    sets = shingle_sets(items)
    for window in (1, 40):
        assert all((a == b).all() for a, b in zip(sets, shingle_sets(items, window=window), strict=True))
    for i in range(0, 400, 3):
        for j in range(i + 1, 400, 7):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(items[i]) & shingles(items[j]))


def families(seed, sizes, copies, edits):
    rnd, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(80)]
    for n in sizes:
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, n // edits))):
                if w:
                    k, op = rnd.randrange(len(w)), rnd.random()
                    if op < 0.4:
                        w[k] = rnd.choice(words)
                    elif op < 0.7:
                        del w[k]
                    else:
                        w.insert(k, rnd.choice(words))
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.3 else rnd.choice((" ", "\n")).join(w)))
    return rows


@pytest.mark.parametrize("sizes,copies,edits,common", [((0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45), 10, 20, 2), ((90, 150, 220), 50, 22, 3), ((60, 130), 60, 12, 64)])
def test_components_equal_brute_force(spark, monkeypatch, sizes, copies, edits, common):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rows = families(sum(sizes), sizes, copies, edits)
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(len(rows) + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(i % 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.op4_jaccard_join(spark, df).collect())) == plain_components(rows)


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_components_of_tables(spark, kind, request):
    df = request.getfixturevalue(kind)
    assert sorted(map(tuple, jaccard_join.op4_jaccard_join(spark, df).collect())) == plain_components(texts(df))


def test_sketches_never_differ_by_more_than_sets():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(0, 400)).astype(np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, 30).astype(np.uint64))
        bits = sum(int(x).bit_count() for x in (jaccard_join.odd_sketch(a) ^ jaccard_join.odd_sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
