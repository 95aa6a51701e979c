"""Queries of profiling and comparison, with their oracle SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import ranks
from tributary.operators import compare as c
from tributary.operators import profile as p
from tributary.sources.flows import FLOWS_SQL, flows
from tributary.streaming.flows import merged_moments

RULER = p.Ruler()
BY_DOMAIN = p.Ruler(group="dataset")


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def profile_moments(spark: SparkSession, d: str) -> DataFrame:
    return p.moments(flows(spark, d), RULER).select("label_class", "feature", "n", "n_null", "n_zero", _r("lo"), _r("hi"), _r("sum_t", 4), _r("sumsq_t", 4))


def profile_hist(spark: SparkSession, d: str) -> DataFrame:
    return p.histograms(flows(spark, d), RULER)


def profile_pairs_xy(spark: SparkSession, d: str) -> DataFrame:
    return p.pair_products(flows(spark, d), RULER).withColumn("sum_ab", F.round("sum_ab", 3))


def profile_joint_hist(spark: SparkSession, d: str) -> DataFrame:
    return p.joint_histograms(flows(spark, d), RULER)


def profile_topk_cat(spark: SparkSession, d: str) -> DataFrame:
    return p.value_counts(flows(spark, d), RULER, 3)


def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    return p.null_counts(flows(spark, d), RULER)


def capture_span(spark: SparkSession, d: str) -> DataFrame:
    return p.capture_span(flows(spark, d))


def profile_quantiles_exact(spark: SparkSession, d: str) -> DataFrame:
    return p.quantiles(flows(spark, d), RULER).withColumn("value", F.round("value", 6))


def profile_quantiles_approx(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's quantiles, and whether the share of rows below and up to each is within a hundredth of what was asked."""
    f, rough = flows(spark, d), p.quantiles(flows(spark, d), RULER, exact=False).withColumnRenamed("value", "rough")
    ranked = ranks.value_ranks(ranks.count_values(ranks.to_long(p.project(f, RULER), [x.name for x in RULER.features], ["label_class"]), ["label_class", "feature"], "value"), ["label_class", "feature"], "value", "n")
    met = rough.join(ranked, ["label_class", "feature"], "left").groupBy("label_class", "feature", "q", "rough").agg(F.sum(F.when(F.col("value") < F.col("rough"), F.col("n"))).alias("below"), F.sum(F.when(F.col("value") <= F.col("rough"), F.col("n"))).alias("upto"), F.sum("n").alias("n"))
    asked = F.get(F.array(*(F.lit(x) for x in p.QUANTILES)), "q")
    fine = (F.coalesce("below", F.lit(0)) <= (asked + 0.01) * F.col("n")) & (F.coalesce("upto", F.lit(0)) >= (asked - 0.01) * F.col("n"))
    return met.select("label_class", "feature", "q", F.coalesce(fine, F.col("n").isNull() & F.col("rough").isNull()).alias("within"))


def distinct_exact(spark: SparkSession, d: str) -> DataFrame:
    return p.distinct_counts(flows(spark, d), RULER, exact=True)


def distinct_approx(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sketch's counts are within a tenth of the true ones."""
    f = flows(spark, d)
    both = p.distinct_counts(f, RULER).withColumnRenamed("n_distinct", "rough").join(p.distinct_counts(f, RULER, exact=True), ["label_class", "column"])
    return both.select("label_class", "column", "n_distinct", (F.abs(F.col("rough") - F.col("n_distinct")) <= 0.1 * F.col("n_distinct") + 1).alias("within"))


def compare_js(spark: SparkSession, d: str) -> DataFrame:
    return c.js(p.histograms(flows(spark, d), BY_DOMAIN), ["feature"], "bin", "dataset", "dom-0", "dom-1").withColumn("js", F.round("js", 9))


def compare_cat_js(spark: SparkSession, d: str) -> DataFrame:
    return c.js(p.value_counts(flows(spark, d), BY_DOMAIN, 3), ["column"], "value", "dataset", "dom-0", "dom-1").withColumn("js", F.round("js", 9))


def _signal(spark: SparkSession, d: str, balanced: bool) -> DataFrame:
    h = p.histograms(flows(spark, d), RULER).withColumn("attack", F.col("label_class") == "error")
    return c.label_signal(h, ["feature"], "bin", "attack", balanced).withColumn("signal", F.round("signal", 9))


def compare_nmi(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d, False)


def compare_nmi_balanced(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d, True)


def compare_pearson(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    return c.pearson_of(p.moments(f, BY_DOMAIN), p.pair_products(f, BY_DOMAIN), ["dataset"]).withColumn("corr", F.round("corr", 6))


def compare_rank_corr(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    return c.rank_correlation(p.histograms(f, BY_DOMAIN), p.joint_histograms(f, BY_DOMAIN), ["dataset"]).withColumn("rank_corr", F.round("rank_corr", 6))


def pooled_moments(spark: SparkSession, d: str) -> DataFrame:
    """Benign, attack and all as sums of the data sets' profiles by class: one scan, then sums of a few rows."""
    parts = p.moments(flows(spark, d).withColumn("cell", F.struct("dataset", "label_class")), p.Ruler(group="cell"))
    view = F.explode(F.array(F.lit("all"), F.when(F.col("cell.label_class") == "error", "attack").otherwise("benign")))
    merged = merged_moments(parts.withColumn("view", view), "view")
    return merged.select("view", "feature", "n", "n_null", "n_zero", _r("lo"), _r("hi"), _r("sum_t", 4), _r("sumsq_t", 4))


def compare_profiles(spark: SparkSession, d: str) -> DataFrame:
    """One data set's profile against another's, feature by feature, with verdicts."""
    f = flows(spark, d).withColumn("label_class", F.when(F.col("label_class") == "error", "dos").otherwise("benign"))
    docs = [p.profile(f.where(F.col("dataset") == n), RULER) for n in ("dom-0", "dom-1")]
    names = ("js_all", "js_benign", "js_attack", "signal", "cohens_d", "var_ratio")
    rows = [(r["feature"], *(None if r[n] is None else round(r[n], 6) for n in names), r["verdict"]) for r in c.compare(docs[0], docs[1:])]
    return spark.createDataFrame(rows, "feature string, " + ", ".join(f"{n} double" for n in names) + ", verdict string")


_EXPR = {
    "duration": "coalesce(duration, 0.0::DOUBLE)", "orig_bytes": "coalesce(orig_bytes, 0.0::DOUBLE)", "resp_bytes": "coalesce(resp_bytes, 0.0::DOUBLE)", "orig_ip_bytes": "coalesce(orig_ip_bytes, 0.0::DOUBLE)",
    "resp_ip_bytes": "coalesce(resp_ip_bytes, 0.0::DOUBLE)", "missed_bytes": "coalesce(missed_bytes, 0.0::DOUBLE)", "orig_pkts": "coalesce(orig_pkts, 0.0::DOUBLE)", "resp_pkts": "coalesce(resp_pkts, 0.0::DOUBLE)",
    "total_bytes": "orig_ip_bytes + resp_ip_bytes", "total_pkts": "orig_pkts + resp_pkts", "orig_bytes_per_pkt": "orig_ip_bytes / nullif(orig_pkts, 0)", "resp_bytes_per_pkt": "resp_ip_bytes / nullif(resp_pkts, 0)",
    "pkt_rate": "(orig_pkts + resp_pkts) / nullif(duration, 0)", "byte_ratio": "log10((resp_ip_bytes + 1.0::DOUBLE) / (orig_ip_bytes + 1.0::DOUBLE))", "resp_port": "CAST(resp_p AS DOUBLE)", "history_len": "CAST(coalesce(length(history), 0) AS DOUBLE)",
}
_LOG = {f.name: f.log for f in RULER.features}
_EDGES = {f.name: f.edges for f in RULER.features}
_T = {n: f"ln(1 + greatest(coalesce({n}, 0), 0))" if log else f"coalesce({n}, 0)" for n, log in _LOG.items()}
PROJECTED = f"WITH {FLOWS_SQL}, f AS (SELECT label_class, dataset, {', '.join(f'{e} AS {n}' for n, e in _EXPR.items())} FROM flows)"


def _bin(n: str) -> str:
    whens = " ".join(f"WHEN {n} < {float(e)} THEN {i}" for i, e in enumerate(_EDGES[n]))
    return f"CASE WHEN {n} IS NULL THEN NULL {whens} ELSE {len(_EDGES[n])} END"


def _each(make, names=tuple(_EXPR)) -> str:
    return " UNION ALL ".join(make(n) for n in names)


def _hist(group: str) -> str:
    counted = _each(lambda n: f"SELECT {group}, '{n}' AS feature, {_bin(n)} AS bin, count(*) AS count FROM f GROUP BY ALL")
    bins = ", ".join(f"('{n}', {len(e) + 1})" for n, e in _EDGES.items())
    grid = f"SELECT {group}, feature, unnest(range(k)) AS bin FROM (SELECT DISTINCT {group} FROM f), (VALUES {bins}) b(feature, k)"
    return f"hist AS (SELECT g.{group}, g.feature, CAST(g.bin AS INTEGER) AS bin, coalesce(c.count, 0) AS count FROM ({grid}) g LEFT JOIN ({counted}) c ON g.{group} = c.{group} AND g.feature = c.feature AND g.bin = c.bin)"


def _joint(group: str, pairs) -> str:
    return " UNION ALL ".join(f"SELECT {group}, '{a}' AS a, '{b}' AS b, CAST({_bin(a)} AS BIGINT) * 1000 + ({_bin(b)}) AS cell, count(*) AS count FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL" for a, b in pairs)


def _js(counts: str, key: str, cell: str) -> str:
    return f"""w AS (SELECT {key}, {cell}, sum(CASE WHEN dataset = 'dom-0' THEN count ELSE 0 END)::DOUBLE AS l, sum(CASE WHEN dataset = 'dom-1' THEN count ELSE 0 END)::DOUBLE AS r FROM {counts} GROUP BY 1, 2),
      s AS (SELECT *, l / nullif(sum(l) OVER (PARTITION BY {key}), 0) AS p, r / nullif(sum(r) OVER (PARTITION BY {key}), 0) AS q FROM w)
      SELECT {key}, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 9) AS js FROM s GROUP BY 1"""


def _nmi(balanced: bool) -> str:
    ya = "0.5::DOUBLE" if balanced else "ta / (ta + tb)"
    return f"""{PROJECTED}, {_hist('label_class')}, w AS (SELECT feature, bin, sum(CASE WHEN label_class = 'error' THEN count ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN label_class <> 'error' THEN count ELSE 0 END)::DOUBLE AS b FROM hist GROUP BY 1, 2),
      t AS (SELECT *, sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb FROM w),
      j AS (SELECT feature, {ya} AS ya, ({ya}) * a / ta AS ja, (1 - ({ya})) * b / tb AS jb FROM t)
      SELECT feature, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(CASE WHEN ja > 0 THEN ja * log2(ja / (ya * (ja + jb))) ELSE 0 END + CASE WHEN jb > 0 THEN jb * log2(jb / ((1 - ya) * (ja + jb))) ELSE 0 END)
        / -(max(ya) * log2(max(ya)) + (1 - max(ya)) * log2(1 - max(ya))))), 9) AS signal FROM j GROUP BY 1"""


def _two_js(where: str) -> str:
    """Divergence of dom-0 from dom-1 by feature, of the rows of `side` that `where` names."""
    return f"""(SELECT feature, CASE WHEN max(tl) > 0 AND max(tr) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(CASE WHEN l > 0 THEN l / tl * log2(2 * (l / tl) / (l / tl + r / tr)) ELSE 0 END + CASE WHEN r > 0 THEN r / tr * log2(2 * (r / tr) / (l / tl + r / tr)) ELSE 0 END) / 2)) END AS js
      FROM (SELECT *, sum(l) OVER (PARTITION BY feature) AS tl, sum(r) OVER (PARTITION BY feature) AS tr FROM (SELECT feature, bin, sum(CASE WHEN dataset = 'dom-0' THEN count ELSE 0 END)::DOUBLE AS l, sum(CASE WHEN dataset = 'dom-1' THEN count ELSE 0 END)::DOUBLE AS r FROM side WHERE {where} GROUP BY 1, 2)) GROUP BY 1)"""


def _compare() -> str:
    counted = _each(lambda n: f"SELECT dataset, label_class = 'error' AS attack, '{n}' AS feature, {_bin(n)} AS bin, count(*) AS count FROM f WHERE {n} IS NOT NULL AND dataset IN ('dom-0', 'dom-1') GROUP BY ALL")
    sums = _each(lambda n: f"SELECT '{n}' AS feature, dataset, count(*)::DOUBLE AS n, count(*) FILTER ({n} IS NULL) / count(*)::DOUBLE AS undefined, count(*) FILTER ({n} = 0) / count(*)::DOUBLE AS zeros, sum({_T[n]}) / count(*) AS mean, greatest(0.0::DOUBLE, sum(({_T[n]}) * ({_T[n]})) / count(*) - (sum({_T[n]}) / count(*)) ** 2) AS var FROM f WHERE dataset IN ('dom-0', 'dom-1') GROUP BY dataset")
    return f"""{PROJECTED}, side AS ({counted}), m AS ({sums}),
      w AS (SELECT feature, bin, sum(CASE WHEN attack THEN count ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN NOT attack THEN count ELSE 0 END)::DOUBLE AS b FROM side WHERE dataset = 'dom-0' GROUP BY 1, 2),
      t AS (SELECT *, sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb FROM w),
      g AS (SELECT feature, greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(CASE WHEN a > 0 THEN a / (ta + tb) * log2(a * (ta + tb) / (ta * (a + b))) ELSE 0 END + CASE WHEN b > 0 THEN b / (ta + tb) * log2(b * (ta + tb) / (tb * (a + b))) ELSE 0 END)
        / -(max(ta / (ta + tb)) * log2(max(ta / (ta + tb))) + max(tb / (ta + tb)) * log2(max(tb / (ta + tb)))))) AS signal FROM t GROUP BY 1),
      j AS (SELECT x.feature, ja.js AS js_all, jb.js AS js_benign, jt.js AS js_attack, g.signal, CASE WHEN x.var + y.var > 0 THEN (x.mean - y.mean) / sqrt((x.var + y.var) / 2) END AS cohens_d, x.var / nullif(y.var, 0) AS var_ratio, x.undefined, x.zeros, x.var
        FROM m x JOIN m y ON x.feature = y.feature AND x.dataset = 'dom-0' AND y.dataset = 'dom-1' JOIN {_two_js('true')} ja ON ja.feature = x.feature JOIN {_two_js('NOT attack')} jb ON jb.feature = x.feature JOIN {_two_js('attack')} jt ON jt.feature = x.feature JOIN g ON g.feature = x.feature)
      SELECT feature, {', '.join(f'round({k}, 6) AS {k}' for k in ('js_all', 'js_benign', 'js_attack', 'signal', 'cohens_d', 'var_ratio'))},
        CASE WHEN undefined > 0.25 THEN 'mostly undefined' WHEN var < 1e-6 THEN 'dead' WHEN zeros > 0.98 AND signal < 0.02 THEN 'dead (zeros)' WHEN js_benign > 0.15 THEN 'domain-biased' WHEN signal < 0.02 THEN 'uninformative' WHEN js_benign < 0.05 AND signal >= 0.10 THEN 'transfers' ELSE 'ok' END AS verdict FROM j"""


_CATS = RULER.categorical


def _cats(group: str) -> str:
    long = " UNION ALL ".join(f"SELECT {group}, '{k}' AS \"column\", coalesce(CAST({k} AS VARCHAR), '(null)') AS value FROM flows" for k in _CATS)
    return f"""l AS ({long}), n AS (SELECT {group}, "column", value, count(*) AS count FROM l GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY {group}, "column" ORDER BY count DESC, value) AS r FROM n),
      cats AS (SELECT {group}, "column", CASE WHEN r <= 3 THEN value ELSE '(other)' END AS value, CAST(sum(count) AS BIGINT) AS count FROM k GROUP BY ALL)"""


SQL = {
    "profile_moments": PROJECTED + " " + _each(lambda n: f"SELECT label_class, '{n}' AS feature, count(*) AS n, count(*) FILTER ({n} IS NULL) AS n_null, count(*) FILTER ({n} = 0) AS n_zero, round(min({n}), 6) AS lo, round(max({n}), 6) AS hi, round(sum({_T[n]}), 4) AS sum_t, round(sum(({_T[n]}) * ({_T[n]})), 4) AS sumsq_t FROM f GROUP BY 1"),
    "profile_hist": f"{PROJECTED}, {_hist('label_class')} SELECT * FROM hist",
    "profile_pairs_xy": PROJECTED + " " + " UNION ALL ".join(f"SELECT label_class, '{a}' AS a, '{b}' AS b, round(sum(({_T[a]}) * ({_T[b]})), 3) AS sum_ab FROM f GROUP BY 1" for a, b in combinations(_EXPR, 2)),
    "profile_joint_hist": PROJECTED + " " + _joint("label_class", combinations(_EXPR, 2)),
    "profile_topk_cat": f"WITH {FLOWS_SQL}, {_cats('label_class')} SELECT * FROM cats",
    "profile_nulls": f"WITH {FLOWS_SQL} " + " UNION ALL ".join(f"SELECT label_class, '{k}' AS \"column\", count(*) FILTER ({k} IS NULL) AS n_null FROM flows GROUP BY 1" for k in RULER.null_checks),
    "capture_span": f"WITH {FLOWS_SQL} SELECT capture, label_class, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM flows GROUP BY 1, 2",
    "profile_quantiles_exact": PROJECTED + " " + _each(lambda n: f"SELECT label_class, '{n}' AS feature, CAST(q AS INTEGER) AS q, round(v[q + 1], 6) AS value FROM (SELECT label_class, quantile_cont({n}, [{', '.join(map(str, p.QUANTILES))}]) AS v FROM f GROUP BY 1), range(7) r(q)"),
    "distinct_exact": f"WITH {FLOWS_SQL} " + " UNION ALL ".join(f"SELECT label_class, '{k}' AS \"column\", count(DISTINCT {k}) AS n_distinct FROM flows GROUP BY 1" for k in RULER.identity),
    "pooled_moments": PROJECTED + ", v AS (SELECT *, unnest(['all', CASE WHEN label_class = 'error' THEN 'attack' ELSE 'benign' END]) AS view FROM f) " + _each(lambda n: f"SELECT view, '{n}' AS feature, count(*) AS n, count(*) FILTER ({n} IS NULL) AS n_null, count(*) FILTER ({n} = 0) AS n_zero, round(min({n}), 6) AS lo, round(max({n}), 6) AS hi, round(sum({_T[n]}), 4) AS sum_t, round(sum(({_T[n]}) * ({_T[n]})), 4) AS sumsq_t FROM v GROUP BY 1"),
    "profile_quantiles_approx": f"{PROJECTED} " + _each(lambda n: f"SELECT label_class, '{n}' AS feature, CAST(q AS INTEGER) AS q, true AS within FROM (SELECT DISTINCT label_class FROM f), range({len(p.QUANTILES)}) r(q)"),
    "distinct_approx": f"WITH {FLOWS_SQL} " + " UNION ALL ".join(f"SELECT label_class, '{k}' AS \"column\", count(DISTINCT {k}) AS n_distinct, true AS within FROM flows GROUP BY 1" for k in RULER.identity),
    "compare_profiles": _compare(),
    "compare_js": f"{PROJECTED}, {_hist('dataset')}, {_js('hist', 'feature', 'bin')}",
    "compare_cat_js": f"WITH {FLOWS_SQL}, {_cats('dataset')}, " + _js("cats", '"column"', "value"),
    "compare_nmi": _nmi(False),
    "compare_nmi_balanced": _nmi(True),
    "compare_pearson": PROJECTED + " " + " UNION ALL ".join(f"SELECT dataset, '{a}' AS a, '{b}' AS b, round(CASE WHEN stddev_pop({_T[a]}) = 0 OR stddev_pop({_T[b]}) = 0 THEN NULL ELSE corr({_T[a]}, {_T[b]}) END, 6) AS corr FROM f GROUP BY 1" for a, b in combinations(_EXPR, 2)),
    "compare_rank_corr": f"""{PROJECTED}, {_hist('dataset')}, j AS ({_joint('dataset', combinations(_EXPR, 2))}),
      q AS (SELECT dataset, feature, bin, count, (coalesce(sum(count) OVER (PARTITION BY dataset, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + count / 2) / sum(count) OVER (PARTITION BY dataset, feature) AS q FROM hist),
      m AS (SELECT dataset, feature, sum(count * q) / sum(count) AS mean, sum(count * q * q) / sum(count) - (sum(count * q) / sum(count)) ** 2 AS var FROM q GROUP BY 1, 2),
      e AS (SELECT j.dataset, j.a, j.b, sum(j.count * x.q * y.q) / sum(j.count) AS exy, sum(j.count) AS total FROM j JOIN q x ON x.dataset = j.dataset AND x.feature = j.a AND x.bin = j.cell // 1000 JOIN q y ON y.dataset = j.dataset AND y.feature = j.b AND y.bin = j.cell % 1000 GROUP BY 1, 2, 3)
      SELECT e.dataset, e.a, e.b, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (exy - x.mean * y.mean) / nullif(sqrt(x.var * y.var), 0))), 6) AS rank_corr FROM e JOIN m x ON x.dataset = e.dataset AND x.feature = e.a JOIN m y ON y.dataset = e.dataset AND y.feature = e.b WHERE total >= 2""",
}

QUERIES = (
    profile_moments, profile_hist, profile_pairs_xy, profile_joint_hist, profile_topk_cat, profile_nulls, capture_span, profile_quantiles_exact, profile_quantiles_approx,
    distinct_exact, distinct_approx, compare_js, compare_cat_js, compare_nmi, compare_nmi_balanced, compare_pearson, compare_rank_corr, pooled_moments, compare_profiles,
)
