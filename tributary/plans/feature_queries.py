"""Queries of the feature screen and of relevance, with their oracle SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import relevance as r
from tributary.operators import screen as s
from tributary.sources.flows import FLOWS_SQL, flows
from tributary.sources.lake import read_table

NUMERIC = ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "missed_bytes")
CATEGORICAL = ("proto", "service", "conn_state", "history")
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


def shape_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.shape(flows(spark, d), NUMERIC, log=True))


def shape_stats_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.shape(read_table(spark, d, "lineitem"), LINE), 4)


def dominant_value(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.dominant(flows(spark, d), CATEGORICAL), 9)


def missingness(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.missingness(flows(spark, d), CATEGORICAL), 9)


def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.pearson_pairs(flows(spark, d), NUMERIC))


def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _round(s.spearman_pairs(flows(spark, d), NUMERIC))


def screen_verdicts(spark: SparkSession, d: str) -> DataFrame:
    df = flows(spark, d).withColumn("never", F.lit(None).cast("string")).withColumn("same", F.lit("x"))
    return _round(s.verdicts(df, [*CATEGORICAL, "never", "same"]), 9)


def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return _round(r.mutual_information(flows(spark, d), NUMERIC, CATEGORICAL, "label_class", "uid"), 9)


def domain_auc_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _round(r.domain_auc(flows(spark, d), NUMERIC, (), F.col("dataset") == "dom-1"), 9)


def domain_auc_categorical(spark: SparkSession, d: str) -> DataFrame:
    return _round(r.domain_auc(flows(spark, d), (), CATEGORICAL, F.col("dataset") == "dom-1"), 9)


def relevance_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _round(r.analyse(flows(spark, d), NUMERIC, CATEGORICAL), 9)


def joint_domain_probe(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the probe: two domains are told apart no worse than by chance; three are refused."""
    f = flows(spark, d)
    auc = r.joint_domain_auc(f.where(F.col("dataset").isin("dom-0", "dom-1")), NUMERIC, "dataset")
    three = r.joint_domain_auc(f.withColumn("dataset", F.concat(F.lit("x"), F.col("uid").cast("bigint") % 3)), NUMERIC, "dataset")
    return spark.createDataFrame([(auc is not None and 0.5 <= auc <= 1.0, three is None)], "above_chance boolean, three_refused boolean")


def correlation_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Over the features and derived ones, so that some are strongly correlated."""
    names = [*NUMERIC, "more_bytes", "twice_pkts"]
    df = flows(spark, d).withColumns({"more_bytes": F.col("orig_bytes") * 3 + F.col("orig_pkts"), "twice_pkts": F.col("orig_pkts") * -2})
    pairs = [tuple(x) for x in s.pearson_pairs(df, names).collect()]
    rows = [(c["keep"], ",".join(c["members"]), round(c["strongest"], 6)) for c in s.clusters(pairs, names)]
    return spark.createDataFrame(rows, "keep string, members string, strongest double")


def variance_inflation(spark: SparkSession, d: str) -> DataFrame:
    """Of three columns, for which the inverse has a closed form; and of all four, that each is one at least."""
    pairs = [tuple(x) for x in s.pearson_pairs(read_table(spark, d, "lineitem"), LINE).collect()]
    every, some = s.inflation(pairs, LINE)[0], s.inflation([x for x in pairs if x[0] in LINE[:3] and x[1] in LINE[:3]], LINE[:3])[0]
    rows = [(n, every[n] >= 1 - 1e-9, round(some[n], 5) if n in some else None) for n in LINE]
    return spark.createDataFrame(rows, "feature string, at_least_one boolean, vif_of_three double")


def standardisation(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    found, phi = s.standardisation(f, NUMERIC), s.suggested_phis(f, NUMERIC)
    rows = [(n, *found[n], phi[n]) for n in NUMERIC]
    return spark.createDataFrame(rows, "feature string, centre double, scale double, phi double")


def _each(make, names) -> str:
    return " UNION ALL ".join(make(n) for n in names)


def _shape(x: str, n: str, table: str, digits: int) -> str:
    q = ", ".join(f"round(quantile_cont({x}, {v}), {digits}) AS q{round(100 * v):02d}" for v in s.QUANTILES)
    return f"SELECT '{n}' AS feature, count({x}) AS n, round(min({x}), {digits}) AS lo, round(max({x}), {digits}) AS hi, round(avg({x}), {digits}) AS mean, round(stddev_pop({x}), {digits}) AS std, round(skewness({x}), {digits}) AS skewness, round(kurtosis({x}), {digits}) AS kurtosis, {q} FROM {table}"


def _dominant(names, table: str) -> str:
    return f"""c AS ({_each(lambda n: f"SELECT '{n}' AS feature, CAST({n} AS VARCHAR) AS value, count(*) AS n FROM {table} GROUP BY 2", names)}),
      dom AS (SELECT feature, value, n, n / sum(n) OVER (PARTITION BY feature) AS share FROM c QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value NULLS FIRST) = 1)"""


def _missing(names, table: str) -> str:
    return _each(lambda n: f"SELECT '{n}' AS feature, count(*) AS rows, count(*) FILTER ({n} IS NULL) AS n_null, count(DISTINCT CAST({n} AS VARCHAR)) AS n_distinct, count(*) FILTER ({n} IS NULL) / count(*)::DOUBLE AS null_share FROM {table}", names)


def _corr(a: str, b: str, table: str) -> str:
    flat = f"regr_sxx({a}, {b}) = 0 OR regr_syy({a}, {b}) = 0"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN {flat} THEN NULL ELSE corr({a}, {b}) END, 6) AS corr FROM {table}"


_BINNED = _each(lambda n: f"SELECT '{n}' AS feature, CAST(ntile(20) OVER (ORDER BY {n}, uid) AS VARCHAR) AS b, label_class AS y FROM flows WHERE {n} IS NOT NULL UNION ALL SELECT '{n}', '0', label_class FROM flows WHERE {n} IS NULL", NUMERIC)
_VALUES = _each(lambda n: f"SELECT '{n}' AS feature, coalesce({n}, '__null') AS b, label_class AS y FROM flows", CATEGORICAL)
_MI = f"""cells AS (SELECT feature, b, y, count(*) AS n FROM ({_BINNED} UNION ALL {_VALUES}) GROUP BY ALL),
  tot AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM cells),
  h AS (SELECT feature, -sum(p * log2(p)) AS h FROM (SELECT DISTINCT feature, y, ny / total AS p FROM tot) GROUP BY 1),
  mi AS (SELECT feature, greatest(sum(n / total * log2(n::DOUBLE * total / (nb::DOUBLE * ny))), 0.0::DOUBLE) AS mi FROM tot GROUP BY 1),
  info AS (SELECT mi.feature, mi, coalesce(mi / nullif(h, 0), 0) AS relevance FROM mi JOIN h ON mi.feature = h.feature)"""


def _auc(score: str, n: str, positive: str, domain: str = "") -> str:
    return f"""SELECT '{n}' AS feature{domain}, greatest(a, 1 - a) AS auc FROM (SELECT (sum(CASE WHEN pos THEN r ELSE 0 END) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)) AS a
      FROM (SELECT pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM (SELECT {score} AS s, ({positive}) AS pos FROM flows WHERE {n} IS NOT NULL)))"""


def _target(n: str, positive: str) -> str:
    return f"avg(CASE WHEN {positive} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY {n})"


def _clusters_sql() -> str:
    names = [*NUMERIC, "more_bytes", "twice_pkts"]
    pairs = " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, abs(corr({a}, {b})) AS r FROM t" for (i, a), (j, b) in combinations(enumerate(names), 2))
    listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"""WITH RECURSIVE {FLOWS_SQL}, t AS (SELECT *, orig_bytes * 3 + orig_pkts AS more_bytes, orig_pkts * -2 AS twice_pkts FROM flows), p AS ({pairs}), s AS (SELECT * FROM p WHERE NOT isnan(r) AND r > 0.9),
      e AS (SELECT a, b FROM s UNION SELECT b, a FROM s), reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
      head AS (SELECT a AS i, least(a, min(b)) AS h FROM reach GROUP BY a), names(i, n) AS (VALUES {listed})
      SELECT k.n AS keep, string_agg(m.n, ',' ORDER BY m.i) AS members, (SELECT round(max(r), 6) FROM s JOIN head z ON z.i = s.a WHERE z.h = head.h) AS strongest FROM head JOIN names m ON m.i = head.i JOIN names k ON k.i = head.h GROUP BY head.h, k.n"""


_POS = "dataset = 'dom-1'"
_ALL_AUC = " UNION ALL ".join([_auc(n, n, f"dataset = '{x}'") for n in NUMERIC for x in ("dom-0", "dom-1")] + [_auc(_target(n, f"dataset = '{x}'"), n, f"dataset = '{x}'") for n in CATEGORICAL for x in ("dom-0", "dom-1")])

SQL = {
    "shape_stats": f"WITH {FLOWS_SQL} " + _each(lambda n: _shape(f"ln(1 + abs({n}))", n, "flows", 6), NUMERIC),
    "shape_stats_lineitem": _each(lambda n: _shape(n, n, "lineitem", 4), LINE),
    "dominant_value": f"WITH {FLOWS_SQL}, {_dominant(CATEGORICAL, 'flows')} SELECT feature, value, n, round(share, 9) AS share FROM dom",
    "missingness": f"WITH {FLOWS_SQL}, m AS ({_missing(CATEGORICAL, 'flows')}) SELECT feature, rows, n_null, n_distinct, round(null_share, 9) AS null_share FROM m",
    "pearson_pairs": f"WITH {FLOWS_SQL} " + " UNION ALL ".join(_corr(a, b, "flows") for a, b in combinations(NUMERIC, 2)),
    "spearman_pairs": f"WITH {FLOWS_SQL}, ranked AS (SELECT {', '.join(f'CASE WHEN {n} IS NOT NULL THEN rank() OVER (ORDER BY {n} NULLS LAST) END AS {n}' for n in NUMERIC)} FROM flows) " + " UNION ALL ".join(_corr(a, b, "ranked") for a, b in combinations(NUMERIC, 2)),
    "screen_verdicts": f"""WITH {FLOWS_SQL}, t AS (SELECT *, CAST(NULL AS VARCHAR) AS never, 'x' AS same FROM flows), {_dominant([*CATEGORICAL, 'never', 'same'], 't')}, m AS ({_missing([*CATEGORICAL, 'never', 'same'], 't')})
      SELECT m.feature, round(null_share, 9) AS null_share, round(share, 9) AS share, CASE WHEN null_share > 0.5 THEN 'missing' WHEN share >= 0.99 THEN 'zero-variance' ELSE 'keep' END AS verdict FROM m JOIN dom ON m.feature = dom.feature""",
    "joint_domain_probe": "SELECT true AS above_chance, true AS three_refused",
    "correlation_clusters": _clusters_sql(),
    "variance_inflation": f"""WITH c AS (SELECT {', '.join(f"corr({a}, {b}) AS r{i}{j}" for (i, a), (j, b) in combinations(enumerate(LINE[:3]), 2))} FROM lineitem),
      d AS (SELECT *, 1 + 2 * r01 * r02 * r12 - r01 ** 2 - r02 ** 2 - r12 ** 2 AS det FROM c)
      SELECT feature, true AS at_least_one, CASE i WHEN 0 THEN round((1 - r12 ** 2) / det, 5) WHEN 1 THEN round((1 - r02 ** 2) / det, 5) WHEN 2 THEN round((1 - r01 ** 2) / det, 5) END AS vif_of_three FROM d, (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(LINE))}) v(i, feature)""",
    "standardisation": f"WITH {FLOWS_SQL} " + _each(lambda n: f"SELECT '{n}' AS feature, round(avg(ln(1 + abs({n}))), 6) AS centre, round(stddev_pop(ln(1 + abs({n}))), 6) AS scale, CASE WHEN median({n}) <> 0 THEN round(0.5::DOUBLE / abs(median({n})), 6) END AS phi FROM flows", NUMERIC),
    "mutual_information": f"WITH {FLOWS_SQL}, {_MI} SELECT feature, round(mi, 9) AS mi, round(relevance, 9) AS relevance FROM info",
    "domain_auc_numeric": f"WITH {FLOWS_SQL} SELECT feature, round(auc, 9) AS auc FROM (" + " UNION ALL ".join(_auc(n, n, _POS) for n in NUMERIC) + ")",
    "domain_auc_categorical": f"WITH {FLOWS_SQL} SELECT feature, round(auc, 9) AS auc FROM (" + " UNION ALL ".join(_auc(_target(n, _POS), n, _POS) for n in CATEGORICAL) + ")",
    "relevance_verdict": f"""WITH {FLOWS_SQL}, {_MI}, auc AS (SELECT feature, max(auc) AS auc FROM ({_ALL_AUC}) GROUP BY 1), j AS (SELECT info.*, auc.auc FROM info JOIN auc ON info.feature = auc.feature), cut AS (SELECT median(relevance) AS cut FROM j)
      SELECT feature, round(mi, 9) AS mi, round(relevance, 9) AS relevance, round(auc, 9) AS auc, CASE WHEN auc > 0.75 AND relevance < cut THEN 'drop' WHEN auc > 0.75 THEN 'hold' ELSE 'keep' END AS verdict FROM j, cut""",
}

QUERIES = (
    shape_stats, shape_stats_lineitem, dominant_value, missingness, pearson_pairs, spearman_pairs, screen_verdicts, mutual_information, domain_auc_numeric, domain_auc_categorical,
    relevance_verdict, joint_domain_probe, correlation_clusters, variance_inflation, standardisation,
)
