"""Operator 6: document quality by hierarchical empirical Bayes.

A logistic classifier over form features gives each document's evidence. Documents sum up, by site and by section
of a site, to expected numbers of good ones (labels, where there are any, instead of the classifier's word). A
section's share is shrunk towards its site's, a site's towards the whole corpus's, by as many pseudo-documents as
the spread among sites asks for. The posterior adds a section's log odds to the document's evidence.

A source's part before the first slash is its site; the part after it, else the language, the section. Null text
counts as empty: quality 0, not kept. Null source or lang count as empty strings. Several labels of a document: good
if any is. Rows that repeat a doc_id each get a row. An empty table gives no rows; without labels the evidence is 0.
Columns other than doc_id, text, source, lang (of labels: doc_id, quality) are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import join_by_class, map_arrow, materialise, small_batches, table

#: At most about so many labelled documents are fitted to, chosen by a hash of doc_id.
MAX_LEARN = 20_000
#: A document is kept from this posterior on.
KEEP = 0.5
_CLASS = np.array([1 if b in b" \t\r\n" else 2 if 65 <= b <= 90 else 3 if 97 <= b <= 122 or b >= 128 else 4 if 48 <= b <= 57 else 5 if b in b".,;:!?'\"()-" else 0 for b in range(256)])
NAMES = ("symbols", "capitals", "digits", "stops", "spaces", "word_length", "distinct_words", "distinct_lines", "log_words", "line_words", "long_words")


def describe(text: str) -> list[float]:
    """Form features of a text, each of moderate size."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_CLASS[b], minlength=6) / max(1, len(b))
    k = max(1, len(words))
    return [
        10 * n[0], 4 * n[2], 10 * n[4], 10 * n[5], 5 * n[1], len(b) / k / 6, len(set(words)) / k, len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words)) / 5, np.log1p(len(words) / max(1, len(lines))) / 3, sum(len(w) > 20 for w in words) / k * 10,
    ]


def _features(batches):
    for b in small_batches(batches, "text", 1 << 20):
        x = np.array([describe(t or "") for t in b.column(1).to_pylist()]).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), b.column(2)], [*NAMES, "good"])


@dataclass
class Classifier:
    weights: np.ndarray
    base: float  # log odds of a good document among those fitted to

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio: log odds less those before the text is seen."""
        return np.clip(_wide(x) @ self.weights - self.base, -12, 12)


def _wide(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones((len(x), 1)), x, x**2), 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
    """Logistic regression over features and their squares by Newton's method."""
    n = 2 * len(NAMES) + 1
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(n), 0.0)
    w, z, base = np.zeros(n), _wide(x), float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(n), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(w, base)


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_LEARN) -> Classifier:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    if total > max_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_docs / total)))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", (F.col("quality") > 0).cast("double").alias("good"))
    rows = map_arrow(sample, lambda: _features, ", ".join(f"{c} double" for c in (*NAMES, "good"))).toPandas()
    return fit(rows[list(NAMES)].to_numpy(), rows["good"].to_numpy())


def _score(model: Classifier):
    def over(batches):
        for b in small_batches(batches, "text", 1 << 20):
            texts = b.column(1).to_pylist()
            e = model.evidence(np.array([describe(t or "") for t in texts]).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(e), pa.array([not t or t.isspace() for t in texts], pa.bool_())], ["doc_id", "site", "section", "evidence", "blank"])

    return over


def _logit(p):
    return F.log(p / (F.lit(1.0) - p))


def posteriors(scored: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Each section's shrunk share of good documents (site, section, key, size, share), and the corpus's."""
    good = labels.where("quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).cast("double").alias("good"))
    counted = scored.join(good, "doc_id", "left").withColumn("p", F.coalesce("good", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("evidence") + F.col("base"))))))
    sections = materialise(counted.groupBy("site", "section").agg(F.count(F.lit(1)).alias("size"), F.sum("p").alias("sum_p")), "sections")
    sites = sections.groupBy("site").agg(F.sum("size").alias("n"), F.sum("sum_p").alias("s"))
    r = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r.n:
        return sections.withColumn("share", F.lit(0.5)), 0.5
    p0 = min(max(r.s / r.n, 1e-4), 1 - 1e-4)
    # Method of moments: what sites vary by beyond chance, as pseudo-documents of a Beta prior.
    between = max(0.0, (r.q - r.n * p0 * p0 - (r.k - 1) * p0 * (1 - p0)) / max(1e-9, r.n - r.nn / r.n)) if r.k > 1 else 0.0
    weight = min(max(p0 * (1 - p0) / between - 1, 2.0), 1e4) if between > 0 else 1e4
    near = sites.select("site", ((F.col("s") + weight * p0) / (F.col("n") + weight)).alias("site_share"))
    return sections.join(near, "site").withColumn("share", (F.col("sum_p") + weight * F.col("site_share")) / (F.col("size") + weight)), p0


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, site_share, section_share, quality (0 to 1) and kept of each document."""
    model = learn(docs, labels)
    site = F.split_part(F.coalesce("source", F.lit("")), F.lit("/"), F.lit(1))
    rest = F.split_part(F.coalesce("source", F.lit("")), F.lit("/"), F.lit(2))
    section = F.when(rest != "", rest).otherwise(F.coalesce("lang", F.lit("")))
    placed = docs.select("doc_id", "text", site.alias("site"), section.alias("section"))
    scored = materialise(map_arrow(placed, lambda: _score(model), "doc_id long, site string, section string, evidence double, blank boolean").withColumn("base", F.lit(model.base)), "scored")
    sections, p0 = posteriors(scored, labels)
    keyed = materialise(sections.select(F.concat_ws("\x1f", "site", "section").alias("key"), "size", "share", "site_share"), "shares") if "site_share" in sections.columns else None
    if keyed is None:
        return scored.select("doc_id", "evidence", F.lit(0.5).alias("site_share"), F.lit(0.5).alias("section_share"), F.lit(0.5).alias("quality"), F.lit(True).alias("kept"))
    joined = join_by_class(scored.withColumn("key", F.concat_ws("\x1f", "site", "section")), keyed, "key", "size", scored.count(), F.concat(F.lit("\x1e"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    odds = F.col("evidence") + _logit(F.least(F.greatest(F.col("share"), F.lit(1e-4)), F.lit(1 - 1e-4)))
    quality = F.when(F.col("blank"), F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    return joined.select("doc_id", "evidence", "site_share", F.col("share").alias("section_share"), quality.alias("quality")).withColumn("kept", F.col("quality") >= KEEP)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
