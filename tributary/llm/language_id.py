"""Operator 7: language identification by word scores, narrowed by script, and Viterbi over the words of a text.

Each letter byte with its neighbours is a feature; a language's score for a word is the sum of its features' log
probabilities, less the mean over languages. The script of a word's first letter leaves only the languages that
use that script. Viterbi with a penalty for each switch labels the words; a text's language is the one of most
letters. Where no run of words gains enough by leaving the text's best language, the path is known to stay in it
and the search is left out.

Null text or text without a letter: `und`, score 0. An empty table gives no rows; where no labelled row may be
learnt from, every text is `und`. Rows that repeat a doc_id each get a row. Columns other than doc_id, text and
(for learning) lang are ignored. Words in a script that no learned language uses are scored by all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import map_arrow, small_batches

BUCKETS = 1 << 16
#: At most about so many labelled documents are learnt from, chosen by a hash of doc_id.
MAX_LEARN = 20_000
#: Characters whose features are held at once.
WINDOW_CHARS = 4 << 20
#: What leaving a language costs, in nats.
SWITCH = 14.0
#: A language uses a script if it has this share of its letters.
SCRIPT_SHARE = 0.01
#: First bytes from which a script's letters begin in UTF-8: Latin, Greek, Cyrillic, Hebrew, Arabic, Indic, other, kana and Han, Hangul, rare.
SCRIPT_FROM = (0x00, 0xCD, 0xD0, 0xD6, 0xD8, 0xE0, 0xE1, 0xE3, 0xEA, 0xF0)
SCRIPTS = len(SCRIPT_FROM)
_SCRIPT = np.searchsorted(np.array(SCRIPT_FROM), np.arange(256), "right") - 1
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_ANY_LETTER = regex.compile(r"\p{L}")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _hashed(b: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the letter bytes of b, of each with its neighbours, and where these letters are."""
    at = np.flatnonzero(letter)
    clean = np.where(letter, b, 32).astype(np.uint32)
    return (clean[at - 1] * np.uint32(0x9E3779B1) ^ clean[at] * np.uint32(0x85EBCA6B) ^ clean[at + 1] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(16), at


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case as bytes, a space before each and after all, and where each begins."""
    raw = [b" " + t.lower().encode() for t in texts]
    return np.frombuffer(b"".join([*raw, b" "]), np.uint8), np.cumsum([0, *map(len, raw[:-1])]) if raw else np.zeros(0, int)


def features(texts: list[str]):
    """Of the texts together: feature of each letter byte, first letter of each word, its script, first word of each text."""
    b, starts = _bytes(texts)
    letter = _LETTER[b]
    bucket, at = _hashed(b, letter)
    words = np.flatnonzero(~letter[at - 1]) if len(at) else at
    return bucket, words, _SCRIPT[b[at[words]]], np.searchsorted(at[words], starts)


def _count(batches):
    seen: dict[str, np.ndarray] = {}
    for b in small_batches(batches, "text"):
        texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
        for lang in set(langs):
            bucket, _, script, _ = features([t for t, x in zip(texts, langs) if x == lang])
            mine = seen.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
            mine[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
            mine[BUCKETS:] += np.bincount(script, minlength=SCRIPTS)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # (BUCKETS, languages)
    bar: np.ndarray  # (SCRIPTS, languages): 0, or a large number against languages that don't use the script


def learn(docs: DataFrame, max_docs: int = MAX_LEARN) -> Model:
    """From labelled documents; what comes to the driver is one number a language and feature."""
    labelled = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    total = labelled.count()
    if total > max_docs:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_docs / total)))
    rows = map_arrow(labelled, lambda: _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows.lang.unique())
    n = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    n[rows.bucket, np.searchsorted(langs, rows.lang)] = rows.n
    counts, scripts = n[:BUCKETS], n[BUCKETS:]
    log = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)) if langs else counts
    uses = scripts >= SCRIPT_SHARE * scripts.sum(0)
    return Model(langs, (log - log.mean(1, keepdims=True)).astype(np.float32) if langs else counts, np.where(uses | ~uses.any(1, keepdims=True), 0, 1e3))


def viterbi(scores: np.ndarray, switch: float = SWITCH, block: int = 20_000) -> np.ndarray:
    """The best labels of one text's words, given (words, languages) scores; ties go to staying, then to the first language.

    Of each step it keeps the best language before it and, as bits, which languages are entered from that one. The few
    numbers of a step are handled as Python floats, which is faster than arrays of a few.
    """
    best, tops, entered = scores[0].tolist(), [0], [0]
    for start in range(1, len(scores), block):
        for row in scores[start : start + block].tolist():
            most = max(best)
            bar = most - switch
            bits = 0
            if min(best) < bar:
                for k, b in enumerate(best):
                    if b < bar:
                        bits |= 1 << k
                        best[k] = bar
            tops.append(best.index(most))
            entered.append(bits)
            best = [b + x for b, x in zip(best, row)]
    path = [0] * len(scores)
    k = best.index(max(best))
    for t in range(len(scores) - 1, -1, -1):
        path[t] = k
        if entered[t] >> k & 1:
            k = tops[t]
    return np.array(path)


def _pieces(texts: list[str], window: int) -> Iterator[tuple[list[str], list[int]]]:
    """The texts, long ones cut at spaces, in groups of about `window` characters; and each piece's text."""
    group, owner, held = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not t:
            stop = t.find(" ", at + window) if len(t) - at > window else -1
            stop = len(t) if stop < 0 else stop
            group.append(t[at:stop]), owner.append(i)
            held, at = held + stop - at, stop
            if held >= window:
                yield group, owner
                group, owner, held = [], [], 0
            if not t:
                break
    if group:
        yield group, owner


def distinct_scores(model: "Model", words: pa.Array) -> np.ndarray:
    """Scores by language of words given as bytes of letters alone; they depend on nothing else."""
    n = len(words)
    ends, data = np.frombuffer(words.buffers()[1], np.int32)[: n + 1].astype(np.int64), np.frombuffer(words.buffers()[2], np.uint8)
    b = np.full(len(data) + n + 1, 32, np.uint8)
    b[np.arange(ends[-1]) + np.repeat(np.arange(1, n + 1), np.diff(ends))] = data[: ends[-1]]
    bucket, _ = _hashed(b, _LETTER[b])
    return np.add.reduceat(model.score[bucket], ends[:-1], axis=0).astype(np.float64) - model.bar[_SCRIPT[data[ends[:-1]]]]


def word_scores(model: Model, texts: list[str], window: int = WINDOW_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts together: scores of each word by language, its letters, and the first word of each text.

    A window's words are numbered first, and each distinct one is scored once.
    """
    scores, letters, count = [np.zeros((0, len(model.langs)))], [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for group, owner in _pieces(texts, window):
        b, starts = _bytes(group)
        letter = _LETTER[b]
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        begin, size = edge[0::2], edge[1::2] - edge[0::2]
        if len(begin):
            offsets = np.append(0, np.cumsum(size)).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(b[letter])]).dictionary_encode()
            scores.append(distinct_scores(model, coded.dictionary)[coded.indices.to_numpy()])
            letters.append(size)
            np.add.at(count, owner, np.diff(np.append(np.searchsorted(begin, starts), len(begin))))
    return np.concatenate(scores), np.concatenate(letters), np.append(0, np.cumsum(count))[:-1]


def label(model: Model, texts: list[str], switch: float = SWITCH, window: int = WINDOW_CHARS) -> list[tuple[str, float, str]]:
    """For each text its language, score and spans (language:first word-end word, comma-joined).

    Letters are taken in windows: besides one of these, a text needs some 100 bytes for each of its words.
    """
    k = len(model.langs)
    out = [("und", 0.0, "")] * len(texts)
    if not k:
        return out
    w, letters, first = word_scores(model, texts, window)
    words = letters
    if not len(words):
        return out
    ends = [*first[1:], len(words)]
    some = np.flatnonzero(np.array(ends) > first)
    starts = first[some]
    totals = np.add.reduceat(w, starts, axis=0)
    top = totals.argmax(1)
    doc_of = np.repeat(np.arange(len(some)), np.diff([*starts, len(words)]))
    loss = w - w[np.arange(len(w)), top[doc_of]][:, None]
    # For each other language, the most that a run of words gains over the text's best language.
    far = 1.0 + 2 * np.abs(loss).sum()
    run = np.cumsum(loss, 0) - (doc_of * far)[:, None]
    before = run - loss
    gain = np.maximum.reduceat(run - np.minimum.accumulate(before, 0), starts, axis=0).max(1)
    size = np.add.reduceat(letters, starts)
    for i, d in enumerate(some):
        if not _ANY_LETTER.search(texts[d]):
            continue
        a, b = int(starts[i]), int(ends[d])
        if gain[i] > switch / 2:
            path = viterbi(w[a:b], switch)
            share = np.bincount(path, letters[a:b], k)
            best = int(share.argmax())
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
            spans = ",".join(f"{model.langs[path[x]]}:{x}-{y}" for x, y in zip(cuts, cuts[1:]))
            mine = path == best
            logit, sure = (w[a:b][mine].sum(0) / max(1, letters[a:b][mine].sum())), share[best] / share.sum()
        else:
            best, spans, logit, sure = int(top[i]), f"{model.langs[top[i]]}:0-{b - a}", totals[i] / max(1, size[i]), 1.0
        p = np.exp(np.maximum(10 * (logit - logit.max()), -700))
        out[d] = (model.langs[best], float(sure * p[best] / p.sum()), spans)
    return out


def _predict(model: Model):
    def over(batches):
        for b in small_batches(batches, "text", WINDOW_CHARS):
            found = label(model, [t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, kind) for c, kind in zip(zip(*found), (pa.string(), pa.float64(), pa.string())))], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return over


def predict(docs: DataFrame, model: Model) -> DataFrame:
    return map_arrow(docs.select("doc_id", "text", held_out().alias("held_out")), lambda: _predict(model), "doc_id long, held_out boolean, lang_pred string, score double, spans string")


def _known(model: Model, least: float):
    def over(batches):
        for b in small_batches(batches, "text", WINDOW_CHARS):
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score, _ in label(model, texts)], pa.bool_()))

    return over


def filter_rows(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with at least this score."""
    return map_arrow(docs, lambda: _known(model, least), docs.schema)


def op7_language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, spans. Held-out rows are not learnt from."""
    return predict(docs, learn(docs.where(~held_out())))
