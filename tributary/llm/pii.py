"""Operator 3: personal data by candidate gradient boosting.

Base patterns with their checks (parts of an address, Luhn, numbers of digits) give spans that always stay.
Beside them, generators of high recall propose spans, which may overlap, of looser forms: numbers without a plus,
other separators, spelt-out signs. Boosted trees judge each from its format and the words before it; thresholds,
set on held-out examples for a high precision, select which are added. Added spans never overlap base spans or
each other (the surer one wins, then the earlier). The trees learn from examples made here by rule from a fixed
seed, of known truth, so a model depends on nothing but this module.

Null text counts as empty: no spans. Rows that repeat a doc_id each get a row. An empty table gives no rows.
Columns other than doc_id and text are ignored (redact() keeps them). Offsets count code points.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import boosting
from tributary.llm.common import map_arrow, small_batches

KINDS = ("email", "ip", "card", "phone")
# The base patterns of the contract. Where a pattern as it stands would try each place of a long run anew, it is
# searched from what it must hold: addresses from their sign, runs of digits from their first digit, without going back.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ANYTHING = re.compile(r"[0-9@]|\(at\)|\[at\]", re.I)
SIGN = re.compile(r"@|\(at\)|\[at\]", re.I)
BEFORE_SIGN, AFTER_SIGN = re.compile(r"[\w.+-]{1,64} ?\Z"), re.compile(r" ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z][\w-]{0,62})+", re.I)
GENERATORS = (
    ("ip", re.compile(r"(?<![\w:])(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}(?![\w:])", re.I)),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{2,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w.+])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![\w])")),
    ("phone", re.compile(r"(?<![\w.+])00[0-9]{8,13}(?![\w])")),
)
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "addr", "server", "peer"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pan"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "dial", "whatsapp"),
}
AGAINST = ("order", "invoice", "isbn", "version", "page", "date", "year", "no.", "id", "ref", "serial", "total", "art", "§", "$", "€", "build")
PRECISION = 0.99
EXAMPLES = 6_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def addresses(text: str) -> list[tuple[int, str, int]]:
    """Matches of the email pattern, leftmost and apart, in one pass: each sign with the longest run of local characters before it."""
    out: list[tuple[int, str, int]] = []
    at, free = text.find("@"), 0  # what is before `free` is a match's or another sign's
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, "email", m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by the base patterns, failing matches dropped."""
    out = addresses(text)
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def candidates(text: str) -> list[tuple[int, str, int]]:
    out = []
    for sign in SIGN.finditer(text):
        before, after = BEFORE_SIGN.search(text[max(0, sign.start() - 65) : sign.start()]), AFTER_SIGN.match(text, sign.end())
        if before and after:
            out.append((sign.start() - (before.end() - before.start()), "email", after.end()))
    return out + [(m.start(), kind, m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)]


def describe(text: str, start: int, kind: str, end: int) -> list[int]:
    """Features of a candidate: its format, then the words and characters around it."""
    s, d = text[start:end], _digits(text[start:end])
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    before = text[max(0, start - 24) : start].lower()
    seps = set(re.findall(r"[^\w]", s))
    first, after = text[start - 1 : start] if start else "", text[end : end + 2]
    return [
        KINDS.index(kind), len(s) // 2, len(d), len(groups), min(groups), max(groups), groups[0], groups[-1], len(seps), int(14 <= len(d) <= 19 and luhn(d)),
        int("(" in s) + 2 * int(s.startswith("0")), int("@" in s) + 2 * int("(at)" in s.lower() or "[at]" in s.lower()), s.count(":"), int("." in seps) + 2 * int("/" in seps) + 4 * int("-" in seps) + 8 * int(" " in seps),
        int(any(c in before for c in CUES[kind])), int(any(c in before for c in AGAINST)), int(any(1900 <= int(g) <= 2099 for g in re.findall(r"(?<![0-9])[0-9]{4}(?![0-9])", s))),
        int(first.isalnum()), int(after[:1] in "%€$") + 2 * int(after[1:].isdigit()), int(first in "+#$€"),
    ]


def _example(rnd: random.Random) -> tuple[str, int, str, int, int]:
    """A made text, a candidate's place in it, and whether it is personal data."""
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abdeghiklmnorstu") for _ in range(rnd.randint(2, 9)))
    kind, true = rnd.choice(KINDS), rnd.random() < 0.5
    if kind == "email":
        sep, dot = rnd.choice((("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"))) if true else rnd.choice(((" @ ", "."), ("@ ", " . "), (" @", ". ")))
        s = word() + "." * rnd.randint(0, 1) + word() + sep + word() + dot + rnd.choice(("com", "org", "net", "de", "fr"))
    elif kind == "ip":
        s = ":".join(f"{rnd.randrange(65536):x}" for _ in range(8)) if true else ":".join(n(2) for _ in range(rnd.randint(4, 6)))
    elif kind == "card":
        d = n(15)
        d += next(c for c in "0123456789" if luhn(d + c) == true)
        sep = rnd.choice("./_") if true else rnd.choice("./_ -")
        s = sep.join((d[:4], d[4:8], d[8:12], d[12:])) if true or rnd.random() < 0.5 else sep.join((str(rnd.randint(1900, 2099)), n(2), n(2)))
    elif true:
        s = rnd.choice((f"({n(3)}) {n(3)}-{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{rnd.randint(1, 9)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0049{n(9)}"))
    else:
        s = rnd.choice((f"{n(2)}.{n(2)}.{rnd.randint(1900, 2099)}", f"{rnd.randint(1900, 2099)}-{n(2)}-{n(2)}", f"{n(2)} {n(3)}", f"{n(3)}-{n(2)}", f"{n(2)}/{n(2)}", f"{n(3)} {n(3)} {n(3)}", f"{n(5)}-{n(3)}"))
    cue = rnd.random()
    good, bad = (0.6, 0.05) if true else (0.05, 0.5)
    lead = rnd.choice(CUES[kind]) + rnd.choice((": ", " ")) if cue < good else rnd.choice(AGAINST) + rnd.choice((": ", " ")) if cue < good + bad else word() + " "
    text = f"{word()} {word()} {lead}{s}{rnd.choice((' ', '. ', ', '))}{word()}"
    start = text.index(s)
    return text, start, kind, start + len(s), int(true)


@functools.lru_cache(maxsize=2)
def learn(seed: int = 7, examples: int = EXAMPLES):
    """Trees and each kind's threshold; a third of the examples sets the thresholds."""
    rnd = random.Random(seed)
    rows = [_example(rnd) for _ in range(examples)]
    x, y = np.array([describe(*r[:4]) for r in rows]), np.array([r[4] for r in rows])
    cut = 2 * examples // 3
    trees = boosting.fit(x[:cut], y[:cut])
    p = trees.probability(np.clip(x[cut:], 0, boosting.BINS - 1))
    return trees, {k: boosting.threshold(p[x[cut:, 0] == i], y[cut:][x[cut:, 0] == i], PRECISION, 0.9) for i, k in enumerate(KINDS)}


def find(text: str, model=None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans of a text, each (start, kind, end) in order."""
    if not ANYTHING.search(text):
        return [], []
    base = base_spans(text)
    starts, reach = [x[0] for x in base], list(itertools.accumulate((x[2] for x in base), max))
    offered = [c for c in dict.fromkeys(candidates(text)) if not (i := bisect.bisect_left(starts, c[2])) or reach[i - 1] <= c[0]]
    if not offered:
        return base, base
    trees, bars = model or learn()
    added: list[tuple[int, int]] = []
    kinds: dict[int, str] = {}
    for score, c in sorted(zip(_judged(trees, text, offered), offered), key=lambda x: (-x[0], x[1])):
        if score >= bars[c[1]]:
            i = bisect.bisect_left(added, (c[0], c[2]))
            if (not i or added[i - 1][1] <= c[0]) and (i == len(added) or added[i][0] >= c[2]):
                added.insert(i, (c[0], c[2]))
                kinds[c[0]] = c[1]
    return base, sorted([*base, *((s, kinds[s], e) for s, e in added)], key=lambda x: (x[0], KINDS.index(x[1])))


def _judged(trees, text: str, offered: list[tuple[int, str, int]]) -> list[float]:
    """Probabilities of candidates, some thousands at a time."""
    out: list[float] = []
    for i in range(0, len(offered), 5_000):
        x = np.array([describe(text, *c) for c in offered[i : i + 5_000]])
        out += trees.probability(np.clip(x, 0, boosting.BINS - 1)).tolist()
    return out


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _detect(model):
    def over(batches):
        for b in small_batches(batches, "text", 1 << 20):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, spans = find(text or "", model)
                rows.append((doc, *(sum(x[1] == k for x in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return over


def op3_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    model = learn()
    return map_arrow(docs.select("doc_id", "text"), lambda: _detect(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def replace(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced together, by the first one's."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced, and n_chars made to fit; null texts stay null."""
    model = learn()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else replace(t, find(t, model)[1]))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
