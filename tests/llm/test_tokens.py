"""Operators 1, 9 and 10 against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import texts
from tributary.llm import byte_bpe, encoding, packing, token_output

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


def ids_of(path, items, end):
    t = Tokenizer.from_file(path)
    return [(d, t.encode(x, add_special_tokens=False).ids + [end]) for d, x in items]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_token_output(spark, kind, request):
    df = request.getfixturevalue(kind)
    want, at = [], 0
    for d, ids in sorted(ids_of(WORD, texts(df), 1), key=lambda x: x[0]):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    got = token_output.op1_token_output(spark, df, WORD).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_files_are_list_columns_with_page_indexes(spark, docs, tmp_path):
    out = str(tmp_path / "tokens")
    token_output.write_tokens(docs, WORD, out)
    rows = token_output.read_tokens(spark, out).where("doc_id = 7").select("n_tokens")
    assert "ids" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1].split("\n")[0]
    (f, *_) = tmp_path.glob("tokens/part-*")
    col = next(pq.ParquetFile(f).metadata.row_group(0).column(i) for i in range(5) if pq.ParquetFile(f).metadata.row_group(0).column(i).path_in_schema.startswith("ids"))
    assert col.has_offset_index and any("DICTIONARY" in e or "DELTA" in e for e in col.encodings)


#: Cases, marks that compose, odd white space, contractions, special tokens in every casing.
PARTS = list("abXÉñßİΣ.,!'-_ 12HTJ=×½²#ſÅ日") + [" ", " ", "\n", "\t", "\r", "\u0301", "\u0331", "\u0308", "\u0338", "\u3000", "\x85", "\xa0", "\u2009", "\x1c", "\0", "'s", "'S", ", ", ". ", "$$", "word ", "The ", "Привет", "Ґ", "가", "\u1100\u1161", "🙂", "\u200d"]
PARTS += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|startoftext", "endoftext|>"]
CASES = ["<|ENDOFTEXT|>", "see <|EndOfText|> here", "<|STARTOFTEXT|> x", "x<|endoftext|>y.<|EndOfText|>,", "<|endoftext|><|endoftext|>", "don't, <|endofText|>.", "\u3000\n\n.", "'\r\n\n"]


def encoded(encoder, items):
    ids, bounds = encoder.encode(pa.array(items, pa.string()))
    return [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])]


@pytest.mark.parametrize("window", [64, 8 << 20])
@pytest.mark.parametrize("make,path", [(encoding.word_encoder, WORD), (encoding.spaced_encoder, BYTE)])
def test_chunks_encode_as_whole_texts_do(make, path, window, monkeypatch):
    monkeypatch.setattr(encoding.distinct_chunks, "__defaults__", (*encoding.distinct_chunks.__defaults__[:-1], window))
    rnd = random.Random(window)
    items = CASES + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(6000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(items, add_special_tokens=False)]
    assert [(x, w, g) for x, w, g in zip(items, want, encoded(make(path), items)) if w != g][:3] == []


@pytest.mark.parametrize("make,path", [(encoding.word_encoder, WORD), (encoding.spaced_encoder, BYTE)])
def test_what_a_worker_keeps_is_bounded(make, path, monkeypatch):
    monkeypatch.setattr(encoding, "MAX_CACHED", 50)
    make.cache_clear()
    encoder, t, rnd = make(path), Tokenizer.from_file(path), random.Random(3)
    for _ in range(12):
        items = [" ".join(rnd.choice(("of", "the", "".join(rnd.choice("abcde") for _ in range(4)))) for _ in range(40)) for _ in range(3)]
        assert encoded(encoder, items) == [t.encode(x, add_special_tokens=False).ids for x in items]
        assert len(encoder.known.words) <= 50 and (np.diff(encoder.known.hash.astype(object)) > 0).all()
    make.cache_clear()


def test_null_and_sliced_columns():
    column = pa.array(["a b", None, "", "c d.", None, "e"]).slice(1, 4)
    assert encoded(encoding.spaced_encoder(BYTE), column.to_pylist()) == [Tokenizer.from_file(BYTE).encode(x or "").ids for x in column.to_pylist()]
    ids, bounds = encoding.spaced_encoder(BYTE).encode(column, 7)
    assert bounds[-1] == len(ids) and ids[bounds[1:] - 1].tolist() == [7] * 4


def test_a_long_text_takes_windows(monkeypatch):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(2000)]
    text = " ".join(rnd.choices(words, k=20_000) * 180)  # 20 MB
    ids, _ = encoding.spaced_encoder(BYTE).encode(pa.array([text]))
    assert len(ids) > 3_600_000
    t = Tokenizer.from_file(BYTE)
    for cut in (text.index(" ", 300_000), text.index(" ", 8 << 20)):  # beside the start, and beside the end of a window
        tail = t.encode(text[cut : cut + 50_000]).ids
        head = t.encode(text[cut - 50_000 : cut]).ids[-1000:]
        near = np.array([*head, *tail[:1000]], np.uint32)
        at = np.flatnonzero(ids == near[0])
        assert any((ids[i : i + 2000] == near).all() for i in at if i + 2000 <= len(ids))


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_byte_bpe(spark, kind, request, monkeypatch):
    df = request.getfixturevalue(kind)
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, x in texts(df):
        ids = enc.encode_ordinary(x)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    got = byte_bpe.op9_byte_bpe(spark, df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def check_plan(counts, capacity):
    runs, bins = packing.make_plan(counts, capacity)
    placed, ranks = [], {}
    for length, rank, count, first, offset, each in runs.tolist():
        nth = np.arange(count)
        placed.append(np.stack([first + nth // each, offset + nth % each * length, np.full(count, length)], 1))
        ranks.setdefault(length, []).append((rank, count))
    for length, spans in ranks.items():
        at = 0
        for rank, count in sorted(spans):
            assert rank == at
            at += count
        assert at == counts[length]
    x = np.concatenate(placed)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    same = x[1:, 0] == x[:-1, 0]
    assert (x[1:, 1][same] == (x[:-1, 1] + x[:-1, 2])[same]).all() and (x[1:, 1][~same] == 0).all()
    assert (x[:, 1] + x[:, 2] <= capacity).all() and len(set(x[:, 0].tolist())) == bins
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_tight(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([16, 64, 1024])
    counts = {rnd.randint(1, capacity): rnd.randint(1, rnd.choice([3, 50, 5000])) for _ in range(rnd.randint(1, 150))}
    bins = check_plan(counts, capacity)
    free, first_fit = [], 0  # first fit, longest first
    if sum(counts.values()) <= 20_000:
        import bisect

        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                i = bisect.bisect_left(free, n)
                if i < len(free):
                    bisect.insort(free, free.pop(i) - n)
                else:
                    bisect.insort(free, capacity - n)
                    first_fit += 1
        assert bins <= first_fit * 1.02 + 2


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_packing(spark, kind, request):
    df = request.getfixturevalue(kind)
    got = packing.op10_packing(spark, df, BYTE).toPandas()
    want = []
    for d, ids in ids_of(BYTE, texts(df), 2):
        first, at, k = len(ids) % 1024 or 1024, 0, 0
        while at < len(ids):
            n = first if k == 0 else 1024
            want.append((d, k, at, n, crc(ids[at : at + n])))
            at, k = at + n, k + 1
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024
    if len(got):
        assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 1024 + 2
