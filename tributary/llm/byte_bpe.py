"""Operator 9: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are taken apart into words (chunks that begin and end where pre-tokens do, nearly always one pre-token), all
with positions. A block of documents is written once: its distinct words, packed by bin (a hash of the word), beside
the positions of all its documents. The words go to their bins, where each distinct word of the whole corpus is
encoded once; the ids go back to the blocks, where documents are put together by position, and are decoded by
the table of token bytes. Blocks lie in buckets of their number, so positions are not shuffled: only one entry for each
distinct word of a block is. As blocks are read from what was written, a lost executor or an input whose order is
not fixed changes nothing.

Null text counts as empty: no ids. Rows that repeat a doc_id each get a row. An empty table gives no rows. Columns
other than doc_id and text are ignored. A block holds one long text at least, so a worker needs some fifteen times
the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import bins_for, give_back, kept_for_stage, map_arrow, shared_path, shuffle_partitions, small_batches
from tributary.llm.encoding import column_bytes, data_of, distinct_chunks, hashes, offsets_of

BLOCK_BYTES = 16 << 20
#: Rows of a block: one for the words of each bin; one, with bin -1, for its documents.
BLOCKS = "block BIGINT, bin INT, words BINARY, docs BINARY"


def _planes(numbers: np.ndarray, width: int = 4) -> bytes:
    """Little-endian numbers byte by byte, which compresses better."""
    return np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _numbers(planes: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _pack(*arrays: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(a) for a in arrays], "<u8").tobytes(), *arrays]))


def _unpack(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = 8 * n + np.cumsum([0, *np.frombuffer(raw, "<u8", n).tolist()])
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _binary(lengths: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(data)])


def _take_apart(bins: int):
    def over(batches):
        for number, b in enumerate(small_batches(batches, "text", BLOCK_BYTES)):
            block = b.column(2)[0].as_py() << 32 | number
            raw, bounds = column_bytes(b.column(1))
            bin_, words, ranks, starts = np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for distinct, chunk, starts in distinct_chunks(raw, bounds, window=len(raw) + 1):  # one window
                bin_ = (hashes(distinct) % np.uint64(bins)).astype(np.int64)
                order = np.argsort(bin_, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                bin_, words, ranks = bin_[order], distinct.take(pa.array(order)), place[chunk]
            ids = b.column(0).fill_null(0).to_numpy().astype("<i8")
            docs = _pack(ids.tobytes(), np.array(b.column(0).is_valid(), np.uint8).tobytes(), np.searchsorted(starts, bounds).astype("<i8").tobytes(), _planes(ranks))
            first = np.flatnonzero(np.append(True, bin_[1:] != bin_[:-1])) if len(bin_) else np.zeros(0, np.int64)
            ends, data = offsets_of(words).astype(np.int64), data_of(words)
            packs = [_pack(_planes(np.diff(ends[i : j + 1])), data[ends[i] - ends[0] : ends[j] - ends[0]].tobytes()) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(bin_)])]
            n = len(packs)
            yield pa.RecordBatch.from_arrays([pa.array([block] * (n + 1), pa.int64()), pa.array([*bin_[first].tolist(), -1], pa.int32()), pa.array([*packs, None], pa.binary()), pa.array([None] * n + [docs], pa.binary())], ["block", "bin", "words", "docs"])

    return over


@kept_for_stage
def token_table(ranks_path: str) -> dict[bytes, int]:
    """Token bytes to id; as many entries as the vocabulary has."""
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encode_words(ranks_path: str, pattern: str):
    def over(batches):
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=token_table(ranks_path), special_tokens={}).encode_ordinary

        def encoded(bin_: int, held: list[tuple[int, pa.Array]]) -> pa.RecordBatch:
            coded = pa.concat_arrays([w for _, w in held]).dictionary_encode()
            ids = [encode(w.decode()) for w in coded.dictionary.to_pylist()]
            each = _binary(4 * np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), "<u4"))
            number, at, out = coded.indices.to_numpy(), 0, []
            for _, w in held:
                mine = each.take(pa.array(number[at : at + len(w)]))
                out.append(_pack(_planes(np.diff(offsets_of(mine)) // 4), _planes(data_of(mine).view("<u4"))))
                at += len(w)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()), pa.array([bin_] * len(held), pa.int32()), pa.array(out, pa.binary())], ["block", "bin", "ids"])

        at, held = None, []
        for batch in batches:
            for block, n, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if n != at and held:
                    yield encoded(at, held)
                    held = []
                at = n
                lengths, data = _unpack(payload, 2)
                held.append((block, _binary(_numbers(lengths), data)))
        if held:
            yield encoded(at, held)

    return over


@kept_for_stage
def _token_forms(ranks_path: str) -> tuple[pa.Array, pa.Array]:
    """Each id's decimal form with a comma, and its bytes."""
    table = token_table(ranks_path)
    size = 1 + max(table.values())
    of = dict(zip(table.values(), table))
    return pa.array([b"%d," % i for i in range(size)], pa.binary()), pa.array([of.get(i, b"") for i in range(size)], pa.binary())


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _joined(forms: pa.Array, ids: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Of the words at `ranks` in a row, the forms of their ids as one run of bytes, and where each begins."""
    taken = forms.take(pa.array(ids))
    words = _binary(np.diff(offsets_of(taken).astype(np.int64)[ends]), data_of(taken)).take(pa.array(ranks))
    return memoryview(np.ascontiguousarray(data_of(words))), offsets_of(words).astype(np.int64)


def _assemble(ranks_path: str):
    def over(ids: pa.Table, docs: pa.Table) -> pa.Table:
        forms, raws = _token_forms(ranks_path)
        packs = [_unpack(x, 2) for _, x in sorted(zip(ids.column("bin").to_pylist(), ids.column("ids").to_pylist()))]
        tokens = np.concatenate([_numbers(x) for _, x in packs]) if packs else np.zeros(0, np.uint32)
        sizes = np.concatenate([_numbers(n) for n, _ in packs]).astype(np.int64) if packs else np.zeros(0, np.int64)
        ends, out = np.append(0, np.cumsum(sizes)), []
        for payload in docs.column("docs").to_pylist():
            doc, valid, bounds, ranks = _unpack(payload, 4)
            ranks, bounds = _numbers(ranks).astype(np.int64), np.frombuffer(bounds, "<i8").tolist()
            total = np.append(0, np.cumsum(sizes[ranks]))
            text, at = _joined(forms, tokens, ends, ranks)
            written = [hashlib.sha256(text[at[i] : max(at[i], at[j] - 1)]).hexdigest() for i, j in zip(bounds, bounds[1:])]
            text, at = _joined(raws, tokens, ends, ranks)
            decoded = [hashlib.sha256(text[at[i] : at[j]]).hexdigest() for i, j in zip(bounds, bounds[1:])]
            doc = [d if v else None for d, v in zip(np.frombuffer(doc, "<i8").tolist(), valid)]
            out.append(pa.table([pa.array(doc, pa.int64()), pa.array([int(total[j] - total[i]) for i, j in zip(bounds, bounds[1:])], pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())], schema=RESULT))
        give_back()
        return pa.concat_tables(out) if out else RESULT.empty_table()

    return over


def op9_byte_bpe(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    from pyspark.sql import functions as F

    bins, buckets, name = bins_for(docs.select("text")), shuffle_partitions(spark), f"word_blocks_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({BLOCKS}) USING parquet CLUSTERED BY (block) SORTED BY (block) INTO {buckets} BUCKETS LOCATION '{shared_path(spark, 'word-blocks')}'")
    texts = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    map_arrow(texts, lambda: _take_apart(bins), BLOCKS).write.insertInto(name)
    blocks = spark.table(name)
    words = blocks.where("bin >= 0").select("block", "bin", "words").repartitionById(buckets, "bin").sortWithinPartitions("bin", "block")
    ids = map_arrow(words, lambda: _encode_words(ranks_path, pattern), "block long, bin int, ids binary")
    assemble = _assemble(ranks_path)
    placed = blocks.where("bin = -1").select("block", "docs").groupBy("block")
    out = ids.groupBy("block").cogroup(placed).applyInArrow(lambda x, y: assemble(x, y), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and the plan knows them
    return out
