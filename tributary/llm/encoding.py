"""Tokenizing whole texts through distinct chunks, in columns.

A text is cut at places where the tokenizer's own pre-tokenizer must cut, so that encoding each distinct chunk once
with the library and joining the results equals encoding the whole text with it. Cuts come from the classes of
neighbouring bytes, for a whole column at a time; chunks are numbered by a dictionary encoding and ids gathered by
row numbers, so no Python object is made for a chunk, only for what is new to a worker.

Texts are taken in windows that end at a cut, so a text of any length needs the memory of one window, besides its ids.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tributary.llm.common import kept_for_stage

#: Bytes of text that are cut at once.
WINDOW_BYTES = 8 << 20
#: A worker keeps at most so many chunks, none longer than MAX_KEPT bytes, with their ids: some 50 MB. Beyond it the half used last stays.
MAX_CACHED, MAX_KEPT = 800_000, 48

APOSTROPHE, LETTER, DIGIT, SYMBOL, SPACE, LINE, OTHER, UNSURE = range(8)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[:128] = SYMBOL
    out[:32], out[127] = UNSURE, UNSURE
    out[9:14], out[32], out[39] = LINE, SPACE, APOSTROPHE
    out[48:58], out[65:91], out[97:123] = DIGIT, LETTER, LETTER
    return out


def _cut_table() -> np.ndarray:
    """Whether a pre-token must begin at a byte of the second class after one of the first (white space in a row apart)."""
    out = np.zeros((8, 8), bool)
    sure = [APOSTROPHE, LETTER, DIGIT, SYMBOL, OTHER]
    out[np.ix_(sure, [SPACE, LINE])] = True
    out[LINE, sure] = True
    for a, b in ((LETTER, DIGIT), (LETTER, SYMBOL), (LETTER, APOSTROPHE), (DIGIT, LETTER), (DIGIT, SYMBOL), (DIGIT, APOSTROPHE), (SYMBOL, LETTER), (SYMBOL, DIGIT)):
        out[a, b] = True
    return out.ravel()


_CLASS, _CUT = _classes(), _cut_table()
# First, second and third byte of white space beyond ASCII, and of a character that was so once.
_WIDE_SPACE = {0xC2: {0x85: None, 0xA0: None}, 0xE1: {0x9A: {0x80}, 0xA0: {0x8E}}, 0xE2: {0x80: {*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF}, 0x81: {0x9F}}, 0xE3: {0x80: {0x80}}}


def classes(b: np.ndarray) -> np.ndarray:
    """A class for each byte of UTF-8. Letters beyond ASCII are known only in Latin-1 and the basic Cyrillic block."""
    out = _CLASS[b]
    if out.max(initial=0) < OTHER:
        return out
    for lead in (0xC3, 0xD0, 0xD1):
        at = np.flatnonzero(b[:-1] == lead)
        if lead == 0xC3:
            at = at[(b[at + 1] != 0x97) & (b[at + 1] != 0xB7)]
        out[at], out[at + 1] = LETTER, LETTER
    for lead, seconds in _WIDE_SPACE.items():
        at = np.flatnonzero(b[:-1] == lead)
        for second, thirds in seconds.items() if len(at) else ():
            x = at[b[at + 1] == second]
            if thirds is not None:
                x = x[x + 2 < len(b)]
                x = x[np.isin(b[x + 2], list(thirds))]
                out[x + 2] = UNSURE
            out[x], out[x + 1] = UNSURE, UNSURE
    return out


def cut_mask(b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte; texts start at `begin`.

    In the patterns of byte-level BPE (` ?\\p{L}+` and the like) a letter, digit or symbol run takes at most one space
    before it, and of white space in a row all but the last character stays together. So cuts are sound before white space that
    follows anything else, before its last character, after a line feed, and between letters, digits and symbols, but for
    what follows an apostrophe (contractions). Where a byte's class isn't sure, nothing is cut.
    """
    kind = classes(b)
    cut = np.zeros(len(b), bool)
    if not len(b):
        return cut
    cut[1:] = _CUT[(kind[:-1] << 3) | kind[1:]]
    blank = (kind == SPACE) | (kind == LINE)
    twice = np.flatnonzero(blank[:-1] & blank[1:]) + 1
    if len(twice):
        twice = twice[(twice + 1 < len(b)) & ~np.isin(twice + 1, begin)]
        after = kind[twice + 1]
        cut[twice[(after != SPACE) & (after != LINE) & (after != UNSURE)]] = True
    odd = np.flatnonzero(kind == UNSURE)
    if len(odd):  # a line feed after it may be joined to it
        odd = odd[odd + 2 < len(b)]
        cut[odd[(kind[odd + 1] == LINE) & ~blank[odd + 2]] + 2] = False
    cut[begin] = True
    return cut


def lower_plain(b: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters with no combining mark after them, and spaces for ASCII white space.

    What a mark may be composed with keeps its case, as normal forms come before lower case in such tokenizers.
    """
    out = _SPACED[b]
    wide = len(b) and int(b.max()) >= 0xC3
    upper = (b >= 65) & (b <= 90)
    if wide:
        upper[:-1] &= b[1:] < 0xC4
        at = np.flatnonzero(b[:-1] == 0xC3) + 1
        x = b[at]
        at = at[(x >= 0x80) & (x <= 0x9E) & (x != 0x97) & (np.append(b, 0)[at + 1] < 0xC4)]
        out[at] += 32
    out[upper] += 32
    return out


_SPACED = np.array([32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's bounds in them; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _array(starts: np.ndarray, b: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(b)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b))])


def distinct_chunks(b: np.ndarray, bounds: np.ndarray, lower: bool = False, whole: list[tuple[int, int]] = (), window: int = WINDOW_BYTES):
    """For windows of the bytes in turn: (distinct chunks, number of each chunk among them, where in b each chunk starts).

    bounds: where texts start, cuts in any case. Spans of `whole` are neither cut nor changed.
    """
    begin = np.unique(bounds[:-1][bounds[:-1] < len(b)])
    at = 0
    while at < len(b):
        size = window
        while True:
            end = min(len(b), at + size)
            look = b[at : min(len(b), end + 3)]
            cut = cut_mask(look, begin[np.searchsorted(begin, at) : np.searchsorted(begin, at + len(look))] - at)
            cut[0] = True
            for i, j in whole:
                cut[max(0, i + 1 - at) : max(0, j - at)] = False
            starts = np.flatnonzero(cut)
            if end < len(b):
                starts = starts[starts <= end - at]
                if len(starts) < 2:  # no cut but the first
                    size *= 2
                    continue
                end, starts = at + int(starts[-1]), starts[:-1]
            break
        part = b[at:end]
        if lower:
            same = part
            part = lower_plain(b[at : min(len(b), end + 1)])[: end - at]
            for i, j in whole:
                part[max(0, i - at) : max(0, j - at)] = same[max(0, i - at) : max(0, j - at)]
        coded = _array(starts, part).dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy(), starts + at
        at = end


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def offsets_of(words: pa.Array) -> np.ndarray:
    return np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)


def data_of(words: pa.Array) -> np.ndarray:
    ends, data = offsets_of(words), words.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each entry of a binary array."""
    b, ends = data_of(words), offsets_of(words).astype(np.int64)
    ends = ends - ends[0]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(b)), out=total[1:])
    x = (total[ends[1:]] - total[ends[:-1]]) * _powers(_P_INVERSE, len(b) + 1)[ends[:-1]]
    x = (x ^ (x >> np.uint64(31)) ^ np.diff(ends).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Known:
    """Chunks that a worker has met, with their ids as bytes; found by a hash, then compared."""

    def __init__(self) -> None:
        self.words, self.ids = pa.array([], pa.binary()), pa.array([], pa.binary())
        self.hash, self.row, self.used, self.clock = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def find(self, words: pa.Array, key: np.ndarray) -> np.ndarray:
        """Each word's row, or -1."""
        out = np.full(len(words), -1, np.int64)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, key), len(self.hash) - 1)
            hit = np.flatnonzero(self.hash[at] == key)
            rows = self.row[at[hit]]
            same = pc.equal(self.words.take(pa.array(rows)), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            out[hit[same]] = rows[same]
            self.clock += 1
            self.used[out[out >= 0]] = self.clock
        return out

    def add(self, words: pa.Array, ids: pa.Array, key: np.ndarray) -> None:
        if len(self.words) + len(words) > MAX_CACHED:
            stay = np.sort(np.argsort(-self.used, kind="stable")[: max(0, MAX_CACHED // 2 - len(words))])
            self.words, self.ids, self.used = self.words.take(pa.array(stay)), self.ids.take(pa.array(stay)), self.used[stay]
            place = np.full(int(self.row.max(initial=-1)) + 1, -1, np.int64)
            place[stay] = np.arange(len(stay))
            left = place[self.row] >= 0
            self.hash, self.row = self.hash[left], place[self.row[left]]
        fine = np.flatnonzero(np.diff(offsets_of(words)) <= MAX_KEPT)[: MAX_CACHED - len(self.words)]
        first = len(self.words)
        self.words = pa.concat_arrays([self.words, words.take(pa.array(fine))])
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(fine))])
        self.used = np.append(self.used, np.full(len(fine), self.clock, np.int32))
        order = np.argsort(key[fine], kind="stable")
        new = key[fine][order]
        at = np.searchsorted(self.hash, new)
        self.hash, self.row = np.insert(self.hash, at, new), np.insert(self.row, at, first + order)


def byte_alphabet() -> np.ndarray:
    """Code points that stand for bytes in byte-level BPE: printable ones for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return np.array([b if b in shown else 256 + hidden.index(b) for b in range(256)], "<u2")


ALPHABET = byte_alphabet()
# Bytes of lower-case letters of ASCII and Latin-1 (first byte C3).
_LOWER_BYTES = np.isin(np.arange(256), [*range(97, 123), 0xC3, 0x9F, *(b for b in range(0xA0, 0xC0) if b != 0xB7)])
WORDS_AT_ONCE = 100


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


class ChunkEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, by the tokenizers library's file at `path`.

    New chunks are encoded many at a time. Chunks of letters alone are one pre-token each; they go to the file's model
    in the byte alphabet, with nothing to normalise or cut, and the ids tell where words end: the last id of a word
    has the model's suffix, or the first one begins with a space. Others go to the whole tokenizer, joined by `mark`, text that
    it always makes one id of its own and that no chunk holds; chunks that `alone` matches go singly.
    """

    def __init__(self, path: str, lower: bool, mark: str, alone: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lower, self.mark, self.alone = lower, mark, re.compile(alone)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, "added_tokens": [], "post_processor": None}
        size = 1 + max(spec["model"]["vocab"].values())
        self.edge = np.zeros(size, bool)
        suffix, first = spec["model"].get("end_of_word_suffix"), chr(ALPHABET[32])
        self.at_end = bool(suffix)
        for token, i in spec["model"]["vocab"].items():
            self.edge[i] = token.endswith(suffix) if suffix else token.startswith(first)
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.bare.model._resize_cache(0)  # each chunk comes once
        (self.mark_id,) = self.tokenizer.encode(mark, add_special_tokens=False).ids
        self.known = Known()

    def _ids(self, tokenizer, texts: list[str]) -> np.ndarray:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32, sum(map(len, found)))

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, and where each word's end."""
        b, ends = data_of(words), offsets_of(words).astype(np.int64)
        ends = ends - ends[0]
        shown = b.astype("<u2") if self.lower else ALPHABET[b]
        if self.lower and len(b) and b.max() >= 128:
            shown = np.where(b == 32, 32, ALPHABET[b]).astype("<u2")
        text = np.full(len(b) + len(words), 32, "<u2")
        text[np.arange(len(b)) + np.repeat(np.arange(1, len(words) + 1), np.diff(ends))] = shown
        whole = text.tobytes().decode("utf-16-le")
        at = [*(ends[:-1] + np.arange(len(words)))[::WORDS_AT_ONCE].tolist(), len(whole)]
        ids = []
        for i in range(0, len(at) - 1, 500):
            ids.append(self._ids(self.bare, [whole[x:y] for x, y in zip(at[i : i + 500], at[i + 1 : i + 501])]))
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        return ids, edges + 1 if self.at_end else np.append(edges[1:], len(ids)) if len(edges) else edges

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of any chunks."""
        out: list[bytes] = [b""] * len(words)
        single = [i for i, w in enumerate(words) if self.alone.search(w)]
        for i in range(0, len(single), 1000):
            part = single[i : i + 1000]
            for j, e in zip(part, self.tokenizer.encode_batch_fast([words[j] for j in part], add_special_tokens=False)):
                out[j] = np.array(e.ids, "<u4").tobytes()
        rest = np.setdiff1d(np.arange(len(words)), single).tolist()
        for i in range(0, len(rest), WORDS_AT_ONCE):
            part = rest[i : i + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(words[j] for j in part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(ends) != len(part):
                raise AssertionError("a chunk holds the mark")
            data, start = ids.tobytes(), 0
            for j, end in zip(part, ends):
                out[j] = data[4 * start : 4 * end]
                start = end + 1
        return out

    def learn(self, words: pa.Array) -> pa.Array:
        """The ids of new chunks, as bytes."""
        b, ends = data_of(words), offsets_of(words).astype(np.int64)
        ends = ends - ends[0]
        fine = _LOWER_BYTES[b] if self.lower else classes(b) == LETTER
        first = b[ends[:-1]] == 32 if len(words) else np.zeros(0, bool)
        long = np.diff(ends) > 1
        if len(words):
            fine = fine.copy()
            fine[ends[:-1][first & long]] = True
        plain = np.logical_and.reduceat(fine, ends[:-1]) if len(words) else np.zeros(0, bool)
        if not self.at_end:  # the space is what tells words apart
            plain &= first
        at, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, word_ends = self._plain(words.take(pa.array(at)))
        if len(word_ends) != len(at):
            raise AssertionError("the ids do not tell words apart")
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, 4 * word_ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
        rest = binary(self._others([w.decode() for w in words.take(pa.array(other)).to_pylist()]))
        place = np.empty(len(words), np.int64)
        place[at], place[other] = np.arange(len(at)), len(at) + np.arange(len(other))
        return pa.concat_arrays([coded, rest]).take(pa.array(place))

    def _whole(self, b: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Texts that hold one of the tokenizer's added tokens, which is found before all else: these are encoded as they stand."""
        out, raw = set(), memoryview(np.ascontiguousarray(b)).tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                i = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(token) <= bounds[i + 1]:
                    out.add((int(bounds[i]), int(bounds[i + 1])))
                    at = raw.find(token, int(bounds[i + 1]))
                else:
                    at = raw.find(token, at + 1)
        return sorted(out)

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, end_id after each if given, and each text's bounds among them."""
        b, bounds = column_bytes(column)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        pieces: list[pa.Array] = []
        counts = []
        for words, number, starts in distinct_chunks(b, bounds, self.lower, self._whole(b, bounds)):
            key = hashes(words)
            rows = self.known.find(words, key)
            new = np.flatnonzero(rows < 0)
            fresh = words.take(pa.array(new))
            learnt = self.learn(fresh)
            rows[new] = len(self.known.ids) + np.arange(len(new))
            store = pa.concat_arrays([self.known.ids, learnt])
            taken = store.take(pa.array(rows[number]))
            pieces.append((data_of(taken).view("<u4"), offsets_of(taken).astype(np.int64)[1:] // 4, starts))
            self.known.add(fresh, learnt, key[new])
        ids = np.concatenate([p[0] for p in pieces]) if pieces else np.zeros(0, np.uint32)
        chunk_ends, at = [], 0
        for p in pieces:
            chunk_ends.append(p[1] + at)
            at += len(p[0])
        starts = np.concatenate([p[2] for p in pieces]) if pieces else np.zeros(0, np.int64)
        # Ids before each text: those of all chunks that start before it.
        counts = np.append(0, np.concatenate(chunk_ends)) if pieces else np.zeros(1, np.int64)
        ends = counts[np.searchsorted(starts, bounds)]
        if tail:
            ids = np.insert(ids, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
        return ids, ends


@kept_for_stage
def word_encoder(path: str) -> ChunkEncoder:
    """For a tokenizer that lower-cases and drops white space. Kept by the worker process from task to task."""
    return ChunkEncoder(path, True, " \0 ", "\0")


@kept_for_stage
def spaced_encoder(path: str) -> ChunkEncoder:
    """For a byte-level BPE tokenizer. Kept by the worker process from task to task."""
    return ChunkEncoder(path, False, "\t", r"(?s).\s|^[^\S \n]|^[ \n]$")
