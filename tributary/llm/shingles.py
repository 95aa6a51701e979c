"""Sets of hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
WINDOW_BYTES = 2 << 20
_LOWER = bytes(32 if b == 0x20 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _words(joined: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of bytes that begin and end with a space, window by window; a window ends at a space."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at + 1 < len(joined):
        stop = joined.find(b" ", at + window)
        stop = len(joined) if stop < 0 else stop + 1
        b = np.frombuffer(joined, np.uint8, stop - at, at)
        inside = b != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(b)), out=total[1:])
        starts.append(start + at)
        hashes.append(mix((total[end] - total[start]) * _powers(_INVERSE, len(b))[start] + (end - start).astype(np.uint64)))
        at = stop - 1
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str], words: int = WORDS, window: int = WINDOW_BYTES) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of `words` words.

    A-Z are lower-cased; words are runs of other than space, tab, line feed, vertical tab, form feed and carriage
    return. A text with fewer words is one shingle; without words, none. Bytes are taken in windows: besides one of these, a
    text needs its own size three times, and 50 bytes for each of its words.
    """
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    joined = b" ".join([b"", *raw, b""])
    if len(joined) < 3:
        return [np.zeros(0, np.uint64)] * len(texts)
    start, word = _words(joined, window)
    first = np.searchsorted(start, np.cumsum([1, *(len(r) + 1 for r in raw)]))
    whole = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        whole += word[k : k + len(whole)] * _STEPS[k]
    whole = mix(whole + np.uint64(words))
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= words:
            s = np.sort(whole[i : j - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif j > i:
            out.append(mix(np.array([(word[i:j] * _STEPS[: j - i]).sum() + np.uint64(j - i)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
