"""Sets of word shingles, hashed for whole batches of texts at once.

A-Z are lower-cased, words are runs of anything but space and \\t..\\r, and a shingle is five words in a
row. A text of one to four words has one shingle, the whole sequence; one without words has none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text that one round of array operations takes.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums s and inverse powers q: (s[e] - s[b]) * q[b] is a hash of data[b:e]."""
    size = 1 << max(19, int(len(data) + 1).bit_length())
    p, q = powers(size)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=s[1:])
    return s, q


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes, with the index of their first."""
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if held and size + len(b) > most:
            yield start, held
            start, held, size = k, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield start, held


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, hash) of every word, in order."""
    raw = _LOWER[np.frombuffer(b" ".join(data) + b" ", np.uint8)]
    borders = np.cumsum([len(b) + 1 for b in data])
    edge = np.diff(np.concatenate(([True], _SPACE[raw])).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(begins) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s, q = prefix_sums(raw)
    word = mix((s[ends] - s[begins]) * q[begins] ^ ((ends - begins).astype(np.uint64) << np.uint64(48)))
    return np.searchsorted(borders, begins, "right"), word


def shingle_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, hash) of the distinct shingles, sorted by both."""
    doc, word = word_hashes(data)
    if len(doc) == 0:
        return doc, word
    n = np.bincount(doc, minlength=len(data))
    first = np.cumsum(n) - n
    full = np.flatnonzero(doc[: -(WORDS - 1)] == doc[WORDS - 1 :]) if len(doc) >= WORDS else np.zeros(0, np.int64)
    h = np.zeros(len(full), np.uint64)
    for k in range(WORDS):
        h = mix(h * _BASE + word[full + k])
    few = np.flatnonzero((n > 0) & (n < WORDS))
    short = n[few].astype(np.uint64)
    for k in range(WORDS - 1):
        more = n[few] > k
        short[more] = mix(short[more] * _BASE + word[first[few[more]] + k])
    docs, hashes = np.concatenate((doc[full], few)), np.concatenate((h, short))
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]
