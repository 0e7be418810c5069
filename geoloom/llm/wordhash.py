"""Hashes of words and word n-grams of many texts at once.

Words are runs of letters and digits: after folding to lower case, bytes of
ASCII other than 0-9 and a-z separate words, all bytes from 0x80 belong to them.
A batch of texts is one byte array; a running polynomial sum modulo 2^64, taken
over a chunk of whole words at a time, gives every word's hash by two look-ups, and n-gram hashes combine those of n words in
a row, so no word becomes a Python object.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes whose running sums are held at once; one word may be longer.
CHUNK = 1 << 17
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS["up"]) < n:
        size = max(n, 2 * len(_POWERS["up"]))
        for key, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """Words of a batch: hash, byte range in the folded buffer, and each text's range of words."""

    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def words(texts: pa.Array) -> Words:
    """Words of every text (large_string without nulls)."""
    folded = pc.utf8_lower(texts)
    sizes = pc.binary_length(folded).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(folded.buffers()[2] or b"", np.uint8)
    origin = int(np.frombuffer(folded.buffers()[1], np.int64)[folded.offset]) if n else 0
    data = data[origin : origin + int(starts[-1])]
    inside = _IS_WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1]) if len(data) else None
    edge[starts] = True
    at = np.flatnonzero(edge)
    begins, ends = at[:-1], at[1:]
    keep = inside[begins] if len(data) else np.zeros(0, bool)
    begins, ends = begins[keep], ends[keep]
    hashes = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):  # whole words, about CHUNK bytes of them at once
        stop = max(at + 1, int(np.searchsorted(begins, begins[at] + CHUNK)))
        first, last = begins[at], ends[stop - 1]
        up, down = powers(int(last - first) + 1)
        running = np.zeros(last - first + 1, np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up[:-1], out=running[1:])
        b, e = begins[at:stop] - first, ends[at:stop] - first
        hashes[at:stop] = mix((running[e] - running[b]) * down[b])
        at = stop
    return Words(hashes, begins, ends, np.searchsorted(begins, starts))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row, none across texts, and each text's range of them."""
    total = len(w.hashes)
    counts = np.maximum(np.diff(w.offsets) - n + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if total < n:
        return np.zeros(0, np.uint64), offsets
    gram = w.hashes[: total - n + 1].copy()
    for k in range(1, n):
        gram = mix(gram * np.uint64(BASE) + w.hashes[k : total - n + 1 + k])
    index = np.repeat(w.offsets[:-1], counts) + np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], counts)
    return gram[index], offsets

