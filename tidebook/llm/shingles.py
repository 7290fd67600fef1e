"""Hashed words and word shingles of whole texts, by array operations over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CHUNK = 1 << 20

#: Per byte: is it one of space, tab, line feed, vertical tab, form feed, carriage return; and its lower case.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint64) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word of all texts in order, number of words of each text). A-Z count as a-z."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts_of_texts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    up, down = _powers(max(_CHUNK * 2, 1 << int(len(data)).bit_length()))
    total = np.concatenate([[np.uint64(0)], np.cumsum((LOWER[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    h = mix((total[end] - total[start]) * down[start])
    return h, np.diff(np.searchsorted(start, starts_of_texts))


def chunks(texts: list[str]) -> Iterator[list[bytes]]:
    """Runs of texts of about a megabyte."""
    held, size = [], 0
    for t in texts:
        held.append(t.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingles(texts: list[bytes], words: int = 5) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each text its shingles' hashes in order; and two 64-bit keys of its sequence of words.

    A text of fewer words than a shingle has has one shingle, all its words; a text without words has none.
    """
    h, counts = word_hashes(texts)
    g = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        g += mix(h[k : k + len(g)] + np.uint64(k * 0x9E37 + 1))
    g = mix(g)
    first = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(h)) - np.repeat(first[:-1], counts) if len(h) else np.zeros(0, np.int64)
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(place.astype(np.uint64))), dtype=np.uint64)])
    b = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + mix(place.astype(np.uint64) + np.uint64(99))), dtype=np.uint64)])
    ka, kb = a[first[1:]] - a[first[:-1]], b[first[1:]] - b[first[:-1]]
    out = []
    for i, n in enumerate(counts):
        if n >= words:
            out.append(g[first[i] : first[i] + n - words + 1])
        else:
            out.append(ka[i : i + 1] if n else g[:0])
    return out, ka, kb
