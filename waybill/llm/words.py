"""Hashed subword features of words, computed for many words at once with numpy.

A word is read as bytes between "<" and ">"; every byte n-gram inside it is one feature.  The work
is done on one array of all words laid end to end, so its cost is a few array passes, not a Python
loop over n-grams.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def subword_buckets(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of each word: the word's index and the n-gram's bucket.

    A word shorter than an n-gram size gives none of that size; every word gives some, since the
    marked word of even an empty word has two bytes (sizes must hold 2 or less).
    """
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(flat))
    owners, found = [], []
    for n in sizes:
        if n > len(flat):
            continue
        h = np.full(len(flat) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + flat[k : len(flat) - n + 1 + k]
        inside = at[: len(h)] + n <= ends[: len(h)]
        owners.append(owner[: len(h)][inside])
        found.append((mix(h[inside]) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found)


def mean_rows(owner: np.ndarray, bucket: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Mean of ``rows[bucket]`` by owner, as float32."""
    counts = np.maximum(np.bincount(owner, minlength=n), 1)
    out = np.empty((n, rows.shape[1]), dtype=np.float32)
    for d in range(rows.shape[1]):
        out[:, d] = np.bincount(owner, weights=rows[bucket, d], minlength=n) / counts
    return out


class WordTable:
    """A growing table from words to feature rows; emptied when it reaches ``limit`` words.

    ``features(words)`` makes the rows of new words in one go.
    """

    def __init__(self, features: Callable[[list[str]], np.ndarray], width: int, limit: int) -> None:
        self.features, self.limit = features, limit
        self.index: dict[str, int] = {}
        self.rows = np.empty((1024, width), dtype=np.float32)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words; new words are added first."""
        index = self.index
        if len(index) > self.limit:
            index.clear()
        new = list(set(words).difference(index))
        if new:
            start = len(index)
            while start + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.rows[start + i : start + i + len(part)] = self.features(part)
            index.update(zip(new, range(start, start + len(new)), strict=True))
        return np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
