"""Word and sequence hashes in numpy, for code that runs on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), salted."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & MASK)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash; bounded."""

    LIMIT = 600_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes of any stretch of a word sequence from prefix sums modulo 2^64."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)

            def powers(b: int) -> np.ndarray:
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            self.up, self.down = powers(self.base), powers(self.inverse)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.up[:n], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.down[start]


class FlatHashes:
    """Hashes of words that lie in one byte array, all at once."""

    #: Bytes of a word that is known by a polynomial hash; longer ones by another.
    LONG = 64
    #: Bytes whose prefix sums are held at a time.
    WINDOW = 1 << 20

    def __init__(self):
        self.rolling = Rolling(0x5851F42D4C957F2D)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + self.WINDOW, side="right")))
            first = int(starts[lo])
            if ends[hi - 1] - first <= self.WINDOW:
                sums = self.rolling.prefix(data[first : ends[hi - 1]].astype(np.uint64) + np.uint64(1))
                out[lo:hi] = self.rolling.between(sums, starts[lo:hi] - first, ends[lo:hi] - first)
            lo = hi
        length = ends - starts
        out = mix(out ^ length.astype(np.uint64), 61)
        for i in np.flatnonzero(length > self.LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
        return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts laid end to end, and where each begins (and the last ends). A null is an empty text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: runs of bytes without white space inside one text."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after_space, before_space = np.ones(len(word), bool), np.ones(len(word), bool)
    after_space[1:] = ~word[:-1]
    before_space[:-1] = ~word[1:]
    return np.flatnonzero(word & (edge[:-1] | after_space)), np.flatnonzero(word & (edge[1:] | before_space)) + 1
