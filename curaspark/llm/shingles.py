"""64-bit hashes of words and of word shingles, for a whole Arrow batch of texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(0, 2**63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Blanks and ASCII punctuation, for words without their marks.
MARKS = _BLANK.copy()
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(_BASE)), np.full(n, U(pow(_BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The size of each text in bytes, null ones empty, and all bytes, without a copy where no text is null."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.diff(ends), np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


class Words:
    """The words of a batch of texts: hash, text number, and byte range of each, in order."""

    def __init__(self, texts: pa.Array, lower: bool = True, blank: np.ndarray = _BLANK):
        self.sizes, data = utf8(texts)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        first = np.cumsum(self.sizes) - self.sizes
        solid = np.concatenate([[False], ~blank[self.data], [False]])
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[first[self.sizes > 0]] = True
        edge[n] = True
        self.start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        self.end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        self.count = np.searchsorted(self.start, first + self.sizes) - np.searchsorted(self.start, first)
        self.text = np.repeat(np.arange(len(first)), self.count)
        up, down = powers(n + 1)
        prefix = np.zeros(n + 1, U)
        np.cumsum(_BYTE[self.data] * up[:n], out=prefix[1:])
        self.hash = mix((prefix[self.end] - prefix[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of all shingles; a text of fewer words is one shingle, one without words none."""
        h, t = self.hash, self.text
        parts = []
        if len(h) >= width:
            m = len(h) - width + 1
            s = np.zeros(m, U)
            for i in range(width):
                s = mix(s * U(31) + h[i : i + m])
            whole = t[:m] == t[width - 1 :]
            parts.append((t[:m][whole], s[whole]))
        firsts = np.cumsum(self.count) - self.count
        short = np.flatnonzero((self.count > 0) & (self.count < width))
        s = np.zeros(len(short), U)
        for i in range(width - 1):
            has = self.count[short] > i
            s[has] = mix(s[has] * U(31) + h[firsts[short[has]] + i])
        parts.append((short, mix(s + self.count[short].astype(U))))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def shingle_sets(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, hash) without repeats, by text, and the size of each text's set."""
        t, h = self.shingles(width)
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        t, h = t[new], h[new]
        return t, h, np.bincount(t, minlength=len(self.sizes)).astype(np.int64)
