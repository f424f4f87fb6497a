"""Vectorised word and shingle hashing over a batch of texts (numpy, inside tasks).

Words are ``[^\\x20\\x09-\\x0D]+``. A batch is laid out as one byte buffer with a space after each
text, so one pass finds and hashes the words of all its texts. Hashes are 64-bit: two different
words, lines or shingles of one text are taken as equal with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[_SPACE] = 0
_BASE = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection, so it adds no collisions."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _powers


def chunks(blobs: list[bytes], limit: int = 1 << 21):
    """(first, last + 1) of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    first, size = 0, 0
    for i, b in enumerate(blobs):
        if size and size + len(b) > limit:
            yield first, i
            first, size = i, 0
        size += len(b) + 1
    if first < len(blobs):
        yield first, len(blobs)


class Words:
    """Words of a run of texts: ``starts``, ``ends`` in ``buf``, the text ``doc`` of each, ``hashes``."""

    def __init__(self, blobs: list[bytes], lower: bool = False):
        self.n_docs = len(blobs)
        self.buf = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        lens = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.doc_start = np.cumsum(lens + 1) - lens - 1
        self.space = _SPACE[self.buf]
        edge = np.diff(np.concatenate([[True], self.space]).view(np.int8))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.doc_start, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self) -> np.ndarray:
        s, n = self.starts, len(self.buf)
        if not len(s):
            return np.zeros(0, np.uint64)
        at = np.arange(n, dtype=np.int32)
        at[s[0]:] -= np.repeat(s, np.diff(np.append(s, n))).astype(np.int32)
        power = _power(int(max((self.ends - s).max(), 1)) + 1)
        term = _BYTE[self.buf]
        at[self.space] = 0
        term *= power[at]
        return mix(np.add.reduceat(term, s) + (self.ends - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def windows(self, k: int = 3, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``k`` words that lies in one text, and its first word's index."""
        h = self.hashes() if hashes is None else hashes
        m = len(h) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.doc[:m] == self.doc[k - 1:])
        out = np.zeros(len(first), np.uint64)
        for j in range(k):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[first + j] + U(j + 1))
        return out, first

    def per_doc(self, flag: np.ndarray) -> np.ndarray:
        """Sum of ``flag`` (one value a byte) in each text."""
        if not self.n_docs:
            return np.zeros(0, np.int64)
        return np.add.reduceat(flag.astype(np.int64), self.doc_start)


def shingle_sets(blobs: list[bytes], k: int = 3, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``k`` words: the whole sequence as one."""
    w = Words(blobs, lower)
    h = w.hashes()
    sh, first = w.windows(k, h)
    doc = w.doc[first]
    cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
    word_cut = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
    out = []
    for d in range(w.n_docs):
        if cut[d] < cut[d + 1]:
            out.append(np.unique(sh[cut[d]:cut[d + 1]]))
        elif word_cut[d] < word_cut[d + 1]:
            x = np.zeros(1, np.uint64)
            for j, v in enumerate(h[word_cut[d]:word_cut[d + 1]]):
                x = mix(x * U(0x9E3779B97F4A7C15) + v + U(j + 101))
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
