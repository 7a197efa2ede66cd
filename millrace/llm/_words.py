"""Words of a batch of texts as numpy arrays, with 64-bit hashes of words and of runs of words.

A hash is a polynomial over random 64-bit values of the bytes, modulo 2**64 with an odd base, so that any word's or
run's hash comes from two prefix sums; a finishing mix follows.  Words of over LONG bytes are hashed by BLAKE2, since
such polynomials have known collisions in long inputs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LONG = 256
_BASE, _RUN_BASE = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finishing mix of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class _Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.n = base, 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            made = []
            for b in (self.base, _inverse(self.base)):
                p = np.full(self.n, b, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_bytes, _runs = _Powers(_BASE), _Powers(_RUN_BASE)


def _folded() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER, SAME = _folded(), np.arange(256, dtype=np.uint8)
#: Bytes of words `[^\x20\x09-\x0D]+`.
BLANK_SEPARATED = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
ALPHANUMERIC = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass
class Words:
    data: np.ndarray  # the texts' UTF-8, folded
    row: np.ndarray  # of each word
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row, its first word; one more entry at the end

    def runs(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k consecutive words, and whether a run stays in one text; one for each start.
        Another salt gives independent hashes."""
        n = max(0, len(self.hash) - k + 1)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        up, down = _runs.get(len(self.hash))
        own = mix(self.hash ^ np.uint64(salt)) if salt else self.hash
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up, dtype=np.uint64)])
        return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k)), self.row[:n] == self.row[k - 1 :]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in a row (null: empty), and each text's offset with one more at the end."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, inside: np.ndarray = BLANK_SEPARATED, fold: np.ndarray = SAME) -> Words:
    raw, at = buffers(texts)
    data = fold[raw]
    n = len(data)
    cls = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    start = np.flatnonzero(cls & (~before | cut[:-1]))
    end = np.flatnonzero(cls & (~after | cut[1:])) + 1
    row = np.searchsorted(at, start, "right") - 1
    up, down = _bytes.get(max(n, 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)])
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(end - start > LONG):
        hashed[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    first = np.searchsorted(row, np.arange(len(at)))
    return Words(data, row, start, end, hashed, first)
