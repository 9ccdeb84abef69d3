"""Vectorised word kernel: spans, hashes and n-grams of many texts at once, on Arrow buffers inside tasks.

A word is a run of bytes other than space and 0x09-0x0D.  Words and word sequences are compared by 64-bit hashes: a
polynomial modulo 2**64 over random byte values, finished by an avalanche step.  Tables are derived from a fixed
formula, so every worker computes the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 19  # bytes hashed at a time; keeps the temporaries in cache
STEP = 0x9E3779B97F4A7C15
NULL_ID = -(2**63)  # stands for a null id in numpy arrays


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step on uint64 values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(STEP))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that column ``text`` holds about ``limit`` bytes; one text is never cut."""
    for batch in batches:
        _, offsets = buffers(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def ids(column: pa.Array) -> np.ndarray:
    """An id column as int64, nulls as ``NULL_ID``."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    values = np.asarray(values, dtype=np.int64)
    return pa.array(values, mask=values == NULL_ID)


class Words:
    """Words of concatenated texts: ``start``, ``end`` (byte offsets), ``hash`` and ``first`` (n + 1 word offsets)."""

    def __init__(self, start, end, hashes, first):
        self.start, self.end, self.hash, self.first = start, end, hashes, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Hasher:
    """Finds and hashes words; ``lower`` folds A-Z."""

    def __init__(self, lower: bool = False):
        table = stream(1, 256)
        if lower:
            table[65:91] = table[97:123]
        self.table = table
        self.is_word = np.ones(256, bool)
        self.is_word[[9, 10, 11, 12, 13, 32]] = False
        self.power = self.inverse = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if n >= len(self.power):
            base = STEP | 1
            self.power = np.cumprod(np.r_[U(1), np.full(n, base, U)])
            self.inverse = np.cumprod(np.r_[U(1), np.full(n, pow(base, -1, 2**64), U)])

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self.is_word[data]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.empty(len(data) + 1, bool)
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        # texts that touch without a separator between them
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[inside[cut] & inside[cut - 1]]
        marks = np.flatnonzero(edge)
        if len(cut):
            marks = np.sort(np.concatenate([marks, cut, cut]))
        return marks[0::2], marks[1::2]

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span of ``data``; spans are in order and don't overlap."""
        out = np.empty(len(start), U)
        at = 0
        while at < len(start):
            base = start[at]
            to = max(at + 1, int(np.searchsorted(end, base + BLOCK, side="right")))
            size = int(end[to - 1] - base)
            self._grow(size)
            sums = np.empty(size + 1, U)
            sums[0] = 0
            np.cumsum(self.table[data[base : base + size]] * self.power[:size], out=sums[1:])
            s, e = start[at:to] - base, end[at:to] - base
            out[at:to] = mix((sums[e] - sums[s]) * self.inverse[s])
            at = to
        return out

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        start, end = self.spans(data, offsets)
        return Words(start, end, self.hashes(data, start, end), np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive words (also across texts: mask with ``inside``)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    factors = stream(100 + salt, k) | U(1)
    out = hashes[:n] * factors[0]
    for j in range(1, k):
        out += hashes[j : j + n] * factors[j]
    return mix(out + U(k))


def wide(hashes: np.ndarray, k: int, salts: tuple[int, ...]) -> list[np.ndarray]:
    """One hash of every ``k`` >= 4 consecutive words per salt, from hashes of four words each."""
    four, n = grams(hashes, 4), len(hashes) - k + 1
    if n <= 0:
        return [np.zeros(0, U) for _ in salts]
    places = [*range(0, k - 3, 4), *([k - 4] if k % 4 else [])]
    out = []
    for salt in salts:
        factors = stream(200 + salt, len(places)) | U(1)
        total = four[:n] * factors[0]
        for place, factor in zip(places[1:], factors[1:]):
            total += four[place : place + n] * factor
        out.append(mix(total + U(k)))
    return out


def least(values: np.ndarray, k: int) -> np.ndarray:
    """Smallest of every ``k`` consecutive values."""
    size = 1
    while 2 * size <= k:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (k - size)], values[k - size :]) if size < k else values


def by_word(words: np.ndarray, context: np.ndarray) -> np.ndarray:
    """An order by word and context (both 64-bit hashes)."""
    every = np.unique(words, return_inverse=True)[1].astype(U) << U(32)
    if len(words):
        every |= np.unique(context, return_inverse=True)[1].astype(U)
    return np.argsort(every)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the ``grams`` positions lie in one text."""
    total = int(first[-1])
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    if k > 1 and n:
        ends = first[1:]
        bad = (ends[:, None] - np.arange(1, k)[None, :]).ravel()  # the last k - 1 words of each text
        counts = np.diff(first)
        valid = (np.arange(1, k)[None, :] <= counts[:, None]).ravel()
        bad = bad[valid]
        ok[bad[(bad >= 0) & (bad < n)]] = False
    return ok


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct ``k``-word shingles; with fewer words the whole sequence is one."""
    values = grams(words.hash, k)
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = last - first
        if n >= k:
            found = np.sort(values[first : last - k + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif n:
            yield grams(words.hash[first:last], n, salt=1)
        else:
            yield np.zeros(0, U)
