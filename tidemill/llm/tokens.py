"""Vectorised words, shingles and hashes over the texts of an Arrow batch; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: True for bytes of a word: all but space and the five ASCII controls from tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: True for ASCII letters and digits and every byte of a longer UTF-8 sequence.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Lower-cases A-Z only.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def randoms(n: int, seed: int = 0) -> np.ndarray:
    """n fixed pseudo-random odd numbers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BYTE, _PLACE = randoms(256, 1), randoms(4096, 2)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = randoms(2 * n, 2)
    return _PLACE


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece has at most ``limit`` bytes of text, or a single row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts and the last ends; null is empty."""
    column = pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


class Words:
    """The words of several texts: byte range, row and 64-bit hash of each."""

    def __init__(self, column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False):
        self.data, self.bounds = utf8(column)
        self.rows = len(column)
        data, inside = self.data, kind[self.data]
        first, last = self.bounds[:-1], self.bounds[1:] - 1
        some = first <= last
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[first[some]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[last[some]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Index of the first word of each row, and one past the last word of all.
        self.of = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.of)
        self.row = np.repeat(np.arange(self.rows), self.count)
        length = self.end - self.start
        if len(length):
            at = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(at, length)
            letters = data[inside]
            value = _BYTE[LOWER[letters] if lower else letters]
            sums = np.add.reduceat(value * _places(int(length.max()))[place], at)
            self.hash = mix(sums ^ length.astype(_U))
        else:
            self.hash = np.zeros(0, _U)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of n words within a row, and the row; a row with fewer words has one run of all."""
        total = len(self.hash)
        key = randoms(n, 3)
        if total >= n:
            value = np.zeros(total - n + 1, _U)
            for j in range(n):
                value += self.hash[j:total - n + 1 + j] * key[j]
            whole = self.row[:total - n + 1] == self.row[n - 1:]
            value, row = mix(value[whole]), self.row[:total - n + 1][whole]
        else:
            value, row = np.zeros(0, _U), np.zeros(0, np.int64)
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if len(short):
            extra = np.array([(self.hash[self.of[r]:self.of[r + 1]] * key[:self.count[r]]).sum(dtype=_U) for r in short], _U)
            extra = mix(extra ^ self.count[short].astype(_U) * _U(0xD6E8FEB86659FD93))
            order = np.argsort(np.concatenate([row, short]), kind="stable")
            value, row = np.concatenate([value, extra])[order], np.concatenate([row, short])[order]
        return value, row


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of ``width`` values: one forward and one backward pass over blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])
