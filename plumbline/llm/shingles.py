"""Hashed word shingles of many texts at once, in numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed together: bounds a worker's memory, but for one longer text.
CHUNK = 1 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * _M2
        z = (z ^ (z >> np.uint64(27))) * _M3
        return z ^ (z >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_LETTER = mix(_LOWER.astype(np.uint64), 7)
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first and last byte of each word, bounds of the texts) of a string column without nulls."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(bounds[0]), int(bounds[-1])
    raw = np.frombuffer(column.buffers()[2], np.uint8)[low:high]
    bounds = bounds - low
    ink = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:-1]
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    return raw, np.flatnonzero(begins), np.flatnonzero(ends), bounds


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of each text and the end) of a string column without nulls."""
    raw, first, last, bounds = word_places(column)
    power, inverse = powers(len(raw))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * power[: len(raw)], dtype=np.uint64)))
        value = (sums[last + 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)
    return mix(value), np.searchsorted(first, bounds)


def word_tails(column: pa.Array) -> np.ndarray:
    """The last three bytes of each word, A-Z as a-z, as one number; shorter words are filled with zeros."""
    raw, first, last, _ = word_places(column)
    tail = np.zeros(len(first), np.uint64)
    for back in range(3):
        at = last - back
        tail = tail << np.uint64(8) | np.where(at >= first, _LOWER[raw[np.maximum(at, 0)]], 0).astype(np.uint64)
    return tail


def shingle_sets(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``words`` words, or of the whole sequence where it is shorter."""
    value, bounds = word_hashes(column)
    n = len(value) - words + 1
    out = []
    with np.errstate(over="ignore"):
        if n > 0:
            joined = np.zeros(n, np.uint64)
            for i in range(words):
                joined = joined * _M1 + value[i : i + n]
            joined = mix(joined, 1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(joined[a : b - words + 1]))
            elif b > a:
                h = np.zeros(1, np.uint64)
                for w in value[a:b]:
                    h = mix(h * _M1 + w, 2)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end
