"""Words, shingles and sets of whole texts as numpy arrays, for use inside tasks.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Hashes
have 64 bits: a word's is a polynomial over random byte values, read off one running
sum per batch, so that no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _upper in range(65, 91):
    _BYTE_VALUES[_upper] = _BYTE_VALUES[_upper + 32]
_BASE = int(_SEED.integers(1, 2**62)) * 2 + 1
_PLACES = _SEED.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SPAN = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SPAN - 1, base, np.uint64)]), dtype=np.uint64)


_POWER = _powers(_BASE)
_STEP = pow(_BASE, _SPAN, 1 << 64)
_BACK = _powers(pow(_BASE, -1, 1 << 64))
_BACK_STEP = pow(pow(_BASE, -1, 1 << 64), _SPAN, 1 << 64)


def _power_at(positions: np.ndarray, low: np.ndarray, step: int) -> np.ndarray:
    high = _high_powers(step, int(positions.max() >> 16) + 1 if len(positions) else 1)
    return low[positions & (_SPAN - 1)] * high[positions >> 16]


def _high_powers(step: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, step, np.uint64)]), dtype=np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and where each row begins and ends in them (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return bytes_, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all rows begin and end; no word crosses a bound."""
    solid = np.zeros(len(data) + 1, bool)
    np.logical_not(_BLANK[data], out=solid[:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~solid))
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        values = _BYTE_VALUES[data]
        high = _high_powers(_STEP, (len(data) >> 16) + 1)
        for k in range(0, len(data), _SPAN):
            values[k:k + _SPAN] *= _POWER[:len(values[k:k + _SPAN])] * high[k >> 16]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return mixed((total[ends] - total[starts]) * _power_at(starts, _BACK, _BACK_STEP))


def rows_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the place of its first word among all words, and at the end their number."""
    return np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, firsts: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted; a shorter row is one shingle, a row without words has none."""
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        whole = np.full(n, np.uint64(size), np.uint64)
        for k in range(size):
            whole += words[k:k + n] * _PLACES[k]
        whole = mixed(whole)
        out = []
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= size:
                out.append(distinct(whole[a:b - size + 1]))
            elif b > a:
                one = np.full(1, np.uint64(b - a), np.uint64)
                for k in range(b - a):
                    one += words[a + k] * _PLACES[k]
                out.append(mixed(one))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) > 1 else values


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Parts of a batch whose text has about so many bytes at most; one row at least."""
    lengths = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset:lengths.offset + len(lengths) + 1])
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and held + size > most_bytes:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if batch.num_rows > first:
        yield batch.slice(first)
