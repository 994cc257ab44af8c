"""Words, shingles and their hashes for whole Arrow batches of text, as numpy arrays.

Words are runs of bytes other than the ASCII white space 0x20 and 0x09-0x0D. All hashes are 64 bits and follow fixed seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer document is a slice of its own.
SLICE = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACES = _draw.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of the base and of its inverse modulo 2**64; kept for the next call."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            one = np.full(max(n, SLICE), b, np.uint64)
            one[0] = 1
            _powers[k] = np.multiply.accumulate(one)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[k] * base**k over i <= k < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def string_slices(column: pa.Array, size: int = SLICE):
    """(first row, bytes as uint8, offsets of rows) for slices of about `size` bytes of a string or binary column; nulls are empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and per document the index of its first word (with the total behind)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A hash for each word; with fold, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_hashes((_FOLDED if fold else _BYTE)[data])
    return mix((sums[ends] - sums[starts]) * powers(len(data))[1][starts])


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether all of them lie in its document."""
    m = len(hashes)
    if m < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(m - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : m - n + 1 + k] * _PLACES[k]
    end = np.repeat(first[1:], np.diff(first))
    return mix(out), np.arange(n, m + 1) <= end[: m - n + 1]


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-word shingle in order; a document of fewer words has its whole sequence as the only one."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, whole = windows(hashes, first, n)
    out, owner = out[whole], doc[: len(out)][whole]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            own[has] += hashes[first[short[has]] + k] * _PLACES[n + k]
        out, owner = np.concatenate([out, mix(own + count[short].astype(np.uint64))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted by owner and value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def text_shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a slice's documents, case folded: (hash, document), by document and hash."""
    starts, ends, first = word_bounds(data, offsets)
    return distinct(*shingles(word_hashes(data, starts, ends, True), first, n))
