"""Count tries of word sequences, in sorted order: building, serialising, cutting into prefix ranges, merging and walking.

A trie is held as its leaves in order: DEPTH columns of word numbers (0: the piece ends; others from 1, in the byte order of the
words) and a count each. An inner node is a run of leaves, and its count their sum.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs

#: Words on the way from the root to a leaf.
DEPTH = 4

_BLANKS = b"\x20\x09"
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Trie:
    words: pa.Array
    paths: list[np.ndarray]
    counts: np.ndarray


def tokens(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a text in byte order, the number (from 1) of each word in it, and the piece that it stands in."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(0, np.int32)
    piece = np.cumsum(kind == 2, dtype=np.int32)[edges[::2]]
    # every other item of this array is what lies between two words
    both = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    coded = both.dictionary_encode()
    used, numbers = np.unique(coded.indices.to_numpy()[::2], return_inverse=True)
    words, place = _sorted(coded.dictionary.take(pa.array(used)))
    return words.cast(pa.binary()), place[numbers], piece


def _sorted(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words in byte order, and the number (from 1) that each item has there."""
    order = pc.sort_indices(words)
    place = np.empty(len(words), np.uint32)
    place[order.to_numpy()] = np.arange(1, len(words) + 1, dtype=np.uint32)
    return words.take(order), place


def _merged(paths: list[np.ndarray], counts: np.ndarray | None, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Paths in order, equal ones as one; `paths` is emptied. The sort is stable and finds runs that are sorted already."""
    bits = np.uint64(max(1, int(words).bit_length()))
    mask = np.uint64((1 << int(bits)) - 1)
    low, high = ((b.astype(np.uint64) << bits) | a for a, b in ((paths.pop(), paths.pop()), (paths.pop(), paths.pop())))
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    del order, new
    high, low = high[first], low[first]
    return [x.astype(np.uint32) for x in (high >> bits, high & mask, low >> bits, low & mask)], total.astype(np.int64)


def built(text: bytes, most: int):
    """Tries of a text's word sequences, each of at most `most` places where one starts; and how many places it has."""
    words, numbers, piece = tokens(text)
    for start in range(0, len(numbers), most):
        own = numbers[start : start + most + DEPTH - 1]
        at, n = piece[start : start + most + DEPTH - 1], min(most, len(numbers) - start)
        used = words
        if n < len(numbers):
            which, own = np.unique(own, return_inverse=True)
            used, own = words.take(pa.array(which - 1)), (own + 1).astype(np.uint32)
        paths = []
        for k in range(DEPTH):
            path = np.zeros(n, np.uint32)
            reach = min(n, len(own) - k)
            if reach > 0:
                path[:reach] = np.where(at[k : k + reach] == at[:reach], own[k : k + reach], 0)
            paths.append(path)
        paths, counts = _merged(paths, None, len(used))
        yield Trie(used, paths, counts), n


def _branching(paths: list[np.ndarray]) -> np.ndarray:
    """The first level on which a leaf differs from the one before."""
    out = np.full(len(paths[0]), DEPTH - 1, np.uint8)
    for level in range(DEPTH - 2, -1, -1):
        out[1:][paths[level][1:] != paths[level][:-1]] = level
    out[:1] = 0
    return out


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, the lowest of all first: they compress better so."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view(np.uint32).ravel()


def dumped(trie: Trie) -> bytes:
    """The trie as bytes: words, levels of branching, the labels of each level's nodes in order, counts of leaves."""
    branch = _branching(trie.paths)
    labels = [p[branch <= level] for level, p in enumerate(trie.paths)]
    labels[0] = np.diff(labels[0], prepend=np.uint32(0))
    text = b"".join(trie.words.to_pylist())
    lengths = pc.binary_length(trie.words).to_numpy()
    head = np.array([len(trie.words), len(text), len(branch), *[len(x) for x in labels], bool((trie.counts >> 32).any())], np.int64)
    counts = [trie.counts & 0xFFFFFFFF, trie.counts >> 32] if head[-1] else [trie.counts]
    body = [_planes(lengths), text, branch.tobytes(), *[_planes(x) for x in (*labels, *counts)]]
    return zs.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(body))


def loaded(data: bytes) -> Trie:
    raw = np.frombuffer(zs.ZstdDecompressor().decompress(data), np.uint8)
    head = raw[: 8 * (DEPTH + 4)].view(np.int64)
    at = 8 * (DEPTH + 4)

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return raw[at - n : at]

    lengths = _unplaned(take(4 * head[0]))
    text = take(head[1])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), int(head[0]), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    branch = take(head[2])
    paths = []
    for level in range(DEPTH):
        labels = _unplaned(take(4 * head[3 + level]))
        labels = np.cumsum(labels, dtype=np.uint32) if level == 0 else labels
        paths.append(labels[np.cumsum(branch <= level) - 1])
    counts = _unplaned(take(4 * head[2])).astype(np.int64)
    if head[-1]:
        counts |= _unplaned(take(4 * head[2])).astype(np.int64) << 32
    return Trie(words, paths, counts)


def leaf(trie: Trie, at: int) -> list[bytes]:
    """The words of a leaf; an end is the empty word."""
    return [trie.words[int(p[at]) - 1].as_py() if p[at] else b"" for p in trie.paths]


def places(trie: Trie, bounds: list[list[bytes]]) -> list[int]:
    """For each bound the number of leaves that come before it."""
    words = trie.words.to_pylist()
    out = []
    for bound in bounds:
        low, high = 0, len(trie.counts)
        for path, word in zip(trie.paths, bound):
            number = bisect_left(words, word) + 1 if word else 0
            known = not word or (number <= len(words) and words[number - 1] == word)
            own = path[low:high]
            first = low + int(np.searchsorted(own, np.uint32(number)))
            high = low + int(np.searchsorted(own, np.uint32(number), "right")) if known else first
            low = first
            if low == high:
                break
        out.append(low)
    return out


def cut(trie: Trie, start: int, end: int) -> Trie:
    """The leaves from start to end, with the words that occur in them."""
    paths = [p[start:end] for p in trie.paths]
    used, numbers = np.unique(np.concatenate([[0], *paths]).astype(np.uint32), return_inverse=True)
    numbers = numbers[1:].astype(np.uint32).reshape(DEPTH, -1)
    return Trie(trie.words.take(pa.array(used[1:].astype(np.int64) - 1)), list(numbers), trie.counts[start:end])


def merged(tries: list[Trie]) -> Trie:
    """One trie of several, whose list is emptied: their words are numbered together, in order, so that each is a sorted run of one
    merging sort."""
    coded = pa.chunked_array([t.words for t in tries]).combine_chunks().dictionary_encode()
    words, place = _sorted(coded.dictionary)
    numbers, at, total = place[coded.indices.to_numpy()], 0, sum(len(t.counts) for t in tries)
    paths, counts, done = [np.empty(total, np.uint32) for _ in range(DEPTH)], np.empty(total, np.int64), 0
    tries.reverse()
    while tries:
        t = tries.pop()
        own = np.concatenate([np.zeros(1, np.uint32), numbers[at : at + len(t.words)]])
        for to, path in zip((*paths, counts), (*t.paths, None)):
            to[done : done + len(t.counts)] = t.counts if path is None else own[path]
        at, done = at + len(t.words), done + len(t.counts)
    return Trie(words, *_merged(paths, counts, len(words)))


def walked(trie: Trie, least: int):
    """(words, count, counts of the nodes above, on the rim) for every node with a count of `least`, and for those on the trie's rim.

    Nodes on the way to the first and to the last leaf are on the rim: a neighbouring range may hold the rest of them. A count of one of them
    is a part only, and given as None to the nodes below it.
    """
    branch = _branching(trie.paths)
    above = []
    for level in range(DEPTH):
        starts = np.flatnonzero(branch <= level)
        counts = np.add.reduceat(trie.counts, starts)
        rim = np.zeros(len(starts), bool)
        rim[[0, -1]] = True
        chosen = np.flatnonzero((trie.paths[level][starts] != 0) & ((counts >= least) | rim))
        heads = starts[chosen]
        ways = [[None if r else c for c, r in zip(cs[own[heads]].tolist(), rs[own[heads]].tolist())] for cs, rs, own in above]
        labels = [trie.words.take(pa.array(p[heads].astype(np.int64) - 1)).to_pylist() for p in trie.paths[: level + 1]]
        for k in range(len(chosen)):
            yield b" ".join(x[k] for x in labels).decode(), int(counts[chosen[k]]), [w[k] for w in ways], bool(rim[chosen[k]])
        above.append((counts, rim, np.cumsum(branch <= level) - 1))
