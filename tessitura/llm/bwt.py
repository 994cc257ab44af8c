"""Merging Burrows-Wheeler transforms of shards by interleave refinement, up to a depth (numpy, for one task's strings).

Each shard sorts its own suffixes. The merged order is never sorted: starting from the shards laid end to end, a stable
distribution by the preceding character (the transform) turns the order by h characters into the order by h + 1. Rows that
share their first h characters form an interval; where an interval splits, the common prefix of its parts is h. Intervals of
one row can't repeat, and leave the refinement.
"""

from __future__ import annotations

import numpy as np

#: Characters of a shard.
SHARD = 1 << 18


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, transform, row of the suffix one character earlier) of uint16 characters, by prefix doubling to 56
    characters; deeper ties stay as they are, which no refinement to less depth can see."""
    n = len(text)
    wide = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | wide[k : k + n]
    step = 7
    while True:
        rows = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        own = key[rows]
        rank[rows] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])]) if n else rank
        if step >= 56 or not n or rank[rows[-1]] == n - 1:
            break
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        key = (rank * (n + 2) + later).astype(np.uint64)
        step *= 2
    place = np.empty(n, np.int64)
    place[rows] = np.arange(n)
    before = np.where(rows > 0, text[rows - 1], 0).astype(np.uint16)
    return rows, before, place[rows - 1]


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of suffixes that share `depth` characters: (places in the shards laid end to end, interval of each).

    Characters are uint16; 0 ends a string and matches nothing. Only intervals of two or more suffixes are returned.
    """
    parts = [shard_transform(s) for s in shards]
    starts = np.cumsum([0, *(len(s) for s in shards)])
    text_of = np.concatenate([rows + a for (rows, _, _), a in zip(parts, starts)] or [np.zeros(0, np.int64)]).astype(np.int32)
    before = np.concatenate([b for _, b, _ in parts] or [np.zeros(0, np.uint16)])
    earlier = np.concatenate([e + a for (_, _, e), a in zip(parts, starts)] or [np.zeros(0, np.int64)]).astype(np.int32)
    rows = np.arange(len(text_of), dtype=np.int32)
    interval = np.zeros(len(rows), np.int32)
    for _ in range(depth):
        kept = before[rows] != 0
        rows, interval = rows[kept], interval[kept]
        if not len(rows):
            break
        char = before[rows]
        order = np.argsort(char, kind="stable")
        char, interval = char[order], interval[order]
        rows = earlier[rows[order]]
        new = np.ones(len(rows), bool)
        new[1:] = (char[1:] != char[:-1]) | (interval[1:] != interval[:-1])
        alone = new & np.append(new[1:], True)
        interval = np.cumsum(new, dtype=np.int32)[~alone]
        rows = rows[~alone]
    return text_of[rows], interval


def least_by_window(strings: list[np.ndarray], owners: np.ndarray, depth: int = 50) -> list[np.ndarray]:
    """For every `depth`-byte window of every string, the least owner among all strings that hold an equal window."""
    out = [np.full(max(0, len(s) - depth + 1), o, np.int64) for s, o in zip(strings, owners)]
    shards, held, of, at = [], [], [], []
    size = 0

    def close():
        nonlocal held, size
        if held:
            shards.append(np.concatenate(held))
            held, size = [], 0

    for k, s in enumerate(strings):
        held += [s.astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)]
        of.append(np.full(len(s) + 1, k, np.int64))
        at.append(np.arange(len(s) + 1))
        size += len(s) + 1
        if size >= SHARD:
            close()
    close()
    if not shards:
        return out
    of, at = np.concatenate(of), np.concatenate(at)
    places, interval = merge(shards, depth)
    if len(places):
        first = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
        least = np.minimum.reduceat(owners[of[places]], first)
        value = np.repeat(least, np.diff(np.append(first, len(places))))
        bounds = np.cumsum([0, *map(len, out)])
        flat = np.concatenate(out)
        flat[bounds[of[places]] + at[places]] = value
        out = [flat[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
    return out
