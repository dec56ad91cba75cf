"""Enhanced suffix arrays of a batch of strings, and their maximal repeats."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Repeats(NamedTuple):
    """Maximal repeats: suffixes ``first`` to ``last`` of the array ``order`` share ``length`` bytes."""

    order: np.ndarray
    length: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def occurrences(self, i: int) -> np.ndarray:
        """Places of all occurrences of the i-th repeat."""
        return self.order[self.first[i] : self.last[i] + 1]


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes plus one with a 0 after each string, each string's first place, and what is left of its string at each place."""
    data = np.frombuffer(b"\0".join([*strings, b""]), dtype=np.uint8).astype(np.uint16)
    sizes = np.array([len(x) for x in strings], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(data))
    return np.where(left > 0, data + 1, 0), starts, left


def _prefix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(k, rank of the k bytes from each place) for k = 4, 8, ... up to at least ``depth``.

    Shorter rests count as if filled up with what is smaller than any byte; the
    marks after strings stop longer prefixes from meaning anything beyond them.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(4, dtype=data.dtype)]).astype(np.int64)
    key = ((padded[:n] * 257 + padded[1 : n + 1]) * 257 + padded[2 : n + 2]) * 257 + padded[3 : n + 3]
    k, levels = 4, []
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append((k, rank.astype(np.int32)))
        if k >= depth:
            return levels
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        k *= 2


def _common_prefixes(levels: list[tuple[int, np.ndarray]], data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at ``a`` and at ``b``, pair by pair, within their strings."""
    n, most = len(data), np.minimum(left[a], left[b])
    length = np.zeros(len(a), dtype=np.int64)
    for k, rank in [*levels[::-1]]:
        x, y = a + length, b + length
        inside = (x < n) & (y < n) & (length < most)
        same = inside.copy()
        same[inside] = rank[x[inside]] == rank[y[inside]]
        length[same] += k
    for _ in range(3):
        x, y = a + length, b + length
        inside = (x < n) & (y < n) & (length < most)
        same = inside.copy()
        same[inside] = data[x[inside]] == data[y[inside]]
        length[same] += 1
    return np.minimum(length, most)


def maximal_repeats(strings: list[bytes], least: int) -> tuple[Repeats, np.ndarray, np.ndarray]:
    """All maximal repeats of at least ``least`` bytes; also each string's first place and the rests.

    The suffixes that are long enough are sorted, and the intervals of their
    common-prefix tree are found by a scan with a stack.  An interval is a
    maximal repeat if different bytes, or the start of a string, come before
    its suffixes; one that is always preceded by the same byte lies within
    the repeat that starts a byte earlier.
    """
    data, starts, left = joined(strings)
    depth = max([len(x) for x in strings], default=0)
    empty = np.zeros(0, dtype=np.int64)
    places = np.flatnonzero(left >= least)
    if len(places) < 2:
        return Repeats(places, empty, empty, empty), starts, left
    levels = _prefix_ranks(data, depth)
    order = places[np.argsort(levels[-1][1][places], kind="stable")]
    # Cheap test first: what differs in the longest prefix not above ``least`` is no repeat.
    k, rank = max((x for x in levels if x[0] <= least), key=lambda x: x[0], default=levels[0])
    alike = np.flatnonzero(rank[order[1:]] == rank[order[:-1]]) if k <= least else np.arange(len(order) - 1)
    common = np.zeros(len(order), dtype=np.int64)  # with the suffix before
    common[alike + 1] = _common_prefixes(levels, data, left, order[alike], order[alike + 1])
    before = np.where(np.isin(order, starts), -1, data[order - 1].astype(np.int64))
    # Runs of suffixes that share ``least`` bytes: the roots of the part of the tree that is wanted.
    linked = common >= least
    edge = np.diff(np.concatenate([linked, [False]]).astype(np.int8))
    firsts, lasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if linked[0]:
        raise AssertionError("the first suffix has none before it")
    if not len(firsts):
        return Repeats(order, empty, empty, empty), starts, left
    # Where the same byte comes before all suffixes of a run, none of its intervals is maximal.
    varied = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])
    diverse = varied[lasts] > varied[firsts]
    firsts, lasts = firsts[diverse], lasts[diverse]
    found: list[tuple[int, int, int]] = []
    for first, last in zip(firsts.tolist(), lasts.tolist()):
        inner = common[first + 1 : last + 1].tolist()
        if min(inner) == max(inner):
            found.append((inner[0], first, last))
            continue
        stack: list[tuple[int, int]] = []
        for at, depth_ in enumerate([*inner, 0], first):
            low = at
            while stack and stack[-1][0] > depth_:
                length, low = stack.pop()
                # Suffixes low..at share ``length`` bytes.
                if varied[at] > varied[low]:
                    found.append((length, low, at))
            if depth_ and (not stack or stack[-1][0] < depth_):
                stack.append((depth_, low))
    table = np.array(found, dtype=np.int64).reshape(-1, 3)
    return Repeats(order, table[:, 0], table[:, 1], table[:, 2]), starts, left


def covered(repeats: Repeats, size: int) -> np.ndarray:
    """Per place of the joined bytes, whether an occurrence of a repeat covers it."""
    longest = np.zeros(len(repeats.order), dtype=np.int64)
    for i in np.argsort(repeats.length, kind="stable"):  # longer repeats lie within shorter ones
        longest[repeats.first[i] : repeats.last[i] + 1] = repeats.length[i]
    marks = np.zeros(size + 1, dtype=np.int64)
    some = longest > 0
    np.add.at(marks, repeats.order[some], 1)
    np.add.at(marks, repeats.order[some] + longest[some], -1)
    return np.cumsum(marks[:-1]) > 0
