"""Word shingles of whole texts as sets of 64-bit numbers, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_BASE = np.uint64(0x100000001B3)


def _at(k: int) -> np.ndarray:
    """What tells the k-th word of a shingle from the others."""
    return _PLACE[[k % 4]] * np.array([k + 1], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, A-Z lower-cased, and the number of words of each text."""
    encoded = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)]
    ends_of_texts = np.cumsum([len(x) + 1 for x in encoded])
    visible = ~_WHITE[data]
    edge = np.diff(np.concatenate([[False], visible, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    inside = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
    sums = np.add.reduceat((data[visible].astype(np.uint64) + np.uint64(1)) * powers[inside], firsts)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends_of_texts])))
    return mixed(sums + lengths.astype(np.uint64) * _PLACE[1]), counts


def shingle_sets(texts: list[str], words: int = 4) -> list[np.ndarray]:
    """Per text, its distinct shingles in ascending order.

    With fewer words than ``words`` the whole sequence is one shingle; without
    words the set is empty.
    """
    hashes, counts = word_hashes(texts)
    total = max(0, len(hashes) - words + 1)
    rows = np.zeros(total, dtype=np.uint64)
    for k in range(words):
        rows = rows + mixed(hashes[k : k + total] + _at(k))
    rows = mixed(rows)
    out, start = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rows[start : start + n - words + 1]))
        elif n:
            own = hashes[start : start + n]
            short = sum((mixed(own[k : k + 1] + _at(k)) for k in range(n)), np.zeros(1, dtype=np.uint64))
            out.append(mixed(short + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        start += n
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sets in ascending order."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union|; an empty set is similar to nothing."""
    least, most = sorted((len(a), len(b)))
    if not least or 100 * least < percent * most:
        return False
    common = overlap(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)
