"""Approximate nearest neighbours by stable projections, a kd-tree and a stopping test.

Largest inner product becomes smallest distance: a vector gets one more component
that lifts it to the largest length of its shard, and a query is scaled to that
length.  Gaussian projections to a few dimensions turn a squared distance
d^2 into d^2 times a chi-square variable.  A kd-tree over the projections yields
leaves by rising distance from the query; their vectors are verified
by exact products until a vector nearer than the k-th best would, with
probability ``CONFIDENCE``, have been projected nearer than the next leaf.

Every row is indexed.  Measured recall is in the README and checked in the tests.
Defined cases: vectors that are null, zero or hold null or non-finite
components, and null vec_ids, take no part; with fewer than k candidates all are returned; ties
go to the smaller vec_id; repeated rows are candidates each; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.vector_shards import PLACES, finite_vectors, nearest

DIMENSIONS = 8
LEAF = 64
CONFIDENCE = 0.98
SEED = 20
# Leaves verified in the first round; each later round doubles it.
FIRST_LEAVES = 8
_SPARE = 8
_GRID = 2.0**40


def chi_square_cdf(x: np.ndarray, degrees: int = DIMENSIONS) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, dtype=float) / 2, 700.0)
    term = total = np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Places of points by leaf: halves at the median of the widest dimension."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        places = todo.pop()
        if len(places) <= leaf:
            leaves.append(places)
            continue
        own = points[places]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        middle = len(places) // 2
        order = np.argpartition(own[:, axis], middle)
        todo += [places[order[:middle]], places[order[middle:]]]
    return leaves


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query, places and exact products of the k nearest found in one shard; ``ids`` ascend."""
    norms = (vectors**2).sum(axis=1)
    longest = math.sqrt(norms.max())
    lift = np.sqrt(np.maximum(longest**2 - norms, 0.0))
    unit = queries / np.sqrt((queries**2).sum(axis=1))[:, None]
    gauss = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, DIMENSIONS))
    points = (vectors @ gauss[:-1] + lift[:, None] * gauss[-1]) / longest
    asked = unit @ gauss[:-1]
    leaves = kd_leaves(points)
    low = np.array([points[x].min(axis=0) for x in leaves])
    high = np.array([points[x].max(axis=0) for x in leaves])
    gaps = np.zeros((len(queries), len(leaves)))
    for axis in range(DIMENSIONS):
        at = asked[:, axis : axis + 1]
        gaps += np.maximum(np.maximum(low[:, axis] - at, at - high[:, axis]), 0.0) ** 2
    order = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, order, axis=1)
    scaled = vectors / longest
    keep = k + _SPARE
    lowest = -np.iinfo(np.int64).max
    best = np.full((len(queries), keep), lowest, dtype=np.int64)
    active, start, step = np.arange(len(queries)), 0, FIRST_LEAVES
    largest = max(map(len, leaves))
    while len(active) and start < len(leaves):
        stop = min(start + step, len(leaves))
        # Queries are taken in slices, so the keys of a round stay small.
        rows = max(1, (4 << 20) // ((stop - start) * largest))
        for first in range(0, len(active), rows):
            who = active[first : first + rows]
            chosen = order[who, start:stop]
            keys = np.full((len(who), stop - start, largest), lowest, dtype=np.int64)
            flat, slots = chosen.ravel(), np.argsort(chosen.ravel(), kind="stable")
            bounds = np.searchsorted(flat[slots], np.arange(len(leaves) + 1))
            for n in np.unique(flat):
                row, slot = np.divmod(slots[bounds[n] : bounds[n + 1]], stop - start)
                places = leaves[n]
                products = np.rint(unit[who[row]] @ scaled[places].T * _GRID).astype(np.int64)
                found = products * PLACES + (PLACES - 1 - places)
                found[query_ids[who[row]][:, None] == ids[places][None, :]] = lowest
                keys[row, slot, : len(places)] = found
            merged = np.concatenate([best[who], keys.reshape(len(who), -1)], axis=1)
            best[who] = -np.partition(-merged, keep - 1, axis=1)[:, :keep]
        start, step = stop, step * 2
        if start < len(leaves):
            kth = -np.partition(-best[active], k - 1, axis=1)[:, k - 1]
            reach = np.maximum(2 - 2 * (kth // PLACES) / _GRID, 1e-12)
            done = (kth != lowest) & (chi_square_cdf(gaps[active, start] / reach) >= CONFIDENCE)
            active = active[~done]
    out = []
    for row, query in zip(best, queries):
        found = row[row != lowest]
        places = PLACES - 1 - found % PLACES
        scores = np.multiply(vectors[places], query).sum(axis=1)
        chosen = np.lexsort((places, -scores))[:k]
        out.append((places[chosen], scores[chosen]))
    return out


def nearest_neighbours(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: nearest by inner product in double precision."""
    vectors = finite_vectors(rows, lambda x: x.cast("double")).filter(F.exists("vec", lambda x: x != 0))

    def search(query_ids, queries, ids, matrix):
        return search_block(query_ids, queries, ids, matrix, k)

    return nearest(vectors, every, k, search, "double")
