"""Exact top-k search by inner product over buckets of vectors of similar length.

Within a task, vectors are sorted by length and cut into buckets.  A query's
k-th best score so far, over the query's and the bucket's largest length, is the
cosine that a vector of the bucket must reach.  Above 1 the bucket is skipped.
High thresholds prune by coordinates: the largest coordinates of the query bound
those of a vector at that cosine.  Low ones prune by length.  What is left
is verified by its product.

Defined cases: vectors that are null or hold null or non-finite components, and
null vec_ids, take no part; with fewer than k candidates all are returned; ties
go to the smaller vec_id; repeated rows are candidates each; an empty table
gives no row.  Products are exact whatever their size; one beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.vector_shards import PLACES, finite_vectors, nearest

BUCKET = 1024
# From this cosine on, coordinates prune better than lengths.
COORDINATE_COSINE = 0.75
FOCUS = 3
_SLACK = 1e-9
# More than the root of a rounding error near 1.
_ROOM = 1e-7


def _keys(scores: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One number that sorts by score, then by the smaller place."""
    return scores.astype(np.int64) * PLACES + (PLACES - 1 - places)


def _by_coordinates(query: np.ndarray, cosine: float, directions: np.ndarray) -> np.ndarray:
    """Places of directions that can reach ``cosine`` with the query, judged by its largest coordinates.

    A cosine of at least c bounds a coordinate to both sides of the query's own, as far as
    the axis itself is not within that cosine.
    """
    fits = np.ones(len(directions), dtype=bool)
    for f in np.argsort(-np.abs(query))[:FOCUS]:
        middle = query[f] * cosine
        room = np.sqrt(max(0.0, (1 - cosine**2) * (1 - query[f] ** 2))) + _ROOM
        if query[f] <= cosine:
            fits &= directions[:, f] <= middle + room
        if query[f] >= -cosine:
            fits &= directions[:, f] >= middle - room
    return np.flatnonzero(fits)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query, places and exact products of the k best vectors of one shard; ``ids`` ascend."""
    lengths = np.sqrt((vectors**2).sum(axis=1))
    query_lengths = np.sqrt((queries**2).sum(axis=1))
    if lengths.max(initial=0) * query_lengths.max(initial=0) >= 2**42 or len(ids) >= PLACES:
        return _search_plainly(query_ids, queries, ids, vectors, k)
    order = np.argsort(-lengths, kind="stable")
    lowest = -np.iinfo(np.int64).max
    best = np.full((len(queries), k), lowest, dtype=np.int64)
    threshold = np.full(len(queries), -np.inf)
    unit = queries / np.maximum(query_lengths, 1e-300)[:, None]

    def take(who: np.ndarray, keys: np.ndarray) -> None:
        merged = np.concatenate([best[who], keys], axis=1)
        best[who] = -np.partition(-merged, k - 1, axis=1)[:, :k]
        least = best[who].min(axis=1)
        threshold[who] = np.where(least == lowest, -np.inf, least // PLACES)

    for start in range(0, len(order), BUCKET):
        places = order[start : start + BUCKET]
        bucket, own = vectors[places], lengths[places]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = threshold / (query_lengths * own[0])
        cosine = np.where(np.isnan(cosine), -np.inf, cosine)
        reach = (cosine <= 1 + _SLACK) | ~np.isfinite(threshold)
        high = reach & (cosine >= COORDINATE_COSINE)
        if high.any():
            directions = bucket / np.maximum(own, 1e-300)[:, None]
            for i in np.flatnonzero(high):
                at = _by_coordinates(unit[i], min(1.0, cosine[i]), directions)
                at = at[ids[places[at]] != query_ids[i]]
                if len(at):
                    take(np.array([i]), _keys(np.rint(bucket[at] @ queries[i]), places[at])[None, :])
        rest = np.flatnonzero(reach & ~high)
        if len(rest):
            # Sorted by length: vectors after the first that is too short for all these queries are left out.
            shortest = (threshold[rest] / np.maximum(query_lengths[rest], 1e-300)).min()
            upto = int(np.searchsorted(-own, -(shortest - _SLACK * abs(shortest)), side="right")) if np.isfinite(shortest) and shortest > 0 else len(own)
            if upto:
                keys = _keys(np.rint(queries[rest] @ bucket[:upto].T), places[None, :upto])
                keys[query_ids[rest][:, None] == ids[places[:upto]][None, :]] = lowest
                take(rest, keys)
    out = []
    for row in best:
        found = np.sort(row[row != lowest])[::-1]
        scores = found // PLACES
        out.append((PLACES - 1 - (found - scores * PLACES), scores))
    return out


def _search_plainly(query_ids, queries, ids, vectors, k):
    """The same for components so large that doubles would round: whole numbers of any size."""
    whole = [[int(x) for x in row] for row in vectors]
    out = []
    for own, query in zip(query_ids, queries):
        numbers = [int(x) for x in query]
        scored = sorted((-sum(a * b for a, b in zip(numbers, row)), i) for i, row in enumerate(whole) if ids[i] != own)[:k]
        out.append((np.array([i for _, i in scored], dtype=np.int64), np.array([-s for s, _ in scored], dtype=object)))
    return out


def exact_top_k(rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score over vectors turned into floor(scale * x)."""
    vectors = finite_vectors(rows, lambda x: F.floor(x.cast("double") * scale).cast("double"))

    def search(query_ids, queries, ids, matrix):
        return search_block(query_ids, queries, ids, matrix, k)

    return nearest(vectors, every, k, search, "bigint")
