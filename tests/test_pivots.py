"""Exact search that skips regions: bounds, whole results, and how much meets."""

import numpy as np
import pytest

from insightspark.operators import pivots, vectors
from insightspark.operators.pivots import NO_DIRECTION, Regions, directions, first_regions, placed, wanted_regions


def clustered(rng, n, dim=8, centres=12, spread=0.05):
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))


def regions_of(data, pivot_rows, rings):
    unit, kind = directions(data[pivot_rows])
    chosen = np.unique(unit[kind == 0], axis=0)
    cell, angle = placed(data, chosen)
    ring = np.where(cell >= 0, np.minimum((angle / np.pi * 40).astype(int), rings - 1), 0)
    region = cell * rings + ring
    numbers = np.unique(region)
    rows = [np.flatnonzero(region == r) for r in numbers]
    return region, Regions(
        chosen, numbers, np.array([cell[i[0]] for i in rows]), np.array([angle[i].min() for i in rows]),
        np.array([angle[i].max() for i in rows]), np.array([len(i) for i in rows]),
    )


@pytest.mark.parametrize("seed", range(6))
def test_no_vector_lies_nearer_than_its_region_allows(seed):
    rng = np.random.default_rng(seed)
    data = clustered(rng, 400) if seed % 2 else rng.normal(size=(400, 3 + seed))
    data[::50], data[1] = data[7], 0.0
    region, regions = regions_of(data, np.arange(0, 400, 23), rings=4)
    queries = np.concatenate([data[:40], rng.normal(size=(20, data.shape[1]))])
    unit, query_unit = directions(data)[0], directions(queries)[0]
    bound, _ = pivots._least_angles(query_unit, regions)
    at = np.searchsorted(regions.region, region)
    assert (np.arccos(np.clip(query_unit @ unit.T, -1, 1)) >= bound[:, at] - 1e-12)[directions(queries)[1] == 0].all()
    assert bound.max() > 0.1


def test_regions_that_can_hold_a_neighbour_are_wanted():
    rng = np.random.default_rng(8)
    data = clustered(rng, 500)
    data[3] = 0.0
    region, regions = regions_of(data, np.arange(0, 500, 31), rings=3)
    unit = directions(data)[0]
    queries = np.concatenate([data[:50], np.zeros((1, 8))])
    scores = directions(queries)[0] @ unit.T
    k = 5
    bars = np.partition(scores, -k, axis=1)[:, -k]
    query, place = wanted_regions(queries, bars, regions)
    wanted = set(zip(query.tolist(), regions.region[place].tolist()))
    for q in range(50):
        assert all((q, r) in wanted or q == 3 for r in region[scores[q] >= bars[q]].tolist())
    for q in (3, 50):  # no direction, so no bar: everything
        assert {(q, r) for r in regions.region.tolist()} <= wanted
    none = wanted_regions(queries[:2], np.array([-np.inf, bars[1]]), regions)
    assert (none[0] == 0).sum() == len(regions.region)
    assert NO_DIRECTION not in regions.cell[none[1][none[0] == 1]]
    query, place = first_regions(queries, regions, k)
    for q in range(51):
        assert regions.rows[place[query == q]].sum() >= k


def brute_force(data, asked, k):
    data, asked = data.astype(np.float32).astype(float), asked.astype(np.float32).astype(float)
    found = []
    for q, vector in enumerate(asked):
        dots = sum(data[:, i] * vector[i] for i in range(data.shape[1]))
        length = np.sqrt(sum(data[:, i] ** 2 for i in range(data.shape[1]))) * np.sqrt(sum(x * x for x in vector))
        scores = [None if not n else round(float(d / n), 9) for d, n in zip(dots, length)]
        order = sorted(range(len(data)), key=lambda i: (scores[i] is None, -(scores[i] or 0.0), i))
        found += [(q, rank, i, scores[i]) for rank, i in enumerate(order[:k], 1)]
    return sorted(found)


def as_tables(spark, data, asked):
    def table(name, rows):
        return spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], f"{name} bigint, embedding array<float>")

    return table("chunk_id", data).repartition(6), table("query_id", asked)


def result(top):
    return sorted((r.query_id, r["rank"], r.chunk_id, None if r.score is None else round(r.score, 9)) for r in top.collect())


@pytest.mark.parametrize("case", ["clusters", "one hot copy", "no direction", "fewer than k", "zero queries"])
def test_skipping_equals_brute_force(spark, monkeypatch, case):
    rng = np.random.default_rng(3)
    data = clustered(rng, 900)
    asked = data[::20] + 0.01
    if case == "one hot copy":
        data[rng.random(900) < 0.4] = data[11]
        asked[:5] = data[11] * 3
    if case == "no direction":
        data[:] = 0.0
    if case == "fewer than k":
        data[4:] = 0.0
    if case == "zero queries":
        asked[::2] = 0.0
    met = []
    original = vectors._meetings
    monkeypatch.setattr(vectors, "_meetings", lambda *a: met.append(original(*a)) or met[-1])
    monkeypatch.setattr(vectors, "SHARD_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vectors, "MOST_PIVOTS", 12)
    assert result(vectors.cosine_topk(*as_tables(spark, data, asked), k=6)) == brute_force(data, asked, 6)
    pairs = sum(parts * blocks for dealt in met for _, parts, blocks in dealt)
    every = -(-len(data) // 40) * -(-len(asked) // 8)
    if case == "clusters":
        assert pairs < every * 0.6


def test_few_queries_leave_the_chunks_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = clustered(rng, 300)
    data[5], data[17] = 0.0, data[16]
    asked = data[::30]
    plans = []
    original = vectors.write_once
    monkeypatch.setattr(vectors, "write_once", lambda df, purpose: plans.append(df._jdf.queryExecution().executedPlan().toString()) or original(df, purpose))
    assert result(vectors.cosine_topk(*as_tables(spark, data, asked), k=4)) == brute_force(data, asked, 4)
    ranked = plans[-1]
    # The test's own repartition, and the shuffle of k rows per query and task.
    assert ranked.count("Exchange ") == 2 and "WindowGroupLimit" in ranked and "FlatMapGroups" not in ranked


def test_wide_queries_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = clustered(rng, 60)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 100)
    monkeypatch.setattr(vectors, "_scan_with_queries", None)
    assert result(vectors.cosine_topk(*as_tables(spark, data, data[:9]), k=3)) == brute_force(data, data[:9], 3)
