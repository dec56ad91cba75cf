"""Exact and approximate search against brute force."""

import math

import numpy as np
import pytest

from insightspark.llm import ann, topk, vector_shards

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], SCHEMA)


def brute(rows, every, k, turn):
    fit = [
        (i, np.array([turn(x) for x in v])) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {i: v for i, v in sorted(fit, key=lambda r: (r[0], list(r[1])), reverse=True) if i % every == 0}.items():
        scored = sorted((-float((a * b).sum()), i) for i, b in fit if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def hostile():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # copies tie
    rows += [(5, rows[7][1]), (50, rows[9][1])]  # repeated ids
    rows += [(300, None), (350, [None] * 6), (400, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(500, [0.0] * 6), (550, [1.0, 2.0]), (551, [3.0, 4.0]), (600, []), (650, [1e30, 1.0, 0.0, 0.0, 0.0, 0.0]), (651, [100.0] * 6)]
    return rows


def test_exact_top_k_equals_brute_force(spark, rows):
    data = [r for r in hostile() if r[0] not in (650,)]
    found = topk.exact_top_k(frame(spark, data)).select("query_id", "rank", "vec_id", "score")
    expected = brute(data, 50, 5, lambda x: math.floor(256 * x))
    assert sorted(tuple(r) for r in found.collect()) == [(q, n, i, int(s)) for q, n, i, s in expected]


def test_exact_top_k_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_shards, "SHARD", 20)
    monkeypatch.setattr(vector_shards, "BLOCK", 2)
    data = [r for r in hostile() if r[0] not in (650,)]
    found = topk.exact_top_k(frame(spark, data))
    expected = brute(data, 50, 5, lambda x: math.floor(256 * x))
    assert sorted(tuple(r) for r in found.collect()) == [(q, n, i, int(s)) for q, n, i, s in expected]


@pytest.mark.parametrize("sign", [1, -1])
def test_block_search_keeps_what_lies_nearer_to_the_axis(sign):
    turned = 100 * np.array([[0.8, 0.6], [0.8, -0.6]])
    vectors = np.concatenate([np.repeat(turned, 600, axis=0) * 256, [[95 * 256, 0]], np.repeat(turned, 200, axis=0) * 250])
    vectors = np.rint(sign * vectors)
    ids = np.arange(len(vectors))
    queries = np.array([[256.0 * sign, 0.0]])
    ((places, scores),) = topk.search_block(np.array([-1]), queries, ids, vectors, 5)
    ((best, products),) = topk._search_plainly(np.array([-1]), queries, ids, vectors, 5)
    assert places[0] == 1200 and places.tolist() == best.tolist() and scores.tolist() == products.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_block_search_around_one_axis(seed):
    rng = np.random.default_rng(seed)
    axis = np.array([[3.0, 0.5, 0.2, 0.1]]) * (-1) ** seed
    vectors = np.floor(256 * (axis + rng.normal(size=(5000, 4)) * rng.choice([0.05, 0.5, 1.5], size=(5000, 1))))
    ids, queries = np.arange(5000), np.floor(256 * np.concatenate([axis, vectors[:9] / 256]))
    own = np.arange(10) - 1
    found = topk.search_block(own, queries, ids, vectors, 5)
    for (places, scores), (best, products) in zip(found, topk._search_plainly(own, queries, ids, vectors, 5)):
        assert places.tolist() == best.tolist() and scores.tolist() == products.tolist()


@pytest.mark.parametrize("spread", [0.0, 0.5, 3.0])
def test_block_search_prunes_without_loss(spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16))
    vectors = np.floor(256 * (centres[rng.integers(5, size=3000)] + 0.05 * rng.normal(size=(3000, 16))) * np.exp(spread * rng.normal(size=(3000, 1))))
    ids = np.arange(3000)
    found = topk.search_block(ids[::50], vectors[::50], ids, vectors, 5)
    for i, (places, scores) in zip(ids[::50], found):
        products = vectors @ vectors[i]
        products[i] = -np.inf
        best = np.lexsort((ids, -products))[:5]
        assert places.tolist() == best.tolist() and scores.tolist() == products[best].tolist()


def test_products_beyond_doubles_stay_exact():
    vectors = np.array([[2.0**30, 1.0], [2.0**30, 0.0], [2.0**30, 2.0], [-1.0, 0.0]])
    ids = np.arange(4)
    ((places, scores),) = topk.search_block(ids[:1], vectors[:1], ids, vectors, 2)
    assert places.tolist() == [2, 1] and scores.tolist() == [2**60 + 2, 2**60]


def test_neighbours_of_few_rows_are_all_rows(spark):
    data = [r for r in hostile() if r[0] not in (650,) and r[1] != [0.0] * 6 and r[1] != []]
    found = ann.nearest_neighbours(frame(spark, data), k=400)
    expected = brute(data, 20, 400, float)
    got = sorted(tuple(r) for r in found.collect())
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in got], [r[3] for r in expected], rtol=1e-14, atol=0)


def test_zero_vectors_take_no_part(spark):
    found = ann.nearest_neighbours(frame(spark, [(0, [0.0, 0.0]), (20, [1.0, 0.0]), (21, [0.0, 0.0])]))
    assert found.collect() == []


@pytest.mark.parametrize("function", [topk.exact_top_k, ann.nearest_neighbours])
def test_empty_table(spark, function):
    assert function(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    expected = {r[:3:2] for r in brute(rows, 20, 20, float)}
    found = {(r.query_id, r.vec_id) for r in ann.nearest_neighbours(table).collect()}
    assert len(found & expected) >= 0.9 * len(expected)


def test_the_stopping_test_stops_early():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 8))
    vectors = np.repeat(centres, 50, axis=0) + 0.01 * rng.normal(size=(10_000, 8))
    ids, seen = np.arange(10_000), []
    whole, ann_leaves = ann.kd_leaves, []
    try:
        ann.kd_leaves = lambda points: ann_leaves.append(whole(points)) or ann_leaves[-1]
        rint = np.rint
        np.rint = lambda x: seen.append(x.size) or rint(x)
        found = ann.search_block(ids[::500], vectors[::500], ids, vectors, 20)
    finally:
        ann.kd_leaves, np.rint = whole, rint
    assert sorted(np.concatenate(ann_leaves[0])) == ids.tolist()
    assert sum(seen) < 0.5 * 20 * len(ids)
    hits = 0
    for i, (places, _) in zip(ids[::500], found):
        products = vectors @ vectors[i]
        products[i] = -np.inf
        hits += len(set(places) & set(np.argsort(-products)[:20]))
    assert hits >= 0.9 * 20 * len(found)
