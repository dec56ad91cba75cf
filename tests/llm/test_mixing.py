"""Targets and copies against plain models."""

import random

import pytest

from insightspark.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target int"


def model_targets(sizes):
    """Reshare by weight until no source is above its ceiling."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in order}
        full |= above


def documents(n, sources, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = int(rng.paretovariate(1.1) * 5)
        rows.append((i, " ".join(["w"] * words), rng.choice(sources), "clash", 1))
    return rows


def checked(spark, rows):
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert all(r.source_size == sizes[r.source] for r in found)
    expected = model_targets(sizes)
    for source, words in expected.items():
        assert target[source] == pytest.approx(words)
    return taken, expected


def test_mix_meets_its_targets(spark):
    taken, expected = checked(spark, documents(900, ["a", "b", "C", "é", None]))
    for source, words in expected.items():
        assert abs(taken[source] - words) <= max(0.01 * words, 6)


def test_one_source_holds_nearly_all(spark):
    taken, expected = checked(spark, documents(800, ["big"] * 40 + ["s", "t"]))
    assert all(abs(taken[s] - w) <= max(0.02 * w, 12) for s, w in expected.items())


def test_many_copies_of_one_size(spark):
    rows = [(i, "x y z", "a", None, None) for i in range(2000)] + [(5000 + i, "q " * 9, "b", None, None) for i in range(3000)]
    taken, expected = checked(spark, rows)
    assert all(abs(taken[s] - w) <= 9 for s, w in expected.items())


def test_reruns_agree_whatever_the_partitions(spark):
    frame = spark.createDataFrame(documents(400, ["a", "b", "c", "d"]), SCHEMA)
    first = sorted((r.doc_id, r.taken) for r in mixing.mix(frame.repartition(5)).collect())
    assert first == sorted((r.doc_id, r.taken) for r in mixing.mix(frame.repartition(2, "source")).collect())


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "one\x1ctwo three", "a", None, None), (2, " \t ", "b", None, None)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.size, r.target) for r in found) == [(0, 0.0), (0, 0.0), (0, 0.0), (2, 3.0)]


def test_empty_texts_only_and_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([(1, "", "a", None, None)], SCHEMA)).first().taken == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(("long", "times"), [(300_000, 1), (100_000, 3)])
def test_small_documents_close_the_gap_of_long_ones(spark, long, times):
    rng = random.Random(3)
    sizes = [rng.randint(50, 400) for _ in range(3000)] + [long] * times
    total, n = sum(sizes), {x: sizes.count(x) for x in set(sizes)}
    shares = {"a": 0.9, "b": 1.1, "c": 1.5, "d": 0.3}
    counts = spark.createDataFrame([(s, x, k) for s in shares for x, k in n.items()], "source_key string, size bigint, n bigint")
    rows = [(s, total, len(sizes), share * total, 2.0 * total) for s, share in shares.items()]
    targets = spark.createDataFrame(rows, "source_key string, source_size bigint, n_docs bigint, target double, most double")
    plan = mixing.copies_by_size(counts, targets).collect()
    assert len(plan) == 4 * len(n) and all(0 <= r.copies <= 2 * r.n for r in plan)
    for source, share in shares.items():
        assert abs(sum(r.copies * r.size for r in plan if r.source_key == source) - share * total) < 50
