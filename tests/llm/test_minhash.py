"""Near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from insightspark.llm import minhash
from insightspark.llm.components import components
from insightspark.llm.shingles import shingle_sets, similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model_set(text, words=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(lowered)
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def model(rows, words=4):
    sets = [model_set(t, words) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return sorted((i, len(s), root(i), i == root(i)) for (i, _), s in zip(rows, sets))


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], ["", None, " \t\n", "one", "One two", "one two", "one two three four", "É é   x", "é é   x"]
    for _ in range(15):
        base = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("  ".join(copy).upper())
    texts += texts[9:14]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows


def test_shingle_sets_equal_the_model():
    texts = [t or "" for _, t in corpus()] + ["x" * 5000 + " y", "a b c", "a b", "a\x1cb c"]
    for text, found in zip(texts, shingle_sets(texts)):
        assert len(found) == len(model_set(text))
    first, second, third = shingle_sets(["a b c d e", "A\tB\nC  D e", "e d c b a"])
    assert first.tolist() == second.tolist() and first.tolist() != third.tolist()


@pytest.mark.parametrize("block", [3, 1024])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, component_id int, halves string")
    found = minhash.near_duplicates(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r) for r in found.collect()) == model(rows)


def test_missing_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "q r s t"), (None, ""), (4, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=repr) == sorted(
        [(None, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True), (4, 4, True)], key=repr
    )


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_common_counts_in_column_blocks(monkeypatch):
    monkeypatch.setattr(minhash, "_COLUMNS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 25)).astype(np.uint32) for _ in range(9)]
    found = minhash.common_counts(sets)
    for i in range(9):
        for j in range(9):
            if i != j:
                assert found[i, j] == len(set(sets[i]) & set(sets[j]))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 230)] + [(9, 9), (300, 250), (250, 275)]
    rng.shuffle(edges)
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 230)]} | {i: 250 for i in (250, 275, 300)}


def test_links_of_very_large_sets_are_not_lost():
    """Shortened numbers collide within large sets; a pair just above the threshold still passes, a far one does not."""
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 2**63, 160_000).astype(np.uint64)
    # Every second number agrees with its neighbour in the last 32 bits.
    shared[1::2] = (shared[::2] & np.uint64(0xFFFFFFFF)) | (shared[1::2] & np.uint64(0xFFFFFFFF00000000))
    more, other = rng.integers(0, 2**63, 40_000).astype(np.uint64), rng.integers(0, 2**63, 160_000).astype(np.uint64)
    sets = [np.unique(x) for x in (shared, np.concatenate([shared, more]), other)]
    assert similar(sets[0], sets[1], 80) and not similar(sets[0], sets[2], 80)
    short = [np.unique(s.astype(np.uint32)) for s in sets]
    assert len(short[0]) <= 80_000
    fits = minhash.may_be_similar(short, np.array([len(s) for s in sets]), 80)
    assert fits[0, 1] and not fits[0, 2]


def test_blocks_of_few_shingles_find_the_same_links(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(minhash, "SHINGLES", 300)
    assert sorted(map(tuple, minhash.near_duplicates(frame).collect())) == model(rows)
