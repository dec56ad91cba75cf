"""Maximal repeats and the removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from insightspark.llm import suffix_dedup
from insightspark.llm.suffixes import covered, joined, maximal_repeats


def repeated_bytes(strings, length):
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    masks = []
    for s in strings:
        mask = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                mask[i : i + length] = [True] * length
        masks.append(mask)
    return masks


def random_strings(rng):
    alphabet = rng.choice([b"a", b"ab", b"abc\0"])
    strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
    return strings + [s[rng.randint(0, 3) :] for s in strings if rng.random() < 0.3]


def test_maximal_repeats_have_all_occurrences_and_cover_what_repeats():
    rng = random.Random(1)
    for _ in range(400):
        length, strings = rng.choice([1, 2, 3, 5, 9, 20]), random_strings(rng)
        repeats, starts, left = maximal_repeats(strings, length)
        data = joined(strings)[0]
        mask = covered(repeats, len(data))
        for s, start, expected in zip(strings, starts, repeated_bytes(strings, length)):
            assert mask[start : start + len(s)].tolist() == expected
        for i, n in enumerate(repeats.length.tolist()):
            places = repeats.occurrences(i)
            text = data[places[0] : places[0] + n].tolist()
            everywhere = [p for p in range(len(data)) if left[p] >= n and data[p : p + n].tolist() == text]
            assert sorted(places.tolist()) == everywhere
            before = {int(data[p - 1]) if p not in starts else -1 - int(p) for p in places}
            after = {int(data[p + n]) if left[p] > n else -1 - int(p) for p in places}
            assert len(before) > 1 and len(after) > 1


def expected_rows(texts, length):
    raw = [(t or "").encode() for t in texts]
    out = []
    for b, mask in zip(raw, repeated_bytes(raw, length)):
        kept = bytes(x for x, m in zip(b, mask) if not m)
        spans = sum(m and not p for m, p in zip(mask, [False, *mask]))
        out.append((len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def documents():
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("ab cd efg hi jkl mno é ü".split()) for _ in range(n))
    passage, line = words(60), words(9)
    texts = [None, "", "short", "x" * 500, "x" * 30, "abab" * 60]
    texts += [words(30) + passage + words(30) for _ in range(12)]
    texts += [line + "\n" + words(20) + "\n" + line for _ in range(12)]
    texts += [texts[8]] * 5 + [texts[9][3:-4], texts[9] + "!", texts[10][:200] + "é" + texts[10][200:]]
    texts += [words(3000), passage * 3]
    return texts


@pytest.mark.parametrize("most", [1, 3, 6000])
def test_removal_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 2000)
    texts = documents()
    frame = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, kept_sha256 string, n_bytes int")
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame, 40, 16, most).collect()}
    for i, row in enumerate(expected_rows(texts, 40)):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == row


def test_repeated_rows_and_missing_ids(spark):
    text = "".join(map(str, range(200)))
    rows = [(1, text), (1, text), (None, text[:100]), (None, "other" * 3), (2, "z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame, 40, 16).collect()), key=repr)
    assert found == sorted([(1, 490, 490), (1, 490, 490), (None, 100, 100), (None, 15, 0), (2, 1, 0)], key=repr)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_anchors_are_counted_without_a_window(spark, monkeypatch):
    """A passage in every document: its anchors combine in each task before they are shuffled."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + passage for _ in range(300)]
    plans = []
    original = suffix_dedup.write_once

    def spied(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, purpose)

    monkeypatch.setattr(suffix_dedup, "write_once", spied)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame, 40, 16, 50).collect()}
    for i, row in enumerate(expected_rows(texts, 40)):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == row
    assert not any("Window" in plan for plan in plans)
    assert any("partial_sum" in plan for plan in plans)
