"""The filter audit against a walk through every order, and its defined cases."""

import re
from collections import Counter
from itertools import permutations

import pytest

from insightspark.llm import filter_audit

GOOD = " ".join(f"word{i}" for i in range(120))
TEXTS = [GOOD, GOOD + " $", GOOD.upper(), "short", "short", "SHORT #1 SHORT", "", None, "a b " * 80, "A B " * 80, "x " * 120 + "&", "\t \n", "É" * 10]
SCHEMA = "doc_id bigint, text string, lang string, n bigint, part string, mask int"
NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and first[text] < doc_id,
        }
        yield doc_id, lang or "", {x for x in bad if bad[x]}


def walked(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    found = list(fails(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in found}:
        for order in map("".join, permutations("ABCDE")):
            alive = [(d, f) for d, p, f in found if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [x for x in alive if letter in x[1]]
                redundant = sum(letter in f for _, f in gone)
                alive = [x for x in alive if letter not in x[1]]
                gone += removed
                only = sum(f == {letter} for _, p, f in found if p == part)
                shapley[part, letter] += len(removed)
                out[part, order, step] = (
                    len(alive), len(removed), redundant, only,
                    sum(d in good for d, _ in removed if d is not None), sum(d in toxic for d, _ in removed if d is not None),
                )
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def check(spark, rows, labels):
    documents = spark.createDataFrame([(d, t, lang, 1, "x", 2) for d, t, lang in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(documents, marks)
    assert found.columns == NAMES
    assert sorted(map(tuple, found.collect())) == walked(rows, labels)


def test_every_order_by_hand(spark):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(TEXTS + TEXTS)]
    rows += [(None, "short", "en"), (None, "short", "en"), (3, "short", ""), (3, "another text", "en"), (3, "short", "en"), (50, GOOD, "fr")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, None), (3, 1, 1), (4, None, 1), (None, 1, 1), (50, 1, 0), (999, 1, 1)]
    check(spark, rows, labels)


def test_many_copies_and_one_part(spark):
    check(spark, [(i % 40, ["copy", GOOD][i % 2], "en") for i in range(200)], [(i, i % 2, int(i % 4 == 0)) for i in range(0, 40, 3)])


def test_no_documents_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    check(spark, [(1, None, None)], [])


def test_a_very_long_text(spark):
    check(spark, [(1, "long words " * 200_000, "en"), (2, "a" * 3_000_000, "en")], [(1, 1, 1)])


@pytest.mark.parametrize("size", [1, 5])
def test_outcomes_have_a_row_per_prefix_and_mask(spark, size):
    cells = spark.createDataFrame([(m,) for m in range(size)], "mask int")
    seen = filter_audit.outcomes(cells)
    assert seen.count() == (5 + 20 + 60 + 120 + 120) * size
    assert seen.select("prefix").distinct().count() == 325
