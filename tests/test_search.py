"""Search queries, result normalising, merging, blocks and fallback."""

import json

import pytest
from pyspark.sql import functions as F

from insightspark.operators import search

QUESTION = "Is the Baja segment growing fast enough, or is it still a niche?"


def model_keywords(text):
    words = text.lower().replace("?", "").replace(",", "").split()
    return " ".join([w for w in words if w not in search.STOP_WORDS and len(w) > 2][:8])


TEXTS = [QUESTION, "", "   ", "a an the", "one two\tthree four five six seven eight nine ten", "ÉCOLE, Été? x\u0085yyy", "dont,know?what" * 3]


def test_keywords(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in df.select("t", search.keywords(F.col("t")).alias("k")).collect():
        assert row.k == model_keywords(row.t)


def model_queries(question, findings):
    queries = [(question or "").strip()[:120]]
    second = model_keywords(question or "")
    if second and second != queries[0]:
        queries.append(second)
    for finding in (findings or [])[:3]:
        if any(a in finding.lower() for a in search.ANCHORS):
            third = model_keywords(finding)
            if third and third not in queries:
                queries.append(third)
                break
    return queries


CASES = [
    (QUESTION, ["Growth is up", "Region south leads sales"]),
    (QUESTION, ["nothing here", "none", "still none", "growth beyond the third"]),
    ("short", ["short growth", "Region of the"]),
    ("growth", ["Growth", "the region"]),
    ("x" * 200, None),
    (None, []),
    ("  padded question  ", ["Baja, baja? BAJA", "the growth of it"]),
    ("growth region", ["Growth region", "region growth"]),
]


def test_queries(spark):
    df = spark.createDataFrame([(i, q, f) for i, (q, f) in enumerate(CASES)], "id int, question string, findings array<string>")
    found = {}
    for row in search.search_queries(df).orderBy("id", "query_idx").collect():
        found.setdefault(row.id, []).append(row.query)
    assert found == {i: model_queries(q, f) for i, (q, f) in enumerate(CASES)}


ANSWERS = [
    ([{"title": "T", "content": "C", "url": "u"}, {"title": "S", "snippet": "s", "link": "l"}], [("T", "C", "u"), ("S", "s", "l")]),
    (["text", 5, None, ["x"], {"url": "only"}], [("", "text", ""), ("", "", "only")]),
    ([{"content": None, "snippet": "s", "url": None, "link": "l", "title": None}], [(None, None, None)]),
    ([], []),
    ("bare string", [("", "bare string", "")]),
]


@pytest.mark.parametrize("answer, expected", ANSWERS)
def test_normalise(spark, answer, expected):
    df = spark.createDataFrame([(1, json.dumps(answer))], "id int, raw string")
    found = search.normalise_results(df).orderBy("result_idx").collect()
    assert [(r.title, r.content, r.url) for r in found] == expected
    assert [r.result_idx for r in found] == list(range(len(expected)))


def test_answers_that_are_no_list(spark):
    df = spark.createDataFrame([(1, "plain text, no JSON"), (2, '{"a": 1}'), (3, None)], "id int, raw string")
    assert [(r.id, r.content) for r in search.normalise_results(df).orderBy("id").collect()] == [(1, "plain text, no JSON"), (2, '{"a": 1}')]


RESULTS = "run_id int, query_idx int, result_idx int, title string, content string, url string"


def test_merge_keeps_the_first_of_each_url_and_every_blank_one(spark):
    found = [
        (1, 1, 0, "later", "", "u"), (1, 0, 3, "first", "", "u"), (1, 0, 0, "a", "", ""), (1, 0, 1, "b", "", ""),
        (1, 2, 0, "c", "", None), (2, 5, 5, "other run", "", "u"),
    ]
    merged = search.merge_results(spark.createDataFrame(found, RESULTS))
    assert sorted(r.title for r in merged.collect()) == ["a", "b", "c", "first", "other run"]


def test_a_url_that_fills_the_table_shrinks_before_the_shuffle(spark):
    number = F.col("id")
    found = spark.range(0, 30_000, 1, 8).select(
        (number % 2).cast("int").alias("run_id"), number.cast("int").alias("query_idx"), F.lit(0).alias("result_idx"),
        F.lit("t").alias("title"), F.lit("c").alias("content"), F.when(number % 3 == 0, "hot").otherwise(number.cast("string")).alias("url"),
    )
    merged = search.merge_results(found)
    assert merged.count() == 20_000 + 2
    assert sorted(r.query_idx for r in merged.where("url = 'hot'").collect()) == [0, 3]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Partial")


def test_blocks(spark):
    found = [(1, 0, i, f"T{i}" if i else "", "x" * 700, f"u{i}") for i in range(10)]
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    blocks = dict(map(tuple, search.result_blocks(spark.createDataFrame(found, RESULTS), runs).collect()))
    expected = "\n\n".join(f"[Result {i + 1}]{f' — T{i}' if i else ''}\n{'x' * 600}\nu{i}" for i in range(8))
    assert blocks == {1: expected, 2: "No search results available."}


def test_fallback(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "primary", True, False), (1, 1, "primary", False, False), (1, 1, "fallback", True, False),
            (2, 0, "primary", True, False), (2, 1, "primary", False, False), (2, 1, "fallback", False, False),
            (3, 0, "primary", False, True), (3, 0, "fallback", True, False),
            (4, 0, "primary", False, None),
        ],
        "run_id int, query_idx int, provider string, ok boolean, own_error boolean",
    )
    primary = spark.createDataFrame([(r, q, 0, "p", "", "") for r in (1, 2, 3) for q in (0, 1)], RESULTS)
    fallback = spark.createDataFrame([(r, q, 0, "f", "", "") for r in (1, 2, 3) for q in (0, 1)], RESULTS)
    merged = search.fallback_merge(primary, fallback, calls).collect()
    assert sorted((r.run_id, r.query_idx, r.title) for r in merged) == [(1, 0, "p"), (1, 1, "f")]
    assert sorted(map(tuple, search.failed_runs(calls).collect())) == [(2, 1), (3, 1), (4, 1)]
