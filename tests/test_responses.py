"""Prompts, fences, JSON answers, questions."""

import json

import pytest
from pyspark.sql import functions as F

from insightspark.functions.text import bullet_list, fill_template, strip_fences, strip_report_fence
from insightspark.operators import questions, responses
from insightspark.operators.prompts import NO_FINDINGS, prompt_table, with_bullets


def one(spark, schema, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {schema}")


def test_template_slots_are_filled_once(spark):
    df = spark.createDataFrame([("{b} and {a}", None, 7)], "a string, b string, n int")
    filled = df.select(fill_template("{a}|{b}|{n}|{{a}}|%s", {"a": F.col("a"), "b": F.col("b"), "n": F.col("n")})).first()[0]
    assert filled == "{b} and {a}||7|{a}|%s"
    assert df.select(fill_template("", {})).first()[0] == ""
    with pytest.raises(KeyError):
        fill_template("{missing}", {})


def test_bullets(spark):
    df = one(spark, "items array<string>", ["a", None, "b"], [], None)
    assert [r[0] for r in df.orderBy("id").select(bullet_list(F.col("items"))).collect()] == ["- a\n- \n- b", "None available.", "None available."]
    assert with_bullets(df.where("id = 1"), "items", "t", NO_FINDINGS).first().t == "No internal findings yet."


def test_prompt_per_run(spark):
    runs = spark.createDataFrame([(1, "q", ["f"])], "run_id int, question string, findings array<string>")
    prompt = prompt_table(runs, "Q: {q}\n{f}", {"q": "question", "f": bullet_list(F.col("findings"))}).first().prompt
    assert prompt == "Q: q\n- f"


FENCED = ["plain", "```json\n{}\n```", "  ```\n[1]\n``` tail", "```jsonx```", "```", "``` a ``` b ```", " ```json {} ```", "no ``` start"]


def model_fence(raw):
    raw = raw.strip()
    if raw.startswith("```"):
        raw = raw.split("```")[1]
        if raw.startswith("json"):
            raw = raw[4:]
    return raw.strip()


def test_fences(spark):
    df = one(spark, "raw string", *FENCED)
    for row in df.select("raw", strip_fences(F.col("raw")).alias("body")).collect():
        assert row.body == model_fence(row.raw)


def test_report_fences(spark):
    for raw in ["# T\nx", "```markdown\n# T\nx\n```", "```", "```\n```", "```a\nb", " ```\n\n x \n```\n"]:
        lines = raw.strip()
        model = "\n".join(lines.split("\n")[1:-1]).strip() if lines.startswith("```") else lines
        assert one(spark, "raw string", raw).select(strip_report_fence(F.col("raw"))).first()[0] == model


def parsed(spark, *answers):
    raw = [a if isinstance(a, str) else json.dumps(a) for a in answers]
    return responses.parse_responses(one(spark, "raw string", *raw))


def test_parsing_splits_answers_and_errors(spark):
    table = parsed(spark, {"a": 1}, "```json\n{}\n```", "oops", "[1]", "NaN", '"x"', "")
    assert [r.error for r in table.orderBy("id").collect()] == [
        None, None, "Invalid JSON", "Expected a JSON object, found array", "Invalid JSON", "Expected a JSON object, found string", "Invalid JSON",
    ]
    assert sorted(r.id for r in responses.valid_responses(table).collect()) == [0, 1]
    assert sorted(r.id for r in responses.failed_responses(table).collect()) == [2, 3, 4, 5, 6]


def test_an_answer_is_parsed_once_whatever_follows(spark):
    valid = responses.valid_responses(parsed(spark, {"a": 1}))
    plan = responses.with_recommendations(valid)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 1


def test_field_defaults(spark):
    table = parsed(spark, {}, {"findings": ["a", 1], "summary": "s"}, {"findings": None, "summary": None}, {"findings": "no list"})
    found = responses.response_fields(table, responses.ANALYST_FIELDS).orderBy("id").collect()
    assert [(r.findings, r.summary, r.anomalies) for r in found] == [([], "", []), (["a", "1"], "s", []), (None, None, []), (None, "", [])]


def test_recommendations(spark):
    items = [{"rank": 4, "action": "A", "rationale": "R", "priority": "high", "timeframe": "immediate"}, {"action": "B", "rationale": None}, {"rank": "2", "priority": None}]
    table = responses.with_recommendations(parsed(spark, {"recommendations": items}, {}, {"recommendations": []}))
    found = responses.recommendation_rows(table.drop("raw", "error")).orderBy("id", "position").collect()
    assert [tuple(r) for r in found] == [
        (0, 1, 4, "A", "R", "high", "immediate"), (0, 2, 2, "B", None, "medium", "short_term"), (0, 3, 2, "", "", None, "short_term"),
    ]
    assert [len(r.recommendations) for r in table.orderBy("id").collect()] == [3, 0, 0]


CLAMPED = [
    (82, 82), (150, 100), (-10, 0), (50, 50), (-5, 0), (None, 0), ("bad", 0), ("85", 85), ("85.5", 0), (85.9, 85), (True, 1),
    (False, 0), ([1], 0), ({}, 0), (1e300, 100), (" +7 ", 7), ("1_0", 10), (-0.5, 0), (99.99, 99), ("", 0), (10**30, 100),
]


def test_confidence(spark):
    table = parsed(spark, *[{"confidence_score": v} for v, _ in CLAMPED], {})
    found = [r[0] for r in table.orderBy("id").select(responses.confidence(F.col("response"))).collect()]
    assert found == [expected for _, expected in CLAMPED] + [50]


def test_question_lists(spark):
    answers = [
        '["a", "", null, "b", 0, 7, true, false, [], {}, "c", "d"]', "```json\n[\"x\"]\n```", "[]", '{"q": 1}', "nope", None,
    ]
    found = responses.valid_questions(one(spark, "raw string", *answers)).orderBy("id").collect()
    assert [r.questions for r in found] == [["a", "b", "7", "True", "c"], ["x"], [], None, None, None]


def model_suggestions(columns):
    picked = []
    for needed, how, question in questions.RULES:
        if (all if how == "all" else any)(c in columns for c in needed):
            picked.append(question)
    return (picked + questions.GENERIC)[:5]


TABLES = {
    "sales": ["total_revenue", "year", "region", "build_category", "customer_age_bracket", "event_influence"],
    "half": ["total_revenue", "vehicle_platform"],
    "none": ["x", "y"],
    "year_only": ["year"],
}


def test_suggestions(spark):
    catalogue = spark.createDataFrame([(t, c) for t, cs in TABLES.items() for c in cs], "table_name string, column_name string")
    found = dict(map(tuple, questions.suggested_questions(catalogue).collect()))
    assert found == {t: model_suggestions(cs) for t, cs in TABLES.items()}
    for table, columns in TABLES.items():
        assert questions.suggested_for(spark.createDataFrame([tuple(range(len(columns)))], columns)) == found[table]
    assert len(found["sales"]) == 5 and found["none"] == questions.GENERIC


def test_failed_answers_fall_back(spark):
    answered = spark.createDataFrame([("half", ["a"]), ("half", None), ("unknown", None), ("half", [])], "table_name string, questions array<string>")
    catalogue = spark.createDataFrame([("half", "region")], "table_name string, column_name string")
    filled = questions.questions_or_fallback(answered, questions.suggested_questions(catalogue))
    found = sorted((r.table_name, r.questions[:1]) for r in filled.collect())
    assert found == [("half", []), ("half", [questions.RULES[1][2]]), ("half", ["a"]), ("unknown", questions.GENERIC[:1])]
    assert questions.question_rows(filled).where("table_name = 'unknown'").count() == 5
