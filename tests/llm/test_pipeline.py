"""The pipeline, stage by stage, against the operators' plain models."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from insightspark.llm import quality
from insightspark.session import write_once

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(os.path.join(FOLDER, "documents.parquet"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(write_once(stage(spark, out[-1], FOLDER), "stage"))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_registration():
    assert driver.queries()["pipeline"] is corpus_pipeline.run
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" not in driver.oracle_sql()


def test_columns_stay(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_quality_rejects_what_it_predicts(spark, stages):
    labels = spark.read.parquet(os.path.join(FOLDER, "labels.parquet"))
    trees = quality.fit_quality(stages[0], labels)
    expected = {r.doc_id for r in quality.score_quality(stages[0], trees).filter("score >= 0.3").collect()}
    assert set(texts(stages[1])) == expected and 0 < len(expected) < stages[0].count()


def test_one_of_each_group_stays(stages):
    from test_minhash import model

    rows = sorted(texts(stages[1]).items())
    assert set(texts(stages[2])) == {i for i, _, _, kept in model(rows, 5) if kept}


A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


@pytest.mark.parametrize("rows, expected", [
    ([(1, A), (1, B), (2, B)], [A, B]),
    ([(1, A), (1, B), (2, C)], [A, B, C]),
    ([(1, A), (2, A + " x"), (2, B), (2, B)], [A, B]),
    ([(None, A), (None, A), (None, A + " x"), (None, B), (3, B)], [A, B]),
    ([(1, ""), (1, None), (2, ""), (None, A)], ["", "", A]),
])
def test_near_deduplication_loses_no_text(spark, rows, expected):
    """Whatever ids texts share, each group of near copies keeps one; empty texts stay, one per id."""
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_deduplicate(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    found = sorted(r.text or "" for r in kept.collect())
    assert [t.removesuffix(" x") for t in found] == expected


def test_five_words_count(spark):
    """25 single edits in 1000 words are a copy by four words and none by five."""
    words = [f"w{i}" for i in range(1000)]
    edited = [f"e{i}" if i % 40 == 20 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, " ".join(edited), "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.near_deduplicate(spark, docs, FOLDER).count() == 2


def test_repeats_go(stages):
    from test_suffix_dedup import repeated_bytes

    before, after = texts(stages[2]), texts(stages[3])
    ids = sorted(before)
    raw = [(before[i] or "").encode() for i in ids]
    for i, b, mask in zip(ids, raw, repeated_bytes(raw, 200)):
        assert after[i] == bytes(x for x, m in zip(b, mask) if not m).decode("utf-8", "ignore")
    assert stages[3].filter(F.col("n_chars") != F.length("text")).isEmpty()


def test_the_mix_takes_whole_copies(spark, stages):
    from insightspark.llm import mixing

    taken = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect() if r.copies}
    counts = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert counts == taken and set(counts.values()) <= {1, 2}


def test_all_that_is_left_is_packed(stages):
    packed = stages[5]
    ends = packed.filter("start + length = doc_tokens").groupBy("doc_id").count()
    assert {tuple(r) for r in ends.collect()} == {tuple(r) for r in stages[4].groupBy("doc_id").count().collect()}
    longest = packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0]
    assert longest <= 1024


def test_odd_documents(spark):
    rows = [
        (1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (None, "some words here", "en", "a", 15, "y"),
        (2, "", "en", None, 0, "z"), (3, "word " * 30_000, "en", "a", 150_000, "z"), (3, "word " * 30_000, "en", "a", 150_000, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = write_once(stage(spark, frame, FOLDER), "odd")
            assert frame.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).collect()
