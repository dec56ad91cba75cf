"""Trees against a plain walk, held-out accuracy, and odd inputs."""

import zlib

import numpy as np
import pytest

from insightspark.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 5))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 2] < -0.2)).astype(float)
    trees = quality.fit_trees(rows, labels, trees=20, depth=3)
    scores = trees.score(rows)
    for row, score in zip(rows[:40], scores):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((scores > 0.5) == labels).mean() > 0.95


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    trees = quality.fit_quality(documents, labels)
    rows = quality.score_quality(documents.select("doc_id", "text"), trees).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 40 and sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_change_nothing(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = quality.fit_quality(documents, labels), quality.fit_quality(documents, flipped)
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.leaf, b.leaf)


def test_odd_rows(spark):
    rows = [(1, "good text. " * 20, 0.5), (1, "good text. " * 20, 0.5), (2, None, 1.0), (3, "", None), (None, "x", 2.0), (4, "a" * 100_000, 0.0)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 1)], "doc_id bigint, quality int")
    found = quality.score_quality(documents, quality.fit_quality(documents, labels))
    assert sorted(found.columns) == ["doc_id", "held_out", "predicted", "score", "text"]
    assert len(found.collect()) == len(rows) and all(0 <= r.score <= 1 for r in found.collect())


def test_without_labels_and_without_rows(spark):
    documents = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    trees = quality.fit_quality(documents, none)
    assert quality.score_quality(documents, trees).first().score == 0.5
    assert quality.score_quality(documents.limit(0), trees).collect() == []


def test_the_sample_is_bounded(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    trees = quality.fit_quality(documents, labels, sample=50)
    assert trees.feature.shape[0]
