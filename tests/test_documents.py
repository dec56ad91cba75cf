"""Chunking, corpus, embedding and exact nearest neighbours."""

import datetime
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from insightspark.errors import DocumentIngestionError
from insightspark.operators import chunking, vectors

PIECES = st.sampled_from(["a", "bb", " ", "  ", "\n", "\n\n", ". ", ".", "wordword", "　", "é"])
TEXTS = st.lists(PIECES, max_size=120).map("".join)


def model_chunks(text, size, overlap, separators=("\n\n", "\n", ". ", " ", "")):
    """The splitting rule written over lists of strings."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), None)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        parts = re.split(f"({re.escape(separator)})", text)
        pieces = [parts[0]] + ["".join(parts[i : i + 2]) for i in range(1, len(parts), 2)]
    else:
        pieces = list(text)
    chunks, short = [], []

    def merge():
        held = []
        for piece in short:
            if held and sum(map(len, held)) + len(piece) > size:
                chunks.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                    held.pop(0)
            held.append(piece)
        chunks.append("".join(held))
        short.clear()

    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
        else:
            merge()
            chunks.extend(model_chunks(piece, size, overlap, finer) if finer else [piece])
    merge()
    return [c.strip() for c in chunks if c.strip()]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([(5, 0), (10, 3), (20, 4), (50, 10)]))
def test_chunks_follow_the_rule(text, limits):
    size, overlap = limits
    chunks = chunking.split_text(text, size, overlap)
    assert chunks == model_chunks(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    if len(text) < size:
        assert chunks == ([text.strip()] if text.strip() else [])


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_chunks_cover_every_character_in_order(text):
    reached = 0
    for start, end in chunking._chunk_spans(text, 0, len(text), list(chunking.SEPARATORS), 20, 4):
        assert reached - 4 <= start <= reached < end
        reached = end
    assert reached == len(text)


def test_preferred_cuts():
    text = ("p" * 300) + "\n\n" + ("q" * 300) + ". " + ("r" * 300)
    assert chunking.split_text(text) == ["p" * 300, "q" * 300, ". " + "r" * 300]
    assert [len(c) for c in chunking.split_text("x" * 1200)] == [500, 500, 300]


def test_chunk_table(spark):
    texts = [(1, "short"), (2, "w " * 600), (3, None), (4, "  ")]
    found = {}
    for row in chunking.chunk_documents(spark.createDataFrame(texts, "doc_id int, text string")).orderBy("doc_id", "chunk_idx").collect():
        found.setdefault(row.doc_id, []).append(row.chunk)
    assert found == {1: ["short"], 2: chunking.split_text("w " * 600)}


def test_chunks_of_the_provided_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {}
    for row in chunking.chunk_documents(documents).orderBy("doc_id", "chunk_idx").collect():
        found.setdefault(row.doc_id, []).append(row.chunk)
    assert found == {r.doc_id: m for r in documents.collect() if (m := model_chunks(r.text, 500, 50))}


def test_corpus(spark):
    loaded = spark.createDataFrame([("a.txt", "text"), ("b.pdf", None)], "source_file string, text string")
    chunks, bad = chunking.corpus(loaded, fail_fast=False)
    assert [tuple(r) for r in chunks.collect()] == [("a.txt", 0, "text")]
    assert [tuple(r) for r in bad.collect()] == [("b.pdf",)]
    with pytest.raises(DocumentIngestionError, match="b.pdf"):
        chunking.corpus(loaded)
    assert chunking.corpus(loaded.where("text = ''"))[0].count() == 0


def test_embedding_loads_the_model_once_per_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def make():
        loads.add(1)
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "id int, chunk string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = {r.id: r.embedding for r in vectors.embed(df, make).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {i: [float(i), 1.0] for i in range(50)}
    assert loads.value == 3


def test_embedding_keeps_the_other_columns(spark):
    rows = [(9007199254740993, "a", None, ["x", None]), (None, "bb", datetime.datetime(2024, 1, 2, 3, 4, 5), []), (7, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, chunk string, at timestamp, tags array<string>")
    found = vectors.embed(df, lambda: lambda texts: [None if t is None else [float(len(t))] for t in texts]).collect()
    assert [tuple(r) for r in found] == [(*row, vector) for row, vector in zip(rows, ([1.0], [2.0], None))]


def test_neighbours_without_a_text_stay(spark):
    chunks = spark.createDataFrame([("b", "B", None)], "chunk_id string, chunk string, source_file string")
    top = spark.createDataFrame([("q", 1, "a", 0.5), ("q", 2, "b", 0.25)], "query_id string, rank int, chunk_id string, score double")
    assert [tuple(r) for r in vectors.retrieve_scored(chunks, top).orderBy("rank").collect()] == [("q", 1, None, 0.5, "unknown"), ("q", 2, "B", 0.25, "unknown")]
    assert vectors.retrieve(chunks, top).count() == 2


def test_failing_embedding_is_not_swallowed(spark):
    def make():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        vectors.embed(spark.createDataFrame([("a",)], "chunk string"), make).collect()


def as_table(spark, name, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], f"{name} string, embedding array<float>")


def test_dimensions(spark):
    good = as_table(spark, "chunk_id", [("a", [1, 2]), ("b", [3, 4])])
    assert tuple(vectors.vector_dims(good).first()) == (2, 0, 2, 2)
    assert vectors.check_dims(good) == 2
    for bad in (good.unionAll(as_table(spark, "c", [("c", [1])])), good.unionAll(as_table(spark, "c", [("c", None)]))):
        with pytest.raises(DocumentIngestionError):
            vectors.check_dims(bad)
    with pytest.raises(DocumentIngestionError):
        vectors.check_dims(good, dim=3)
    with pytest.raises(Exception, match="must have 2 elements"):
        vectors.cosine_topk(good.unionAll(as_table(spark, "c", [("c", [1])])), good.withColumnRenamed("chunk_id", "query_id")).collect()


def brute_force(chunks, queries, k):
    lines = []
    for query_id, q in queries:
        scored = []
        for chunk_id, v in chunks:
            q64, v64 = np.float32(q).astype(float), np.float32(v).astype(float)
            length = float(np.sqrt(sum(x * x for x in q64)) * np.sqrt(sum(x * x for x in v64)))
            score = sum(a * b for a, b in zip(q64, v64)) / length if length else None
            scored.append((score is None, -(score or 0.0), chunk_id, score))
        for rank, (_, _, chunk_id, score) in enumerate(sorted(scored)[:k], 1):
            lines.append((query_id, rank, chunk_id, None if score is None else round(score, 9)))
    return sorted(lines)


@pytest.mark.parametrize("shard, block, at_once", [(16_384, 2_048, 1_024), (40, 3, 7)])
def test_topk_equals_brute_force(spark, monkeypatch, shard, block, at_once):
    """Copies, opposite and zero vectors; few scores at once; shards and blocks."""
    chance = random.Random(4)
    base = [[chance.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    chunks = [(f"c{i:03d}", base[i % 40] if i % 3 else base[0]) for i in range(150)]
    chunks += [("zero", [0.0] * 6), ("scaled", [x * 7 for x in base[0]])]
    queries = [(f"q{i}", base[i] if i else [0.0] * 6) for i in range(9)]
    for name, value in (("SHARD_ROWS", shard), ("BLOCK_ROWS", block), ("_SLICE_ROWS", at_once)):
        monkeypatch.setattr(vectors, name, value)
    df = as_table(spark, "chunk_id", chunks).repartition(5)
    top = vectors.cosine_topk(df, as_table(spark, "query_id", queries), k=4)
    found = sorted((r.query_id, r["rank"], r.chunk_id, None if r.score is None else round(r.score, 9)) for r in top.collect())
    assert found == brute_force(chunks, queries, 4)


def test_fewer_chunks_than_k_and_no_queries(spark):
    chunks = as_table(spark, "chunk_id", [("a", [1, 0]), ("b", [-1, 0])])
    queries = as_table(spark, "query_id", [("q", [1, 0])])
    assert [(r["rank"], r.chunk_id, r.score) for r in vectors.cosine_topk(chunks, queries).orderBy("rank").collect()] == [(1, "a", 1.0), (2, "b", -1.0)]
    assert vectors.cosine_topk(chunks, queries.limit(0)).count() == 0
    assert vectors.cosine_topk(chunks.limit(0), queries).count() == 0


def test_texts_and_contexts(spark):
    chunks = spark.createDataFrame([("a", " A \n", "doc.pdf"), ("b", "B", None)], "chunk_id string, chunk string, source_file string")
    top = spark.createDataFrame([("q", 1, "b", 0.91996), ("q", 2, "a", -0.5)], "query_id string, rank int, chunk_id string, score double")
    assert [tuple(r) for r in vectors.retrieve_scored(chunks, top).orderBy("rank").collect()] == [
        ("q", 1, "B", 0.92, "unknown"), ("q", 2, " A \n", -0.5, "doc.pdf"),
    ]
    blocks = vectors.context_blocks(vectors.retrieve(chunks, top))
    block = "[Document 1]\nB\n\n---\n\n[Document 2]\nA"
    assert [tuple(r) for r in blocks.collect()] == [("q", block)]
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    per_query = spark.createDataFrame([(1, 1, "second"), (1, 0, "first"), (1, 2, ""), (2, 0, None)], "run_id int, query_idx int, block string")
    assert sorted(map(tuple, vectors.run_contexts(runs, per_query).collect())) == [
        (1, "first\n\n---\n\nsecond"), (2, "No supporting documents uploaded."),
    ]
