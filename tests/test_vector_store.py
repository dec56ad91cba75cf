"""Each distinct text is embedded once over several loads."""

from pyspark.sql import functions as F

from insightspark.operators.vector_store import embed_new, stored_vectors


def logged(folder):
    """An embedding function that notes every text it is given."""

    def make():
        import uuid

        def function(texts):
            (folder / uuid.uuid4().hex).write_text("".join(f"{t}\n" for t in texts))
            return [[float(len(t)), float(t.count("a"))] for t in texts]

        return function

    return make


def seen(folder):
    return sorted(line for path in folder.iterdir() for line in path.read_text().splitlines())


def test_only_new_texts_are_embedded(spark, tmp_path):
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    schema = "id int, chunk string, vector int, `odd.name` string"
    first = spark.createDataFrame([(1, "abc", 7, "x"), (2, "banana", 8, "y"), (3, "abc", 9, "z"), (4, None, 1, "n")], schema).repartition(3)
    second = spark.createDataFrame([(5, "abc", 7, "x"), (6, "new", 8, "y"), (7, "", 0, None), (8, "new", 8, "y")], schema)
    assert stored_vectors(spark, store).count() == 0
    found = embed_new(first, store, logged(notes))
    assert found.columns == [*first.columns, "embedding"]
    assert sorted((r.id, r.vector, r.embedding) for r in found.collect()) == [
        (1, 7, [3.0, 1.0]), (2, 8, [6.0, 3.0]), (3, 9, [3.0, 1.0]), (4, 1, None)
    ]
    assert seen(notes) == ["abc", "banana"]
    found = embed_new(second, store, logged(notes))
    assert sorted((r.id, r.embedding) for r in found.collect()) == [(5, [3.0, 1.0]), (6, [3.0, 0.0]), (7, [0.0, 0.0]), (8, [3.0, 0.0])]
    assert seen(notes) == ["", "abc", "banana", "new"]
    embed_new(first.unionByName(second), store, logged(notes)).collect()
    assert seen(notes) == ["", "abc", "banana", "new"]
    assert embed_new(first.limit(0), store, logged(notes)).count() == 0


def test_a_text_stored_twice_gives_one_row(spark, tmp_path):
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    rows = spark.range(50).select("id", F.lit("same").alias("chunk"))
    embed_new(rows, store, logged(notes)).collect()
    spark.read.parquet(store).write.mode("append").parquet(store)
    assert embed_new(rows, store, logged(notes)).count() == 50 and seen(notes) == ["same"]
