"""From raw documents to packed token sequences: five stages, each written before the next.

Every stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insightspark.llm import minhash, mixing, packing, quality, suffix_dedup
from insightspark.llm.queries import public_vocabulary
from insightspark.session import write_once


def _narrowed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own``, and all others in one, so their names cannot clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*others) if others else F.lit(None).cast("string")).alias("_others"))


def _restored(rows: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in own else F.col("_others").getField(c).alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not reject."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet")).select("doc_id", "quality")
    trees = quality.fit_quality(docs, labels)
    scored = quality.score_quality(_narrowed(docs, "doc_id", "text"), trees)
    return _restored(scored.filter("predicted = 1"), docs, "doc_id", "text")


def _with_keys(docs: DataFrame) -> DataFrame:
    """The documents with ``_key``, one number per doc_id and text, and ``_again``, whether rows share it.

    It is the doc_id for the text of an id whose digest comes first.  Other texts of that id, and texts without one,
    get numbers beyond all ids, which are written, so they stay the same.
    """
    named = docs.withColumn("_digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    texts = named.groupBy("doc_id", "_digest").agg(F.count(F.lit(1)).alias("rows"))
    shared = texts.groupBy("doc_id").agg(F.min("_digest").alias("first"), F.max(F.struct("_digest"))["_digest"].alias("last"), F.max("rows").alias("most"))
    # Ids with more than one row, and all rows without an id.
    odd = shared.filter("first <> last OR most > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"), "first")
    last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    other = F.col("_id").isNull() | (F.col("_digest") != F.col("first"))
    number = F.when(other, F.lit(last + 1) + F.monotonically_increasing_id())
    numbers = write_once(
        texts.join(odd, texts["doc_id"].eqNullSafe(odd["_id"])).select("_id", F.col("_digest").alias("_text"), number.alias("_number"), (F.col("rows") > 1).alias("_again")),
        "extra-texts",
    )
    same = named["doc_id"].eqNullSafe(numbers["_id"]) & (named["_digest"] == numbers["_text"])
    keyed = named.join(numbers, same, "left").withColumn("_key", F.coalesce("_number", "doc_id"))
    return keyed.withColumn("_again", F.coalesce("_again", F.lit(False))).drop("_digest", "_id", "_text", "_number")


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; shingles of five words, similarity 0.8.

    Texts are compared whatever ids they have: of rows that share doc_id and text one stays, different texts that share a
    doc_id are documents of their own, and so are texts without a doc_id.
    """
    keyed = write_once(_with_keys(_narrowed(docs, "doc_id", "text")), "keyed-documents")
    near = minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), words=5)
    kept = write_once(near.filter("kept").select(F.col("doc_id").alias("_key")), "kept-keys")
    chosen = keyed.join(kept, "_key", "left_semi")
    # Only rows that share their key need to meet.
    return _restored(chosen.filter("NOT _again").unionByName(chosen.filter("_again").dropDuplicates(["_key"])), docs, "doc_id", "text")


def suffix_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; n_chars follows the text, and no document goes."""
    cut = suffix_dedup.remove_repeats(_narrowed(docs, "doc_id", "text", "n_chars"), keep=("_others",))
    text = F.col("kept_text")
    named = cut.select("doc_id", "_others", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    return _restored(named, docs, "doc_id", "text", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    mixed = mixing.mix(_narrowed(docs, "doc_id", "text", "source"))
    return _restored(mixed.withColumn("copy", F.explode(copies)), docs, "doc_id", "text", "source")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, public_vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_deduplicate),
    ("suffix-array dedup", suffix_deduplicate),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]

# The stages are learned models, sketches and iterations, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
