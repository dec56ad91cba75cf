"""MinHash near-duplicates with tensored banding.

Two small collections of minhash pairs are computed per document, ``HALVES``
each.  A table key combines one pair of the first with one of the second, so
4 * HALVES minhashes serve HALVES * HALVES tables of four.  Documents with
equal sets are one class; only classes take part from there on.

In each table every class is paired with the most connected one of its bucket,
and the pairs are confirmed on full sets.  The components of these links then
leave few classes that share a table without being linked: those of
different components are compared with each other in blocks of bounded size,
so no link between different texts that share a table is lost.

Defined cases: without words or text a document's set is empty and it is linked
with nothing; equal sets are linked; documents with a null doc_id belong to the
component of an equal set, if there is one, and pass on no links; rows that share a doc_id are one
document to the links; repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import Batches, map_arrow, pieces, record_batch, texts_of
from insightspark.llm.components import components
from insightspark.llm.shingles import mixed, shingle_sets, similar
from insightspark.session import write_once

WORDS = 4
PERCENT = 80
HALVES = 10
# Classes compared with each other in one task at most, on either side, and their shingles, but for a single class that has more.
BLOCK = 1024
SHINGLES = 1_500_000
_BATCH = 4 << 20
_COLUMNS = 4096

_RANDOM = np.random.default_rng(4)
_XOR = _RANDOM.integers(0, 2**64, 4 * HALVES, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, 4 * HALVES, dtype=np.uint64) | np.uint64(1)


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[set, 2 * HALVES]: pairs of minhashes as numbers; the sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    least = [np.minimum.reduceat((flat ^ x) * t, starts) for x, t in zip(_XOR, _TIMES)]
    keys = [mixed(mixed(least[2 * i]) + least[2 * i + 1] + np.uint64(i)) for i in range(2 * HALVES)]
    return np.stack(keys, axis=1).view(np.int64)


def sketches(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set) and halves (null for an empty set)."""

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole, _BATCH):
                sets = shingle_sets(texts_of(batch.column(1)), words)
                full = [i for i, x in enumerate(sets) if len(x)]
                halves: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, half_keys([sets[i] for i in full])):
                        halves[i] = row
                keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield record_batch(schema, [batch.column(0), [len(x) for x in sets], keys, pa.array(halves, type=schema.field(3).type)])

    return map_arrow(
        documents.select("doc_id", "text"), "doc_id bigint, n_shingles bigint, set_key binary, halves array<bigint>", run
    )


def confirmed(pairs: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    texts = documents.select("doc_id", "text").filter("doc_id IS NOT NULL")
    rows = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole, _BATCH):
                # Rows come sorted by a, so its text is often the one before.
                texts_a, texts_b = texts_of(batch.column(2)), texts_of(batch.column(3))
                new = [i for i, x in enumerate(texts_a) if not i or x != texts_a[i - 1]]
                sets_a = shingle_sets([texts_a[i] for i in new], words)
                at = np.searchsorted(new, np.arange(len(texts_a)), side="right") - 1
                sets_b = shingle_sets(texts_b, words)
                fits = [similar(sets_a[k], y, percent) for k, y in zip(at, sets_b)]
                yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_())).cast(schema)

    return map_arrow(rows, "a bigint, b bigint", run).distinct()


def _star_pairs(shared: DataFrame) -> DataFrame:
    """Each class with the most connected one of each of its tables' buckets."""
    sides = shared.groupBy("id").agg(
        F.sum("n").alias("degree"),
        F.collect_list(F.when(F.col("half") < HALVES, F.struct("half", "value"))).alias("first"),
        F.collect_list(F.when(F.col("half") >= HALVES, F.struct("half", "value"))).alias("second"),
    )
    tables = sides.select("id", "degree", F.explode("first").alias("x"), "second").select(
        "id", "degree", F.explode(F.transform("second", lambda y: F.xxhash64(F.col("x"), y))).alias("bucket")
    )
    hubs = (
        tables.groupBy("bucket")
        .agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("best"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("bucket", (-F.col("best.minus")).alias("hub"))
    )
    return tables.join(hubs, "bucket").filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def _unlinked_pairs(shared: DataFrame, classes: DataFrame, found: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of classes in one table but in different components that look similar, by block."""
    firsts = (
        shared.filter(F.col("half") < HALVES)
        .join(found, "id", "left")
        .select("half", "value", "id", F.coalesce("component", "id").alias("component"))
    )
    mixed_ = (
        firsts.join(classes.select("id", "size"), "id")
        .groupBy("half", "value")
        .agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"), (F.min("component") < F.max("component")).alias("mixed"))
        .filter("mixed")
    )
    rows = write_once(firsts.join(mixed_.drop("mixed"), ["half", "value"]), "mixed-buckets")
    wanted = write_once(rows.select("id").distinct(), "mixed-ids")
    texts = documents.select("doc_id", "text").join(wanted, documents["doc_id"] == wanted["id"]).select("id", "text")

    def shorten(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole, _BATCH):
                sets = shingle_sets(texts_of(batch.column(1)), words)
                yield record_batch(schema, [batch.column(0), [np.unique(x.astype(np.uint32)).tobytes() for x in sets], [len(x) for x in sets]])

    short = map_arrow(texts, "id bigint, short binary, size bigint", shorten)
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = (
        rows.select("half", "value", "id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("half", "value", "id", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .join(short, "id")
        .join(classes.select("id", "halves"), "id")
    )
    half_count = HALVES

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        half = key[0].as_py()
        ids, component, own_, size = (table.column(c).to_numpy() for c in ("id", "component", "own", "size"))
        sets = [np.frombuffer(x, dtype=np.uint32) for x in table.column("short").to_pylist()]
        keys = np.array(table.column("halves").to_pylist(), dtype=np.int64).reshape(len(ids), -1)
        fits = may_be_similar(sets, size, percent)
        fits &= (component[:, None] != component[None, :]) & (ids[:, None] < ids[None, :])
        if key[2].as_py() != key[3].as_py():
            fits &= own_[:, None] != own_[None, :]
        i, j = np.nonzero(fits)
        # A pair is taken where its first common half is, and only if it shares a half of the second kind.
        same = keys[i] == keys[j]
        take = ~same[:, :half].any(axis=1) & same[:, half_count:].any(axis=1)
        return pa.table({"a": pa.array(ids[i[take]], pa.int64()), "b": pa.array(ids[j[take]], pa.int64())})

    return dealt.groupBy("half", "value", "low", "high").applyInArrow(compare, "a bigint, b bigint").distinct()


def may_be_similar(short: list[np.ndarray], size: np.ndarray, percent: int) -> np.ndarray:
    """[set, set]: whether sets of ``size`` members, cut to 32 bits in ``short``, can be similar."""
    # Members of a set whose cut numbers are equal: so many shared ones may not show.
    hidden = size - np.array([len(x) for x in short])
    common = common_counts(short) + np.minimum(hidden[:, None], hidden[None, :])
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """[set, set]: numbers of common members, by products of blocks of columns."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts[column] > 1
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + _COLUMNS])
        block = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        total += block @ block.T
    return total.astype(np.int64)


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``documents``."""
    sketched = write_once(sketches(documents, words), "sketches")
    classes = write_once(
        sketched.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.first("halves").alias("halves"), F.first("n_shingles").alias("size")),
        "classes",
    )
    halves = classes.select("id", F.posexplode("halves").alias("half", "value"))
    often = halves.groupBy("half", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    matched = halves.join(often, ["half", "value"])
    # A class needs a partner in both collections.
    both = matched.groupBy("id").agg((F.min("half") < HALVES).alias("x"), (F.max("half") >= HALVES).alias("y")).filter("x AND y")
    shared = write_once(matched.join(both.select("id"), "id"), "shared-halves")
    links = write_once(confirmed(write_once(_star_pairs(shared), "star-pairs"), documents, words, percent), "star-links")
    found = write_once(components(links), "components")
    rest = write_once(_unlinked_pairs(shared, classes, found, documents, words, percent), "rest-pairs")
    more = write_once(confirmed(rest, documents, words, percent), "rest-links")
    if not more.isEmpty():
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = write_once(components(stars.unionByName(more)), "components")
    named = classes.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return (
        sketched.select("doc_id", "n_shingles", "set_key")
        .join(named, "set_key", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
