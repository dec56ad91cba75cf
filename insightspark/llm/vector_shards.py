"""Queries against all vectors in blocks: bounded groups, and the merge of their answers.

Vectors are dealt into shards of about ``SHARD`` rows by a hash of their id, queries
into blocks of about ``BLOCK``; a task gets one block and one shard.  Queries are
a stated set, and no pair of rows is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insightspark.llm.common import record_batch

SHARD = 16_384
BLOCK = 2_048
# Room for a row's place in a shard within a sort key.
PLACES = 1 << 20

# (query ids, queries, vector ids, vectors) to, per query, (places of vectors, scores).
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def finite_vectors(rows: DataFrame, component: Callable[[Column], Column]) -> DataFrame:
    """vec_id and vec (doubles) of the rows whose vector is whole and finite; a null vec_id takes no part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", component).alias("vec")
    )


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def nearest(vectors: DataFrame, every: int, k: int, search: Search, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``search`` for every vec_id divisible by ``every``.

    Vectors meet only those with as many components.  Rows that share the
    query's id are its own.  Of several rows with a query's id, the smallest
    vector is the query.
    """
    queries = (
        vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    )
    shards = max(1, -(-vectors.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = F.xxhash64("vec_id")

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    sides = (
        queries.select(F.lit(True).alias("asks"), "vec_id", "vec", F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), numbers(shards).alias("shard"))
        .unionByName(
            vectors.select(F.lit(False).alias("asks"), "vec_id", "vec", F.pmod(dealt, F.lit(shards)).cast("int").alias("shard"), numbers(blocks).alias("block"))
        )
        .withColumn("dimension", F.size("vec"))
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dimension = key[2].as_py()
        asks = table.column("asks")
        q, v = table.filter(asks), table.filter(pa.compute.invert(asks))
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score_type == "bigint" else pa.float64())])
        if not (q.num_rows and v.num_rows):
            return pa.Table.from_batches([], schema=schema)
        v = v.sort_by("vec_id")
        query_ids, ids = q.column("vec_id").to_numpy(), v.column("vec_id").to_numpy()
        found = search(query_ids, _matrix(q.column("vec"), dimension), ids, _matrix(v.column("vec"), dimension))
        counts = [len(places) for places, _ in found]
        out = record_batch(
            schema,
            [
                np.repeat(query_ids, counts),
                ids[np.concatenate([places for places, _ in found])],
                np.concatenate([scores for _, scores in found]).tolist() if score_type == "bigint" else np.concatenate([scores for _, scores in found]),
            ],
        )
        return pa.Table.from_batches([out])

    found = sides.groupBy("shard", "block", "dimension").applyInArrow(run, f"query_id bigint, vec_id bigint, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
