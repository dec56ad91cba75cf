"""Embedding through a user function, exact cosine top-k, and context texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from insightspark.errors import DocumentIngestionError
from insightspark.functions.kinds import column
from insightspark.functions.numbers import python_round
from insightspark.functions.text import default_text, strip
from insightspark.operators.batches import bounded_slices
from insightspark.operators.pivots import Regions, directions, first_regions, placed, wanted_regions
from insightspark.operators.search import joined_in_order
from insightspark.session import write_once

TOP_K = 5
DIVIDER = "\n\n---\n\n"
NO_DOCUMENTS = "No supporting documents uploaded."

# Rows of one group: chunks of a shard, and queries of a block.
SHARD_ROWS = 16_384
BLOCK_ROWS = 2_048
# Bytes of queries and their ids that are broadcast.
QUERY_BYTES = 32 << 20
# Regions of the chunks: a cell around each pivot, divided into rings.
MOST_PIVOTS = 256
MOST_RINGS = 32
# Chunks whose scores with a block of queries are computed at once.
_SLICE_ROWS = 1_024
# Far above the rounding of a matrix product of unit vectors, far below a real gap.
_SCORE_SLACK = 1e-9

Embed = Callable[[list[str]], list]


def embed(df: DataFrame, make: Callable[[], Embed], text: str = "chunk", vector: str = "embedding") -> DataFrame:
    """Add an ARRAY<FLOAT> column; ``make()`` loads the embedding function once per task.

    Only the texts become Python objects, in batches of bounded size; all other
    columns stay in their Arrow buffers, so they come back as they were.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])
    place, names = df.columns.index(text), [*df.columns, vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for whole in batches:
            for batch in bounded_slices(whole):
                found = [None if v is None else np.asarray(v, dtype=np.float32) for v in function(batch.column(place).to_pylist())]
                vectors = pa.array(found, type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=names)

    return df.mapInArrow(run, schema)


def vector_dims(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: ``vectors``, ``missing``, ``min_dim``, ``max_dim``."""
    size = F.size(column(vector))
    return df.agg(
        F.count(column(vector)).alias("vectors"),
        F.count(F.when(column(vector).isNull(), 1)).alias("missing"),
        F.min(F.when(column(vector).isNotNull(), size)).alias("min_dim"),
        F.max(F.when(column(vector).isNotNull(), size)).alias("max_dim"),
    )


def check_dims(df: DataFrame, dim: int | None = None, vector: str = "embedding") -> int:
    """The one dimension of all vectors; ``DocumentIngestionError`` if they differ from it or each other."""
    return _checked_dims(df, dim, vector)[1]


def _checked_dims(df: DataFrame, dim: int | None, vector: str) -> tuple[int, int]:
    found = vector_dims(df, vector).first()
    if found["missing"] or found["min_dim"] != found["max_dim"] or (dim is not None and found["max_dim"] not in (None, dim)):
        raise DocumentIngestionError(f"Vectors of unequal dimension: {found.asDict()}, expected {dim}")
    return found["vectors"], found["max_dim"] or 0


def cosine_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, chunk_id, score): the exact k nearest chunks of every query.

    Queries that fit into one block, by number and by measured bytes, are broadcast: the chunks are
    scanned where they lie, each task keeps k per query, and no chunk is shuffled.
    More queries meet chunks by regions around pivots.  A first look at the regions next
    to a query gives the score it can count on; then it meets only regions that can
    hold a better one (``operators/pivots.py``).  Regions are dealt into shards and the
    queries that want one into blocks, both of bounded size; no pair is a row, and
    regions that no query wants are not shuffled.

    The rank filter prunes each task's rows before the last
    shuffle.  The result is written to the shared folder, so that later joins
    know how small it is.  Equal scores go to the smaller id; a vector of
    length zero has no score and comes last.
    """
    asked = queries.select(column(query_id).alias("query_id"), column(query_vector).alias("vector"))
    stored = chunks.select(column(chunk_id).alias("chunk_id"), column(vector).alias("vector"))
    count, dim = _checked_dims(asked, None, "vector")
    kernel = _Kernel(asked.schema["query_id"].dataType, stored.schema["chunk_id"].dataType, dim, k)
    if count <= BLOCK_ROWS and count * dim * 8 + _id_bytes(asked) <= QUERY_BYTES:
        scored = _scan_with_queries(asked, stored, kernel)
    else:
        scored = _search_regions(asked, stored, kernel)
    return write_once(_ranked(scored, k).select("query_id", "rank", "chunk_id", "score"), "topk")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    # A missing score is null and sorts last.
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col("chunk_id").asc())
    return scored.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _id_bytes(asked: DataFrame) -> int:
    return asked.agg(F.sum(F.octet_length(F.col("query_id").cast("string")))).first()[0] or 0


class _Kernel:
    """The k best of some chunks for some queries, as Arrow tables (query_id, chunk_id, score)."""

    def __init__(self, query_type: T.DataType, chunk_type: T.DataType, dim: int, k: int):
        self.dim, self.k = dim, k
        self.schema = T.StructType(
            [T.StructField("query_id", query_type), T.StructField("chunk_id", chunk_type), T.StructField("score", T.DoubleType())]
        )
        self.arrow = to_arrow_schema(self.schema)

    def best(self, queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if not (queries.num_rows and chunks.num_rows):
            return self.arrow.empty_table()
        chunks = chunks.sort_by("chunk_id")
        query, place, score = _best_places(_matrix(chunks.column("vector"), self.dim), _matrix(queries.column("vector"), self.dim), self.k)
        columns = [queries.column("query_id").take(pa.array(query)), chunks.column("chunk_id").take(pa.array(place)), pa.array(score, from_pandas=True)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, self.arrow)], schema=self.arrow)

    def merged(self, found: list[pa.Table]) -> pa.Table:
        """The k best per query of several such tables."""
        table = pa.concat_tables(found).sort_by([("query_id", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        if not table.num_rows:
            return table
        codes = table.column("query_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.arange(len(codes))
        first = np.maximum.accumulate(np.where(np.append(True, codes[1:] != codes[:-1]), at, 0))
        return table.filter(pa.array(at - first < self.k))


def _scan_with_queries(asked: DataFrame, stored: DataFrame, kernel: _Kernel) -> DataFrame:
    """Every task of the chunks' scan with all queries, at most a block of them."""
    queries = stored.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, size = kernel.arrow.empty_table(), [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= SHARD_ROWS:
                kept = kernel.merged([kept, kernel.best(queries.value, pa.Table.from_batches(waiting))])
                waiting, size = [], 0
        if waiting:
            kept = kernel.merged([kept, kernel.best(queries.value, pa.Table.from_batches(waiting))])
        yield from kept.to_batches()

    return stored.mapInArrow(run, kernel.schema)


def _search_regions(asked: DataFrame, stored: DataFrame, kernel: _Kernel) -> DataFrame:
    shards = max(1, -(-stored.count() // SHARD_ROWS))
    pivots = _chosen_pivots(stored, kernel.dim, min(shards, MOST_PIVOTS)) if shards > 1 else np.zeros((0, kernel.dim))
    if not len(pivots):  # one shard, or no vector with a direction
        return _met(asked.withColumn("region", F.lit(0)), stored.withColumn("region", F.lit(0)), {0: shards}, kernel)
    rings = max(1, min(shards // len(pivots), MOST_RINGS))
    cells = write_once(_with_cells(stored, pivots, kernel.dim), "cells")
    regions, parts, inside = _divided(cells, pivots, rings)
    shared = stored.sparkSession.sparkContext.broadcast(tuple(regions))  # arrays alone, which workers read without this package
    dim, k = kernel.dim, kernel.k

    looked = _placed_queries(asked, lambda v, _, regions: first_regions(v, regions, k), shared, dim)
    part = F.pmod(F.xxhash64("chunk_id"), "parts")
    first = _met(looked, inside.where(part == 0).drop("parts"), dict.fromkeys(parts, 1), kernel)
    bars = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bar"))
    with_bars = write_once(asked.join(bars, F.col("query_id").eqNullSafe(F.col("id")), "left").drop("id"), "queries")
    wanted = _placed_queries(with_bars, wanted_regions, shared, dim)
    return _met(wanted, inside.drop("parts"), parts, kernel)


def _chosen_pivots(stored: DataFrame, dim: int, n: int) -> np.ndarray:
    """At most ``n`` different unit vectors, by a hash of their ids; the driver sees no more."""
    fit = stored.where(F.col("vector").isNotNull() & (F.size("vector") == dim))
    some = fit.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n).select("vector").toArrow()
    if not some.num_rows:
        return np.zeros((0, dim))
    unit, kind = directions(_matrix(some.column("vector"), dim))
    return np.unique(unit[kind == 0], axis=0)


def _with_cells(stored: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """The chunks with ``cell`` and ``angle``, the angle to the cell's pivot."""
    schema = T.StructType([*stored.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    shared = stored.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded_slices(whole):
                cell, angle = placed(_matrix(pa.chunked_array([batch.column(1)]), dim), shared.value)
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return stored.mapInArrow(run, schema)


def _divided(cells: DataFrame, pivots: np.ndarray, rings: int) -> tuple[Regions, dict[int, int], DataFrame]:
    """(regions, shards of each, chunks with ``region`` and its number of shards ``parts``).

    The rings of a cell hold about as many chunks each.  There are at most
    ``MOST_PIVOTS`` x ``MOST_RINGS`` regions and two, whatever the number of chunks.
    """
    spark = cells.sparkSession
    steps = [i / rings for i in range(1, rings)]
    edges = F.percentile_approx("angle", steps) if steps else F.array().cast("array<double>")
    by_cell = [(r["cell"], r["edges"]) for r in cells.groupBy("cell").agg(edges.alias("edges")).collect()]
    known = spark.createDataFrame(by_cell, "cell int, edges array<double>")
    ring = F.size(F.filter("edges", lambda e: e < F.col("angle")))
    region = (F.col("cell") * F.lit(rings) + F.when(F.col("cell") >= 0, ring).otherwise(0)).cast("int")
    ringed = cells.join(F.broadcast(known), "cell").withColumn("region", region)
    stats = ringed.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    table = sorted(stats.collect())
    parts = {r["region"]: -(-r["n"] // SHARD_ROWS) for r in table}
    dealt = spark.createDataFrame(list(parts.items()), "region int, parts long")
    inside = ringed.join(F.broadcast(dealt), "region").select("chunk_id", "vector", "region", "parts")
    numbers = {name: np.array([r[name] for r in table]) for name in ("region", "cell", "low", "high", "n")}
    rows = numbers.pop("n") // np.array([parts[r["region"]] for r in table])
    return Regions(pivots, rows=rows, **numbers), parts, inside


def _placed_queries(asked: DataFrame, choose: Callable, shared, dim: int) -> DataFrame:
    """A row per query and region that it meets: query_id, vector, region."""
    schema = T.StructType([asked.schema["query_id"], asked.schema["vector"], T.StructField("region", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions = Regions(*shared.value)
        for whole in batches:
            for batch in bounded_slices(whole):
                vectors = _matrix(pa.chunked_array([batch.column(1)]), dim)
                bars = batch.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
                query, place = choose(vectors, bars, regions)
                region = regions.region[place].astype(np.int32)
                for start in range(0, len(query), SHARD_ROWS):
                    at = pa.array(query[start : start + SHARD_ROWS])
                    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(region[start : start + SHARD_ROWS])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return asked.mapInArrow(run, schema)


def _meetings(asked: DataFrame, parts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(region, shards, blocks of queries) of the regions that some query meets."""
    wanting = asked.groupBy("region").count().collect()
    return [(r["region"], parts[r["region"]], -(-r["count"] // BLOCK_ROWS)) for r in wanting]


def _met(asked: DataFrame, stored: DataFrame, parts: dict[int, int], kernel: _Kernel) -> DataFrame:
    """Each region's shards with each block of the queries that meet it, a group apiece."""
    dealt = F.broadcast(stored.sparkSession.createDataFrame(_meetings(asked, parts), "region int, parts long, blocks long"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def one(name: str, n: str) -> Column:
        return F.pmod(F.xxhash64(name), n)

    absent = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in kernel.schema}
    sides = asked.join(dealt, "region").select(
        F.lit(True).alias("asks"), "query_id", absent["chunk_id"], "vector", "region", one("query_id", "blocks").alias("block"), every("parts").alias("part")
    ).unionByName(
        stored.join(dealt, "region").select(
            F.lit(False).alias("asks"), absent["query_id"], "chunk_id", "vector", "region", every("blocks").alias("block"), one("chunk_id", "parts").alias("part")
        )
    )

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        return kernel.best(table.filter(asks), table.filter(pc.invert(asks)))

    return sides.groupBy("region", "part", "block").applyInArrow(run, kernel.schema)


def retrieve(chunks: DataFrame, top: DataFrame, chunk_id: str = "chunk_id", text: str = "chunk") -> DataFrame:
    """(query_id, rank, content): the texts of the nearest chunks; null where a chunk has none."""
    texts = chunks.select(column(chunk_id).alias("chunk_id"), column(text).alias("content"))
    return top.join(texts, "chunk_id", "left").select("query_id", "rank", "content")


def retrieve_scored(
    chunks: DataFrame, top: DataFrame, chunk_id: str = "chunk_id", text: str = "chunk", source: str = "source_file"
) -> DataFrame:
    """(query_id, rank, content, score, source): score to four decimals, in -1..1."""
    texts = chunks.select(
        column(chunk_id).alias("chunk_id"), column(text).alias("content"), column(source).alias("source")
    )
    return top.join(texts, "chunk_id", "left").select(
        "query_id",
        "rank",
        "content",
        python_round(F.col("score"), 4).alias("score"),
        default_text(F.col("source"), "unknown").alias("source"),
    )


def context_blocks(retrieved: DataFrame) -> DataFrame:
    """(query_id, block): the texts of one query, numbered and divided; at most k per query."""
    text = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("]\n"), strip(default_text(F.col("content"))))
    return retrieved.groupBy("query_id").agg(joined_in_order("rank", text, DIVIDER).alias("block"))


def run_contexts(runs: DataFrame, blocks: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, context): the blocks of a run's few queries in order, empty ones left out.

    ``blocks`` has (run, query_idx, block), one row per query: a run asks the few
    queries its question gives, so its blocks fit into one row.  A chunk
    found by two queries appears twice.  A run without blocks gets a fixed sentence.
    """
    joined = blocks.where(default_text(F.col("block")) != "").groupBy(run).agg(
        joined_in_order("query_idx", F.col("block"), DIVIDER).alias("context")
    )
    every_run = runs.select(run).distinct().join(joined, run, "left")
    return every_run.select(run, default_text(F.col("context"), NO_DOCUMENTS).alias("context"))


def _matrix(column_: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column_.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if lists.null_count or not (lengths == dim).all():
        raise DocumentIngestionError(f"Every stored vector must have {dim} elements")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)


def _best_places(vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the k best places per query; NaN where there is no score, ties by place.

    A matrix product finds who can be among them, slice by slice above a rising
    bar per query; a fixed-order sum scores those, in one go whenever as many have gathered as are kept.
    """
    lengths, query_lengths = np.sqrt(_dot(vectors, vectors)), np.sqrt(_dot(queries, queries))
    with np.errstate(divide="ignore", invalid="ignore"):
        unit, query_unit = vectors / lengths[:, None], queries / query_lengths[:, None]
    bar = np.full(len(queries), -np.inf)
    kept = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    gathered: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal kept
        query = np.concatenate([q for q, _ in gathered])
        place = np.concatenate([p for _, p in gathered])
        gathered.clear()
        with np.errstate(divide="ignore", invalid="ignore"):
            score = _dot(vectors[place], queries[query]) / (lengths[place] * query_lengths[query])
        query, place, score = (np.concatenate(pair) for pair in zip(kept, (query, place, score)))
        rated = np.where(np.isnan(score), -np.inf, score)
        order = np.lexsort((place, -rated, query))
        query, place, score = query[order], place[order], score[order]
        first = np.searchsorted(query, query, side="left")
        best = np.arange(len(query)) - first < k
        kept = query[best], place[best], score[best]
        last = np.flatnonzero(np.append(kept[0][1:] != kept[0][:-1], True))
        full = last[np.bincount(kept[0], minlength=len(queries))[kept[0][last]] == k]
        bar[kept[0][full]] = np.where(np.isnan(kept[2][full]), -np.inf, kept[2][full])

    for start in range(0, len(vectors), _SLICE_ROWS):
        rough = query_unit @ unit[start : start + _SLICE_ROWS].T
        rough[np.isnan(rough)] = -np.inf
        least = bar
        if rough.shape[1] > k:
            least = np.maximum(bar, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k])
        query, place = np.nonzero(rough >= least[:, None] - _SCORE_SLACK)
        gathered.append((query, place + start))
        if sum(len(q) for q, _ in gathered) >= len(queries) * k:
            merge()
    if gathered:
        merge()
    return kept


def _dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise dot products summed in the order of the elements, so copies score the same anywhere."""
    total = np.zeros(len(left))
    for i in range(left.shape[1]):
        total += left[:, i] * right[:, i]
    return total
