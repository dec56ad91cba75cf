"""Helpers of the operators: Arrow batches in tasks, and sizes of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows of one output batch hold at most about this many bytes.
BATCH_BYTES = 8 << 20

Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, schema: str | T.StructType, run: Callable[[Batches, pa.Schema], Batches]) -> DataFrame:
    """``df.mapInArrow`` with the output's Arrow schema handed to ``run``."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def task(batches: Batches) -> Batches:
        return run(batches, arrow)

    return df.mapInArrow(task, struct)


def pieces(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Batches:
    """The batch in slices of about ``limit`` bytes, a row at least."""
    rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Null texts as empty ones."""
    return [x or "" for x in column.to_pylist()]


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
