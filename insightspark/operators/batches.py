"""The extension point: a user function over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Bytes of one batch that is handed to Python code.
BATCH_BYTES = 16 << 20

BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]


def map_batches(df: DataFrame, make: Callable[[], BatchFunction], schema: T.StructType | str) -> DataFrame:
    """Apply a user function to Arrow batches of ``df``.

    ``make`` runs once per task and returns the function, so a model is loaded
    once and not once per batch.  No service client or model ships here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = make()
        for batch in batches:
            yield apply(batch)

    return df.mapInPandas(run, schema)


def bounded_slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch has a fixed number of rows, however long they are; its slices have about ``limit`` bytes."""
    rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
