"""A keyed streaming result kept as batches of changed rows, folded into snapshots now and then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# Batches after which the changes so far are folded into one snapshot.
SNAPSHOT_EVERY = 50


def write_changes(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    available_now: bool = True,
    keys: list[str] | None = None,
    order: str | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Write the rows that change in each micro-batch to ``folder/changes/batch=<id>``.

    Update mode keeps a batch as small as its changes.  A repeated batch
    overwrites its own folder, so a restart after a failure leaves no doubles.
    With ``keys`` every ``snapshot_every``-th batch folds the newest rows into
    ``folder/snapshots/upto=<id>``; a read takes the last complete snapshot and
    the batches after it.  What is older than the snapshot before is removed then: a read that has begun
    has the time of ``snapshot_every`` batches to end, and no read lists more than two of them.
    """

    def save(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")
        if keys and batch % snapshot_every == snapshot_every - 1:
            newest = _newest(_since_snapshot(spark, folder, changes.schema, below=batch + 1), keys, order)
            newest.write.mode("overwrite").parquet(f"{folder}/snapshots/upto={batch}")
            _forget(spark, folder)

    # The schema is written first, so a result without any batch can be read.
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/schema")
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def latest_changes(spark: SparkSession, folder: str, keys: list[str], order: str | None = None) -> DataFrame:
    """The newest row of every key; the column ``order`` decides, and the batch where it ties."""
    schema = spark.read.parquet(f"{folder}/schema").schema
    return _newest(_since_snapshot(spark, folder, schema), keys, order).drop("batch")


def _newest(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    newest = F.col("batch") if order is None else F.struct(F.col(order).alias("order"), F.col("batch"))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), newest).alias("row"))
    return best.select(*keys, "row.*")


class _Log:
    """The completed folders of a change log; only those with a ``_SUCCESS`` count."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root = self._path(folder)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, kind: str, name: str, complete: bool = True) -> list[int]:
        there = self._files.globStatus(self._path(self._root, f"{kind}/{name}=*" + ("/_SUCCESS" if complete else "")))
        paths = [s.getPath().getParent() if complete else s.getPath() for s in there or []]
        return sorted(int(p.getName().split("=")[1]) for p in paths)

    def remove(self, kind: str, name: str, number: int) -> None:
        self._files.delete(self._path(self._root, f"{kind}/{name}={number}"), True)


def _forget(spark: SparkSession, folder: str) -> None:
    """Remove the batches up to the last snapshot but one, and the snapshots before it."""
    log = _Log(spark, folder)
    snapshots = log.numbers("snapshots", "upto")
    if len(snapshots) < 2:
        return
    for number in log.numbers("changes", "batch", complete=False):
        if number <= snapshots[-2]:
            log.remove("changes", "batch", number)
    for number in log.numbers("snapshots", "upto", complete=False):
        if number < snapshots[-2]:
            log.remove("snapshots", "upto", number)


def _since_snapshot(spark: SparkSession, folder: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """The rows of the last snapshot and of the batches after it, with ``batch``."""
    log = _Log(spark, folder)
    last = max([n for n in log.numbers("snapshots", "upto") if below is None or n < below - 1], default=-1)
    batches = [n for n in log.numbers("changes", "batch") if n > last and (below is None or n < below)]
    rows = spark.createDataFrame([], T.StructType([*schema, T.StructField("batch", T.LongType())]))
    if last >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{folder}/snapshots/upto={last}"))
    if batches:
        reader = spark.read.schema(rows.schema).option("basePath", f"{folder}/changes")
        rows = rows.unionByName(reader.parquet(*[f"{folder}/changes/batch={n}" for n in batches]))
    return rows
