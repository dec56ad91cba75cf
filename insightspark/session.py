"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "insightspark") -> SparkSession:
    """A session for tests and the benchmark, with a shared folder; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="insightspark-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of this process
    gets one folder of its own; any other could not see that folder, so there
    a missing setting is an error.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        master, application = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        base = _own_folders.get(application) or _own_folders.setdefault(application, tempfile.mkdtemp(prefix="insightspark-"))
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def write_once(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reader of that copy.

    Used where several jobs follow from one expensive table.  The copy outlives
    executors, is columnar, and lets later jobs prune columns.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """The answer of an operator whose required columns are absent."""
    return spark.createDataFrame([], schema)
