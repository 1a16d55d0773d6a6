"""Session settings shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest ordered group that one task may hold. Groups above it take the block path.
MAX_GROUP_ROWS_KEY = "spark.tapeloom.maxGroupRows"
MAX_GROUP_ROWS = 2_000_000
# Largest table, in rows, that may be broadcast.
MAX_BROADCAST_ROWS = 100_000


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS_KEY, str(MAX_GROUP_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: the configured one, or a local one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tapeloom-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def frozen(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder, so later passes and retries see the same ones."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back: later passes and retries see the same rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Of queries begun herein, shuffle files go when the query ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` made and that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
