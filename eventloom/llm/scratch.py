"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batch size, so that a Python task holds at most so many texts at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def shared_uri(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared one."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that runs in here when it ends, not when the driver next collects
    garbage: a table that is written doesn't need them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and reads it back: cuts the lineage, and survives lost executors. Shuffle files
    of the way there go."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, uri: str) -> None:
    """Removes a table in the shared folder that its operator has written and no longer reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """The column of this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
