"""The cluster's shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Folders of the jobs that run in this process, the innermost last.
_JOBS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The running job's part of the folder the cluster names in spark.checkpoint.dir, or all of that; a temporary one only where it is unset on a local master (tests)."""
    if _JOBS:
        return _JOBS[-1]
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of df, for small or narrow rows.

    A checkpoint keeps its plan's inferred constraints and size estimate.  None of the former are
    inferred here; but the estimate squares with each join of a result with itself, so
    iterations end their rounds with table() instead, whose size is that of its files.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with setting(spark, "spark.sql.constraintPropagation.enabled", "false"):
        return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back; for wide rows, as it is compressed."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropping_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within it, each finished job's shuffle files go at once; for steps that end in a written table."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """Within it, written tables and checkpoints go to a folder of this name in the shared one, which goes with them at the end; what a killed job of that name left goes first."""
    base = shared_dir(spark)
    folder = f"{base.rstrip('/')}/{name}"
    remove(spark, folder)
    _JOBS.append(folder)
    spark.sparkContext.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        _JOBS.pop()
        spark.sparkContext.setCheckpointDir(base)
        remove(spark, folder)
