"""The folder that all executors share, for what jobs write on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of an action go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where the cluster names none (tests, local mode) a folder is set once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftwork-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/weftwork/{label}-{uuid.uuid4().hex}"
    for paths in _passing:
        paths.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is saved to the shared folder inside is deleted at the end: results must be written to a path from before."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back; its shuffle files go, as nothing reads them again."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut."""
    return written(df, fresh_path(df.sparkSession, label))


def kept(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, saved; what was saved to make it is deleted."""
    path = fresh_path(spark, label)
    with passing(spark):
        return written(make(), path)
