"""Intermediate tables on storage that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a session in local mode gets a folder of this machine, which all
    its tasks reach; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="resonance-"))
    return context.getCheckpointDir()


#: Whether Spark deletes the shuffle files of a query that has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end: what they wrote is all that is read again."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


#: Names given out inside :func:`temporary`, a list for each such block that is open.
_open: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for names in _open:
        names.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table in the shared folder that nothing reads any more, by the file system it is on."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are written to the shared folder inside are removed at the end: write results elsewhere before."""
    names: list[str] = []
    _open.append(names)
    try:
        yield
    finally:
        _open.remove(names)
        for path in names:
            drop(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
