"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stockcast", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the library relies on.

    On a cluster the submit command sets master, memory and partition counts;
    here only result-relevant settings (time zone) and plan settings are fixed.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or ``setCheckpointDir``; all executors must share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, visible to every executor."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


ROWS_A_TASK = 500_000


def tasks_of(rows: int, spark: SparkSession) -> int:
    """Partitions for a shuffle of so many narrow rows: as many as the session's, more where a task would get too many rows.

    Partitions merged by their compressed bytes may hold very many rows; a
    number that is given stays.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read on from there.

    Used where one result feeds several later branches: the fit is not run
    again per branch, a lost executor costs no recomputation, and later reads
    keep column pruning and statistics. Inside ``scratch`` the files go when the
    block ends; else they stay for the readers that are still to come.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    if (opened := _scope.get()) is not None:
        opened.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what ``cut`` wrote inside the block, once all that reads it has been written elsewhere."""
    token = _scope.set(written := [])
    try:
        yield
    finally:
        _scope.reset(token)
        for path in written:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
