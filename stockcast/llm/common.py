"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of its own only where one machine does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="llm-scratch-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; return it as read again, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``cut`` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def carried(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def fair_share(spark: SparkSession, rows: int) -> int:
    """Half the rows that a shuffle partition gets on average; a larger group is split.

    At most twice as many groups as partitions can be larger than that, so a
    table of them has a proven bound.
    """
    return max(1, rows // (2 * partitions(spark)))


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``table``, which holds each ``key`` once and in ``copies`` how many of the ``total`` rows have it.

    Keys of more rows than a fair share are broadcast (at most two per partition),
    so that their rows stay where they are; the others are shuffled.
    """
    often = F.col("copies") > fair_share(rows.sparkSession, total)
    hot = table.filter(often)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(~often), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
