"""Keeping one row per key, and ranking, without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockcast.session import cut


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` per key.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key that holds a third of all rows costs no more than others.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = F.col(order) if isinstance(order, str) else order
    best = F.min_by(F.struct(*rest), by).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1..n over all rows, spread over range partitions.

    The range-sorted rows are cut to the shared folder so that partition ids
    stay the same for both uses; the offsets table has one row per partition.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        placed.withColumn("_row", inside)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_row") + F.col("_offset")).cast("int"))
        .drop("_part", "_row", "_offset")
    )
