"""Proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; sorted by
their fractional rank (rank + 1/2) / rows of the source, all sources advance at
the same pace, so that any run of consecutive positions has the corpus's mixture.
Cutting the positions evenly gives shards whose row counts differ by one at most
(law ``rows``).

Ranks and positions are counted per bucket (a bucket's offset, plus the place
inside it), so no window ever spans a source or the table: buckets of the hash,
then buckets of the fractional rank, both of which are even by construction,
whatever a source's share. Rows of an identifier (or of none) that would fill a
bucket alone are hashed with their content and a running number. A bucket holds about the root of the number of rows, and
so does the table of offsets. Texts are reduced to their size and CRC-32 before the
first shuffle. The method knows no groups: equal texts may lie in different shards.

Defined cases: a null text has no bytes and the CRC-32 of the empty text; a null
source is a source of its own; repeated rows get places of their own (equal rows
are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockcast.llm.common import cut, whole

HASHED = 2**60


def shuffle_key(seed: int, id_col: str, *more: str) -> Column:
    """60 bits of a seeded MD5, as a long."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (id_col, *more)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def salted(slim: DataFrame, seed: int, limit: int) -> DataFrame:
    """``slim`` (id, source, size, crc, k) with keys of their own for the rows of identifiers that more than ``limit`` rows share.

    Such identifiers are fewer than rows / limit. Equal rows are interchangeable, so
    they are counted and made anew with numbers, ``limit`` at a time.
    """
    often, _ = cut(slim.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(F.col("id").alias("often")))
    if often.isEmpty():
        return slim
    held = F.col("id").eqNullSafe(F.col("often"))
    same = slim.join(F.broadcast(often), held, "left_semi").groupBy("id", "source", "size", "crc").agg(F.count("*").alias("n"))
    blocks = same.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {limit})")).alias("block")).repartition("id", "source", "size", "crc", "block")
    each = blocks.select("*", F.explode(F.expr(f"sequence(block * {limit}, least(n, (block + 1) * {limit}) - 1)")).alias("number"))
    fresh = each.select("id", "source", "size", "crc", shuffle_key(seed, "id", "source", "crc", "size", "number").alias("k"))
    found, _ = cut(slim.join(F.broadcast(often), held, "left_anti").unionByName(fresh))
    return found


def counted(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """``before``: rows of earlier buckets with the same keys, for each bucket."""
    totals = df.groupBy(*keys, bucket).agg(F.count("*").alias("bucket_n"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, bucket, F.coalesce(F.sum("bucket_n").over(earlier), F.lit(0)).alias("before"))


def interleaved(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                rows_per_bucket: int | None = None) -> DataFrame:
    """(id, source, size, crc, position, shard, slot) per row; positions and slots from 0."""
    text = F.encode(whole(text_col), "UTF-8")
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        (F.length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("crc"),
        shuffle_key(seed, id_col).alias("k"),
    )
    slim, _ = cut(slim)
    rows = slim.count()
    limit = rows_per_bucket or max(1, math.isqrt(rows))
    buckets = max(1, math.ceil(rows / limit))
    slim = salted(slim, seed, limit)
    slim = slim.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    ties = ["id", "crc", "size"]
    first = slim.withColumn("b", F.floor(F.col("k") / (HASHED // buckets)))
    inside = Window.partitionBy("s", "b").orderBy("k", *ties)
    ranked = first.join(counted(first, ["s"], "b"), ["s", "b"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    sizes = slim.groupBy("s").agg(F.count("*").alias("n"))
    spread = ranked.drop("before", "b").join(sizes, "s").withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("n")))
    spread, _ = cut(spread.withColumn("b", F.floor(F.col("fraction") * buckets)).drop("n", "rank"))
    place = Window.partitionBy("b").orderBy("fraction", "s", "k", *ties)
    offsets = spread.groupBy("b").agg(F.count("*").alias("bucket_n")).withColumn(
        "before", F.coalesce(F.sum("bucket_n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )  # a row per bucket: that is the one window over all
    positions = spread.join(offsets, "b").withColumn("position", F.col("before") + F.row_number().over(place) - 1)
    shard = F.expr(f"position * {shards} div {max(rows, 1)}")
    starts = F.ceil(F.col("shard") * rows / F.lit(shards)) if rows < 2**52 // shards else F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return positions.withColumn("shard", shard).select(
        "id", "source", "size", "crc", "position", F.col("shard").cast("int").alias("shard"), (F.col("position") - starts.cast("long")).alias("slot")
    )
