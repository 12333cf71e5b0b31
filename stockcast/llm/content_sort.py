"""Exact deduplication by sorting contents.

Rows are range-partitioned by the leading characters of the text and a 64-bit
hash of the whole (Spark samples the splitters; the bounded key keeps the sample
small whatever the texts' lengths), each partition is sorted externally so that
equal texts are adjacent, and neighbours are compared in full. A group larger
than half a partition's fair share is dealt out over several ranges by its
identifier; a pre-aggregated table of those groups, bounded by twice the number
of partitions, then gives them one survivor.

Defined cases: a null text counts as empty; of equal texts the row with the
largest (or smallest) identifier stays; rows repeated with the same identifier
count in ``group_size``, and exactly one of them stays; rows without identifier
come after all others; an empty table gives an empty result; extra columns are
carried in a struct and never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stockcast.llm.common import carried, fair_share, whole

PREFIX = 32


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True,
                 carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and ``row`` (all input columns) if asked for."""
    spark = docs.sparkSession
    share = fair_share(spark, docs.count())
    best = F.max if largest else F.min
    base = docs.select(
        *([carried(docs).alias("row")] if carry else []), F.col(id_col).alias("id"), whole(text_col).alias("t")
    ).withColumns({"h": F.xxhash64("t"), "sha": F.sha2("t", 256)})
    large = (
        base.groupBy("h", "sha").agg(best("id").alias("large_keep"), F.count("*").alias("large_n"))
        .filter(F.col("large_n") > share)
        .withColumn("salts", F.ceil(F.col("large_n") / share))
    )
    keyed = base.join(F.broadcast(large), ["h", "sha"], "left").withColumns({  # at most twice as many rows as partitions
        "lead": F.substring("t", 1, PREFIX),
        "salt": F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(F.lit(0).cast("long")),
    })
    ranged = keyed.repartitionByRange("lead", "h", "salt")
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    neighbours = Window.partitionBy("lead", "h", "salt").orderBy("t", order)
    runs = ranged.withColumn("before", F.lag("t").over(neighbours)).withColumn(
        "run", F.sum(F.when(F.col("before") == F.col("t"), 0).otherwise(1)).over(neighbours)
    ).drop("before", "t")
    run = Window.partitionBy("lead", "h", "salt", "run")
    found = runs.withColumns({
        "run_keep": best("id").over(run), "run_n": F.count("*").over(run), "place": F.row_number().over(run.orderBy(order)),
    })
    keep = F.when(F.col("salts").isNotNull(), F.col("large_keep")).otherwise(F.col("run_keep"))
    return found.select(
        *(["row"] if carry else []),
        F.col("id"), keep.alias("keep_id"), F.coalesce("large_n", "run_n").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return exact_groups(docs, id_col, text_col, largest, carry=True).filter("kept").select("row.*")
