"""New files as a stream: clean, upsert, daily totals, refit of touched series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stockcast.functions.text import category_from_file
from stockcast.operators import clean, demand, model, moments
from stockcast.plans.ingest import Tables, touched_days
from stockcast.schemas import DAILY, SALES, SALES_COLUMNS
from stockcast.session import cut, scratch
from stockcast.sources import changes as change_files, store
from stockcast.sources.upload import DIALECT, ROW_ORDER, category_prefixes, file_categories, number_rows, text_schema, with_date_order


def read_stream(spark: SparkSession, folder: str, columns: Sequence[str] = SALES_COLUMNS) -> DataFrame:
    """Rows of CSV files as they arrive, as text, with file name and row order."""
    raw = (
        spark.readStream.schema(text_schema(columns))
        .options(header=True, pathGlobFilter="*.csv", enforceSchema=False, multiLine=True, **DIALECT)
        .csv(folder)
    )
    return raw.filter(F.col("_metadata.file_size") > 0).select(
        *columns,
        category_from_file(F.col("_metadata.file_path")).alias("file_category"),
        F.struct(
            F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p"),
            F.col("_metadata.file_block_start").alias("b"),
        ).alias("place"),
    )


STREAM = "uploads"


def upsert_batch(spark: SparkSession, tables: Tables, festivals: DataFrame | None, batch: DataFrame, batch_id: int, stream: str = STREAM) -> None:
    """One micro-batch, once.

    A batch in the ledger is passed over. One that stopped half way is run again:
    upserts give the same tables, and events and models replace what that batch
    had written. Late corrections always win, so there is no watermark.
    """
    if store.is_done(spark, tables.root, stream, batch_id):
        return
    key = f"{stream}-{batch_id}"
    with scratch(spark):
        skus = tables.read_skus(spark)
        line = F.monotonically_increasing_id()
        rows = cut(batch.select("*", F.struct("place.*", line.alias("i")).alias(ROW_ORDER)).drop("place"))
        changes = cut(clean.clean_sales(number_rows(with_date_order(rows.select(*SALES_COLUMNS, ROW_ORDER))), skus))
        if not changes.isEmpty():
            store.upsert_sales(spark, tables.sales, changes, SALES, is_cut=True)
            store.upsert_months(spark, tables.daily, touched_days(changes, skus, tables.scan_sales(spark)), ["category", "date"], DAILY)
            files = rows.select(F.col(f"{ROW_ORDER}.p").alias("path")).distinct()
            named = file_categories(files, category_prefixes(skus)).select("category").filter("category is not null")
            touched = cut(store.touched_categories(changes, skus, F.current_timestamp()))
            store.append(touched, tables.events, key)
            if festivals is not None:
                refresh = first_changes(changes, skus, touched.select("category").unionByName(named))
                store.save_models(refit(spark, tables, festivals, refresh), tables.models, F.current_timestamp(), key)
        store.mark_done(spark, tables.root, stream, batch_id)


def first_changes(changes: DataFrame, skus: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, first_change): the first day that changed sales touch, null for other categories to be refitted."""
    days = changes.join(skus.select("sku_id", "category"), "sku_id").groupBy("category").agg(F.min("date").alias("first_change"))
    return categories.distinct().join(days, "category", "left")


def refit(spark: SparkSession, tables: Tables, festivals: DataFrame, changed: DataFrame) -> DataFrame:
    """New models for the categories of ``changed`` only, from the sums that are kept of each series.

    Later days are added to the sums; the files of earlier months are read only
    for series that have to be summed anew.
    """
    changed = cut(changed)
    daily = tables.read_daily(spark)
    kinds = moments.schema(daily)
    stored = cut(change_files.rows_of(spark, tables.moments, changed, demand.CATEGORY, kinds))
    since = stored.agg(F.min(F.col("recent")[0]["date"])).first()[0]
    fresh = cut(moments.updated(stored, daily, changed, festivals, recent=tables.read_daily(spark, since)))
    # a series that has no days any more counts as empty, so that later days are not added to what it was
    gone = stored.join(fresh, list(demand.CATEGORY), "left_anti").withColumn("n_samples", F.lit(0).cast("bigint"))
    change_files.upsert(spark, tables.moments, fresh.unionByName(gone), demand.CATEGORY, kinds)
    return model.fit(moments.statistics(fresh))


def start(spark: SparkSession, folder: str, tables: Tables, checkpoint: str, festivals: DataFrame | None = None, stream: str = STREAM, **trigger) -> StreamingQuery:
    """Start the upload stream; the checkpoint makes each file count once, the ledger each batch.

    A stream with a new checkpoint numbers its batches anew and needs a name of its own.
    """
    return (
        read_stream(spark, folder)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, batch_id: upsert_batch(spark, tables, festivals, batch, batch_id, stream))
        .start()
    )
