"""Upload to tables: read, clean, upsert, log the touched categories."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stockcast.operators import clean, demand
from stockcast.schemas import DAILY, SALES, SALES_COLUMNS, SKUS
from stockcast.session import cut, scratch
from stockcast.sources import store, upload


@dataclass(frozen=True)
class Tables:
    """Paths of the tables under one root."""

    root: str

    @property
    def skus(self) -> str:
        return f"{self.root}/skus"

    @property
    def sales(self) -> str:
        return f"{self.root}/sales"

    @property
    def daily(self) -> str:
        return f"{self.root}/daily_demand"

    @property
    def events(self) -> str:
        return f"{self.root}/upload_events"

    @property
    def archive(self) -> str:
        return f"{self.root}/archive"

    @property
    def models(self) -> str:
        return f"{self.root}/model_params"

    @property
    def moments(self) -> str:
        return f"{self.root}/series_moments"

    @property
    def cache(self) -> str:
        return f"{self.root}/forecast_cache"

    @property
    def log(self) -> str:
        return f"{self.root}/recommendations"

    @property
    def archived_lines(self) -> str:
        return f"{self.root}/archived_lines"

    @property
    def files(self) -> str:
        return f"{self.root}/upload_files"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejected_rows"

    def read_skus(self, spark: SparkSession) -> DataFrame:
        return store.read_snapshot(spark, self.skus, SKUS)

    def scan_sales(self, spark: SparkSession) -> DataFrame:
        """Sales with their month, by which the files are laid out."""
        table = store.read_or_empty(spark, self.sales, store.with_month(spark.createDataFrame([], SALES)).schema)
        return table.withColumn(store.MONTH, F.col(store.MONTH).cast("string"))

    def read_sales(self, spark: SparkSession) -> DataFrame:
        return store.read_or_empty(spark, self.sales, SALES).select("date", "sku_id", "units_sold")

    def read_daily(self, spark: SparkSession, since: date | None = None) -> DataFrame:
        """Daily totals; months that end before ``since`` are not read."""
        table = store.read_or_empty(spark, self.daily, DAILY)
        if since is not None and store.MONTH in table.columns:
            table = table.filter(F.col(store.MONTH).cast("string") >= f"{since:%Y-%m}")
        return table.select("category", "date", "units_sold")


def ingest(
    spark: SparkSession, tables: Tables, raw: DataFrame, as_of: Column, file_name: str = "upload", archive: bool = True
) -> tuple[str, DataFrame]:
    """Take in one upload; returns its kind and the metrics row.

    The file is read once: its rows are cut to the shared folder before any
    check, as the file order they carry must be the same for the rows kept and
    for the metrics. What was cut is removed when the tables are written. An
    archive that fails is told in ``archive_error`` and does not stop the upload.
    """
    with scratch(spark):
        upload.detect_kind([c for c in raw.columns if c != upload.ROW_ORDER])
        kind, staged = upload.accept(cut(raw))
        ordered = isinstance(staged.schema[upload.ROW_ORDER].dataType, StructType)
        orders = None
        if ordered and kind == "sales":
            rows, orders = upload.number_dated_rows(staged)
        else:
            rows = upload.number_rows(staged) if ordered else staged
        error = archived(staged, kind, file_name, as_of, tables.archive) if archive else None
        skus = tables.read_skus(spark)
        if kind == "sku":
            changes = clean.require_valid(cut(clean.clean_skus(rows)), "No valid SKU rows found after validation")
            metrics = clean.ingestion_metrics(rows, kind)
            moved = cut(moved_items(skus, changes))
            store.upsert_skus(spark, tables.skus, changes, SKUS)
            refresh_categories(spark, tables, moved)
        else:
            # rows are typed and counted once: the keys of the upload are all that the tables and the metrics need
            keys = cut(clean.with_items(clean.rows_per_key(rows, kind), skus))
            dated = clean.require_valid(clean.sales_of(keys), "No valid Sales rows reference known SKU IDs")
            changes = dated.select(*SALES_COLUMNS)
            metrics = clean.metrics_of(keys, kind)
            store.upsert_sales(spark, tables.sales, changes, SALES, is_cut=True)
            store.upsert_months(spark, tables.daily, touched_days(dated, skus, tables.scan_sales(spark)), ["category", "date"], DAILY)
        touched = store.touched_categories(changes, skus, as_of) if kind == "sku" else dated.select("category").distinct().withColumn("uploaded_at", as_of)
        store.append(touched, tables.events)
        metrics = metrics.withColumn("archive_error", F.lit(error).cast("string"))
        unclear = F.lit(0).cast("bigint") if orders is None else orders.filter("date_order IN ('ambiguous', 'mixed')").agg(F.count("*")).scalar()
        metrics = metrics.withColumn("files_of_unclear_date_order", unclear)
        return kind, spark.createDataFrame(metrics.collect(), metrics.schema)  # one row


def archived(rows: DataFrame, kind: str, file_name: str, as_of: Column, path: str) -> str | None:
    """Write the archive; the reason if that fails."""
    try:
        upload.write_archive(upload.archive_rows(rows, kind, file_name, as_of), path)
    except (PySparkException, OSError) as exc:
        return str(exc).splitlines()[0]
    return None


def touched_days(changes: DataFrame, skus: DataFrame, sales: DataFrame) -> DataFrame:
    """New daily totals of the (category, date) pairs that changed sales touch.

    ``sales`` has its month column: the join on it prunes the months read.
    ``changes`` may have the categories of their items.
    """
    named = changes if "category" in changes.columns else changes.join(skus.select("sku_id", "category"), "sku_id")
    pairs = named.select("category", "date").distinct()
    days = store.with_month(changes.select("date").distinct())
    sales = sales if store.MONTH in sales.columns else store.with_month(sales)
    current = demand.daily_demand(sales.join(days, [store.MONTH, "date"], "left_semi"), skus)
    return current.join(pairs, ["category", "date"], "left_semi")


def moved_items(skus: DataFrame, changes: DataFrame) -> DataFrame:
    """Categories that lose or gain an item by an upload of items."""
    new = changes.select("sku_id", F.col("category").alias("new_category"))
    moved = skus.select("sku_id", "category").join(new, "sku_id").filter("category <> new_category")
    return moved.select(F.explode(F.array("category", "new_category")).alias("category")).distinct()


def refresh_categories(spark: SparkSession, tables: Tables, categories: DataFrame) -> None:
    """Daily totals of some categories worked out anew.

    Months are replaced one by one, and a month keeps a row of some category as
    long as it has sales, so a run that stops half way leaves whole months, old
    or new, and running it again gives the same table.
    """
    if categories.isEmpty():
        return
    skus = tables.read_skus(spark).join(categories, "category", "left_semi")
    totals = demand.daily_demand(tables.read_sales(spark), skus)
    others = tables.read_daily(spark).join(categories, "category", "left_anti")
    fresh = store.with_month(cut(others.unionByName(totals.select(*others.columns))))
    (
        fresh.hint("rebalance", F.col(store.MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(store.MONTH).parquet(tables.daily)
    )
