"""Parquet tables: upserts, scans, model store, forecast cache and audit log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from stockcast.functions.numbers import py_round
from stockcast.functions.text import params_hash, strip
from stockcast.operators.keep import keep_last
from stockcast.session import cut
from stockcast.sources import shared

MANIFESTS = "_published"
ATTEMPTS = 10
BATCH = "batch_key"
MONTH = "sales_month"


# --- upserts ---------------------------------------------------------------

def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``changes`` added or replaced by key.

    ``changes`` must hold one row per key. Both sides are hashed on the key
    once; Spark broadcasts the changed keys instead when they are few.
    """
    kept = target.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes.select(*target.columns))


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.parquet(path).drop(BATCH)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table whose columns are only known once it has been written."""
    table = read_or_empty(spark, path, "missing boolean")
    return None if table.columns == ["missing"] else table


class SnapshotConflict(RuntimeError):
    """Another writer published first; the change has to be made on its snapshot."""


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest published snapshot of a dimension table; what is not published is never read."""
    newest = published(spark, path)
    return spark.createDataFrame([], schema) if newest is None else spark.read.parquet(f"{path}/{newest[1]}")


def published(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the newest snapshot. An empty manifest is one whose writer died; it counts as not published."""
    for number in sorted(shared.numbered(spark, f"{path}/{MANIFESTS}"), reverse=True):
        folder = shared.read_text(spark, _manifest(path, number))
        if folder.endswith("\n"):
            return number, folder.strip()
    return None


def _manifest(path: str, number: int) -> str:
    return f"{path}/{MANIFESTS}/{number:012d}"


def write_snapshot(spark: SparkSession, path: str, rows: DataFrame, based_on: int | None = None) -> int:
    """Write a complete new snapshot, then publish it; returns its number.

    The rows go to a folder of their own. The snapshot exists once its manifest
    does, which is created only if that number is free: of two writers who build
    on the same snapshot one gets ``SnapshotConflict``. ``based_on`` is the
    number the rows were made from, by default the newest one.
    """
    taken = shared.numbered(spark, f"{path}/{MANIFESTS}")
    if based_on is None:
        based_on = (published(spark, path) or (-1, ""))[0]
    folder = f"snapshot-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    later = [n for n in taken if n > based_on]  # left empty by writers who died
    number = max([based_on, *later]) + 1
    if (published(spark, path) or (-1, ""))[0] != based_on or not shared.create(spark, _manifest(path, number), folder + "\n"):
        shared.remove(spark, f"{path}/{folder}")
        raise SnapshotConflict(f"a snapshot after {based_on} was published meanwhile")
    return number


def expire_snapshots(spark: SparkSession, path: str, keep: int = 3, older_than_seconds: int = 86_400) -> int:
    """Remove all but the newest ``keep`` snapshots, and unpublished folders of some age; returns how many folders went.

    A reader may still be on an expired snapshot, and a writer on an unpublished
    one, so only folders older than ``older_than_seconds`` go.
    """
    numbers = sorted(shared.numbered(spark, f"{path}/{MANIFESTS}"))
    folders = {n: shared.read_text(spark, _manifest(path, n)).strip() for n in numbers}
    live = [n for n in numbers if folders[n]][-max(1, keep):]
    kept, gone = {folders[n] for n in live}, 0
    for name, age in shared.folders(spark, path):
        if name.startswith("snapshot-") and name not in kept and age >= older_than_seconds:
            shared.remove(spark, f"{path}/{name}")
            gone += 1
    for n in numbers:
        if live and n < live[0]:
            shared.remove(spark, _manifest(path, n))
    return gone


def upsert_skus(spark: SparkSession, path: str, changes: DataFrame, schema) -> None:
    """Publish the table with the changes; if another writer was first, merge into what it published."""
    for _ in range(ATTEMPTS):
        newest = published(spark, path)
        current = spark.createDataFrame([], schema) if newest is None else spark.read.parquet(f"{path}/{newest[1]}")
        try:
            write_snapshot(spark, path, upsert(current, changes, ["sku_id"]), -1 if newest is None else newest[0])
            return
        except SnapshotConflict:
            continue
    raise SnapshotConflict(f"{ATTEMPTS} attempts met other writers")


def with_month(sales: DataFrame) -> DataFrame:
    return sales.withColumn(MONTH, F.date_format("date", "yyyy-MM"))


def upsert_months(
    spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], schema, is_cut: bool = False
) -> None:
    """Replace only the months the changes touch in a table with a date column.

    The list of months is bounded by the calendar. Other months are neither
    read nor rewritten. ``changes`` is needed for the list and for the merge, so
    it is cut first unless the caller has done so.
    """
    fresh = with_month(changes) if is_cut else cut(with_month(changes))
    months = [r[0] for r in fresh.select(MONTH).distinct().collect()]
    table = read_or_empty(spark, path, schema)
    if MONTH in table.columns:
        old = table.withColumn(MONTH, F.col(MONTH).cast("string")).filter(F.col(MONTH).isin(months))
        merged = upsert(old.select(*fresh.columns), fresh, keys)
    else:
        merged = fresh
    # few files per month, while a month with very many rows is still split
    (
        merged.hint("rebalance", F.col(MONTH)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )


def upsert_sales(spark: SparkSession, path: str, changes: DataFrame, schema, is_cut: bool = False) -> None:
    upsert_months(spark, path, changes, ["date", "sku_id"], schema, is_cut)


def touched_categories(changes: DataFrame, skus: DataFrame, uploaded_at: Column) -> DataFrame:
    """Upload-event rows: each category an upload touches, once."""
    if "category" in changes.columns:
        categories = changes.select(strip(F.col("category")).alias("category")).filter("category <> ''")
    else:
        categories = skus.join(changes.select("sku_id").distinct(), "sku_id", "left_semi").select("category")
    return categories.distinct().withColumn("uploaded_at", uploaded_at)


def stamp_items(skus: DataFrame, changes: DataFrame, uploaded_at: Column) -> DataFrame:
    """The item-level form of the log: each touched item with its upload time."""
    return skus.join(changes.select("sku_id").distinct(), "sku_id", "left_semi").withColumn(
        "last_upload_timestamp", uploaded_at
    )


def append(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Add rows under the key of their batch. Adding a batch again replaces its own rows, so a replay adds nothing."""
    key = f"once-{uuid.uuid4().hex}" if batch is None else f"batch-{batch}"
    rows.withColumn(BATCH, F.lit(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def is_done(spark: SparkSession, root: str, stream: str, batch_id: int) -> bool:
    return shared.exists(spark, f"{root}/_ledger/{stream}/{batch_id}")


def mark_done(spark: SparkSession, root: str, stream: str, batch_id: int) -> None:
    """Enter a batch in the ledger once all its tables are written."""
    shared.create(spark, f"{root}/_ledger/{stream}/{batch_id}", "done\n")


# --- scans -----------------------------------------------------------------

def by_category(skus: DataFrame, category: str) -> DataFrame:
    return skus.filter(F.col("category") == category)


def page(skus: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page by sku_id with the total row count beside it."""
    total = skus.agg(F.count("*")).scalar()
    return skus.orderBy("sku_id").offset(offset).limit(limit).withColumn("total", total)


def page_after(skus: DataFrame, last_seen: str, limit: int) -> DataFrame:
    """The page after a known id: the filter prunes, however deep the page lies."""
    return skus.filter(F.col("sku_id") > last_seen).orderBy("sku_id").limit(limit)


def counts(sales: DataFrame, festivals: DataFrame, skus: DataFrame) -> DataFrame:
    named = [("sales", sales), ("festivals", festivals), ("skus", skus)]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def categories(skus: DataFrame) -> DataFrame:
    """All distinct non-blank categories, sorted."""
    return skus.select(strip(F.col("category")).alias("category")).filter("category <> ''").distinct().orderBy("category")


# --- model store -----------------------------------------------------------

def save_models(params: DataFrame, path: str, trained_at: Column, batch: str | None = None) -> None:
    append(params.withColumn("trained_at", trained_at), path, batch)


def latest_models(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keep_last(models, keys, "trained_at")


def fresh_models(models: DataFrame, last_uploads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest models that are not older than the last upload of their series."""
    joined = latest_models(models, keys).join(last_uploads, list(keys), "left")
    return joined.filter(F.col("last_upload").isNull() | (F.col("trained_at") >= F.col("last_upload"))).drop("last_upload")


def model_versions(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored versions, newest first, with their size in coefficients."""
    return models.select(*keys, "trained_at", F.size("coef").alias("n_coefficients"), "n_samples").orderBy(
        F.desc("trained_at"), *keys
    )


# --- forecast cache and audit log ------------------------------------------

def payloads(forecast: DataFrame, decisions: DataFrame, params: DataFrame, warnings: DataFrame, n_days: int) -> DataFrame:
    """One record per series with forecast points, decision and warnings.

    A horizon has at most a year of points, so the array stays small.
    """
    point = F.struct(
        "day_index",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "predicted_mean", "lower_95", "upper_95", "festival_score", "confidence_level",
    )
    points = forecast.groupBy("category").agg(F.array_sort(F.collect_list(point)).alias("points"))
    decision = F.struct(
        "recommended_action", "order_quantity", "reorder_point", "safety_stock", "risk_score",
        "festival_buffer_applied", "data_stale_warning", "pack_size_applied",
    )
    return (
        points.join(decisions.select("category", decision.alias("decision")), "category")
        .join(warnings.select("category", "warnings"), "category")
        .join(params, "category")
        .select(
            "category",
            F.transform("points", lambda p: p.dropFields("day_index")).alias("forecast"),
            "decision",
            "warnings",
            F.lit(n_days).alias("n_days"),
            "current_inventory", "lead_time_days",
            F.greatest(F.lit(1), F.col("supplier_pack_size")).alias("supplier_pack_size"),
        )
    )


def cache_rows(payload: DataFrame, generated_at: Column) -> DataFrame:
    columns = [F.col(c) for c in ("n_days", "current_inventory", "lead_time_days", "supplier_pack_size")]
    return payload.select(
        "category",
        generated_at.alias("generated_at"),
        params_hash(*columns).alias("params_hash"),
        *columns,
        F.to_json(F.struct(*payload.columns)).alias("payload_json"),
    )


def log_rows(rows: DataFrame, timestamp: Column) -> DataFrame:
    """Audit-log rows from (category, risk_score, insight)."""
    return rows.select(
        "category", timestamp.alias("timestamp"), py_round(F.col("risk_score"), 3).alias("risk_score"), "insight"
    )


def decision_log(payload: DataFrame, timestamp: Column) -> DataFrame:
    record = F.to_json(
        F.struct(F.lit("forecast_decision").alias("type"), "category", "decision", "n_days", "warnings")
    )
    rows = payload.select("category", F.col("decision.risk_score").alias("risk_score"), record.alias("insight"))
    return log_rows(rows, timestamp)


def recent_recommendations(log: DataFrame, limit: int = 10) -> DataFrame:
    """Newest log entries with action and quantity read from their JSON text."""
    action = F.coalesce(F.get_json_object("insight", "$.decision.recommended_action"), F.lit("n/a"))
    quantity = F.get_json_object("insight", "$.decision.order_quantity").try_cast("int")
    return (
        log.orderBy(F.desc("timestamp"), "category", "risk_score", "insight")
        .limit(max(1, limit))
        .select("timestamp", "category", action.alias("action"), F.coalesce(quantity, F.lit(0)).alias("order_quantity"), "risk_score")
    )


def last_uploads(events: DataFrame) -> DataFrame:
    return events.groupBy("category").agg(F.max("uploaded_at").alias("last_upload"))


def within_age(column: str, as_of: Column, max_age_seconds: int) -> Column:
    return F.col(column) >= as_of - F.expr(f"INTERVAL {max_age_seconds} SECONDS")
