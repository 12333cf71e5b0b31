"""Uploads of any kind as a stream: each file is judged by itself, items are taken in before sales.

Files arrive as lines, so a large one is read by many tasks even if its quoted
fields hold line breaks. Headers may differ from file to file. A micro-batch finds
the kind of each file, turns away those it cannot use, archives the others line by
line, and keeps the rows that break a rule beside the rules they broke.

What is turned away does not stop the rest: ``Tables.files`` has one row per file
with its kind, status and reason, ``Tables.rejects`` one per rejected row. A file
without any line leaves no trace.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stockcast.functions.text import strip
from stockcast.operators import clean, moments
from stockcast.plans.ingest import Tables, moved_items, refresh_categories, touched_days
from stockcast.schemas import DAILY, SALES, SALES_COLUMNS, SCHEMA_VERSION, SKU_COLUMNS, SKUS
from stockcast.session import cut, scratch
from stockcast.sources import shared, split_csv, store, upload
from stockcast.sources.upload import ROW_ORDER
from stockcast.streaming.uploads import first_changes, refit

STREAM = "mixed-uploads"
VERSION = "schema_version"
COLUMNS = tuple(dict.fromkeys([*SALES_COLUMNS, *SKU_COLUMNS]))
NO_ROWS = "CSV contains no data rows"
NONE_VALID = {"sku": "No valid SKU rows found after validation", "sales": "No valid Sales rows found after validation"}
NONE_KNOWN = "No valid Sales rows reference known SKU IDs"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(t, p, b, value): lines of CSV files as they arrive, with time, path and split of their file."""
    lines = spark.readStream.options(lineSep="\n", pathGlobFilter="*.csv").text(folder)
    return lines.select(
        F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p"),
        F.col("_metadata.file_block_start").alias("b"), "value",
    )


def headers(rows: DataFrame) -> DataFrame:
    """(path, header, kind): the column names of each file, trimmed and lower-cased, and what they make it."""
    names = split_csv.fields(F.regexp_replace("text", "^\ufeff", ""))
    tidy = F.transform(names, lambda name: F.lower(strip(F.coalesce(name, F.lit("")))))
    heads = rows.filter("is_first").select(F.col("p").alias("path"), tidy.alias("header"))
    lacks_sales, lacks_sku = upload.missing_column_arrays(F.col("header"))
    return heads.withColumn("kind", F.when(F.size(lacks_sku) == 0, "sku").when(F.size(lacks_sales) == 0, "sales"))


def fields_by_name(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Data rows of all files with the columns either kind needs, as text; null where a file or row lacks one."""
    parts = rows.filter(~F.col("is_first")).select(
        F.col("p").alias("path"), F.struct("t", "p", "b", "i").alias(ROW_ORDER), F.col("text").alias("line"), split_csv.fields(F.col("text")).alias("fields")
    )

    names = [*COLUMNS, VERSION]
    places = F.struct(*[(F.array_position("header", F.lit(name)).cast("int") - 1).alias(name) for name in names]).alias("at")
    # one row per file: hashed by file, all rows of one would meet in one task
    joined = parts.join(F.broadcast(heads.select("path", "kind", places)), "path")
    return joined.select("path", "kind", ROW_ORDER, "line", *[F.get("fields", F.col(f"at.{name}")).alias(name) for name in names])


def judged(heads: DataFrame, data: DataFrame) -> DataFrame:
    """(path, kind, n_rows, reason): why a file as a whole cannot be used, null if it can."""
    def listed(names: Column) -> Column:
        return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))

    lacks_sales, lacks_sku = upload.missing_column_arrays(F.col("header"))
    lacking = F.concat(F.lit("Missing required columns for sales: "), listed(lacks_sales), F.lit("; for sku: "), listed(lacks_sku))
    counted = data.groupBy("path").agg(F.count("*").alias("n_rows"), F.bool_or(upload.is_wrong_version(F.col(VERSION))).alias("wrong"))
    reason = (
        F.when(F.col("kind").isNull(), lacking).when(F.col("n_rows").isNull(), NO_ROWS)
        .when(F.col("wrong"), f"Expected schema_version '{SCHEMA_VERSION}'")
    )
    return heads.join(counted, "path", "left").select("path", "kind", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), reason.alias("reason"))


def archived_lines(rows: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """Rows of usable files as they came, the header among them, with what puts them in order again."""
    kept = files.filter("reason IS NULL").select(F.col("path").alias("p"), "kind")
    return rows.join(kept, "p").select(
        F.col("p").alias("path"), "kind", F.col("b").alias("split"), F.col("i").alias("line_number"), "text", as_of.alias("archived_at")
    )


def archived_file(lines: DataFrame, path: str) -> DataFrame:
    """The rows of one archived file in their order; blank lines are not kept, and each row ends where it ended."""
    return lines.filter(F.col("path") == path).orderBy("split", "line_number").select("text")


def results(files: DataFrame, rejects: DataFrame) -> DataFrame:
    """``files`` with the number of rejected rows and a status; a file of which no row is left counts as rejected."""
    counts = rejects.groupBy("path").agg(F.count("*").alias("n_rejected"), F.bool_or(F.array_contains("failed_rules", "unknown_sku")).alias("unknown"))
    joined = files.join(counts, "path", "left").withColumn("n_rejected", F.coalesce("n_rejected", F.lit(0)))
    none = F.when(F.col("unknown"), NONE_KNOWN).when(F.col("kind") == "sku", NONE_VALID["sku"]).otherwise(NONE_VALID["sales"])
    reason = F.coalesce("reason", F.when(F.col("n_rejected") >= F.col("n_rows"), none))
    return joined.select("path", "kind", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"), "n_rows", "n_rejected")


def take_items(spark: SparkSession, tables: Tables, rows: DataFrame, key: str) -> DataFrame:
    """Item rows into the item master; daily totals follow items that change their category. Returns the items taken.

    Which categories those are can only be told before the items are published,
    so it is written down first: a batch that stops in between finds it when it
    runs again.
    """
    changes = cut(clean.clean_skus(upload.number_rows(rows.select(*SKU_COLUMNS, ROW_ORDER))))
    if not changes.isEmpty():
        noted = f"{tables.root}/_moved/{key}"
        if not shared.exists(spark, f"{noted}/_SUCCESS"):
            moved_items(tables.read_skus(spark), changes).write.mode("overwrite").parquet(noted)
        store.upsert_skus(spark, tables.skus, changes, SKUS)
        refresh_categories(spark, tables, spark.read.schema("category string").parquet(noted))
    return changes


def take_sales(spark: SparkSession, tables: Tables, rows: DataFrame, skus: DataFrame) -> DataFrame:
    """Typed sales rows that break no rule into the sales and the daily totals. Returns the rows taken."""
    changes = cut(clean.last_sales(upload.number_rows(rows.select(*SALES_COLUMNS, ROW_ORDER)), skus))
    if not changes.isEmpty():
        store.upsert_sales(spark, tables.sales, changes, SALES, is_cut=True)
        store.upsert_months(spark, tables.daily, touched_days(changes, skus, tables.scan_sales(spark)), ["category", "date"], DAILY)
    return changes


def take_batch(spark: SparkSession, tables: Tables, festivals: DataFrame | None, batch: DataFrame, batch_id: int, stream: str = STREAM) -> None:
    """One micro-batch of lines, once; items of the batch are known to all sales of the batch, whichever file came first."""
    if store.is_done(spark, tables.root, stream, batch_id):
        return
    key = f"{stream}-{batch_id}"
    with scratch(spark):
        rows = cut(split_csv.rows_of(split_csv.marked_lines(batch)))
        heads = headers(rows)
        data = cut(fields_by_name(rows, heads))
        files = cut(judged(heads, data))
        store.append(archived_lines(rows, files, F.current_timestamp()), tables.archived_lines, key)
        usable = data.join(files.filter("reason IS NULL").select("path"), "path", "left_semi")
        items = usable.filter("kind = 'sku'")
        # each file's dates in its own order; typed and judged once for all that follows
        dated = upload.with_date_order(usable.filter("kind = 'sales'"), F.col("path"))
        sales = cut(clean.with_failures(dated, "sales", "path", "line", ROW_ORDER))

        new_items = take_items(spark, tables, items, key)
        skus = tables.read_skus(spark)
        new_sales = take_sales(spark, tables, clean.valid(sales), skus)

        about = ("path", "line", "failed_rules")
        unknown = clean.unknown_items(clean.valid(sales), skus).withColumn("failed_rules", F.array(F.lit("unknown_sku")))
        broken = [clean.quarantine(items, "sku", "path", "line"), clean.rejected(sales)]
        rejects = cut(reduce(DataFrame.unionByName, [part.select(*about) for part in (*broken, unknown)]))
        store.append(rejects, tables.rejects, key)
        store.append(results(files, rejects), tables.files, key)

        both = new_items.select("category").unionByName(store.touched_categories(new_sales, skus, F.current_timestamp()).select("category"))
        touched = cut(store.touched_categories(both, skus, F.current_timestamp()))
        store.append(touched, tables.events, key)
        if festivals is not None:
            named = upload.file_categories(files.filter("kind = 'sales' AND reason IS NULL"), upload.category_prefixes(skus))
            moved = spark.read.schema("category string").parquet(f"{tables.root}/_moved/{key}") if not new_items.isEmpty() else touched.select("category").limit(0)
            named = named.select("category").filter("category IS NOT NULL").unionByName(moved)
            refresh = first_changes(new_sales, skus, touched.select("category").unionByName(named)).join(moved.withColumn("moved", F.lit(True)), "category", "left")
            refresh = refresh.select("category", F.when(F.col("moved"), F.to_date(F.lit(moments.FROM_THE_START))).otherwise(F.col("first_change")).alias("first_change"))
            store.save_models(refit(spark, tables, festivals, refresh), tables.models, F.current_timestamp(), key)
        store.mark_done(spark, tables.root, stream, batch_id)


def start(spark: SparkSession, folder: str, tables: Tables, checkpoint: str, festivals: DataFrame | None = None, stream: str = STREAM, **trigger) -> StreamingQuery:
    """Start the stream; a stream with a new checkpoint needs a name of its own, as its batches are numbered anew."""
    return (
        read_lines(spark, folder)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, batch_id: take_batch(spark, tables, festivals, batch, batch_id, stream))
        .start()
    )
