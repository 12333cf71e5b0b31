"""CSV uploads: reading, kind detection, version gate, archive and bulk load."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from stockcast.functions.text import CATEGORY_PREFIXES, QUICK_YEAR_LAST, YEAR_LAST, file_stem, slug, strip, to_day, to_number
from stockcast.schemas import SALES_COLUMNS, SCHEMA_VERSION, SKU_COLUMNS
from stockcast.session import cut
from stockcast.sources import split_csv

ROW_ORDER = "row_order"
DAY_FIRST = "day_first"


class UploadError(ValueError):
    """An upload that cannot be used as a whole."""


def _tidy_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lstrip("﻿").strip().lower() for name in df.columns])


# quotes are doubled inside quotes, and a backslash is a character like any other
DIALECT = {"quote": '"', "escape": '"'}


def read_upload(
    spark: SparkSession, paths: str | list[str], latest_file_wins: bool = False, multi_line: bool = True
) -> DataFrame:
    """All columns as text, header names trimmed and lower-cased.

    ``row_order`` grows with file name, position of the split in the file and
    line, so "keep last" means what it says although the file is read in
    parallel. With ``latest_file_wins`` the time of a file counts before its
    name (the parts of one written dataset finish in any order, so that is not
    the default). All files of one call must share one header; Spark checks it.
    Quoted fields may hold line breaks. Spark reads a file of such rows in one
    task; files larger than a split are read by ``read_split_upload`` instead.
    Without ``multi_line`` there may be no such line breaks.
    """
    if multi_line and largest_file(spark, paths) > split_bytes(spark):
        return read_split_upload(spark, paths, latest_file_wins)
    try:
        raw = spark.read.options(header=True, enforceSchema=False, multiLine=multi_line, **DIALECT).csv(paths)
    except Exception as exc:
        if "UNABLE_TO_INFER_SCHEMA" in str(exc):
            raise UploadError("Uploaded file is empty") from exc
        raise
    if not raw.columns:
        raise UploadError("Uploaded file is empty")
    ordered = raw.select(
        "*",
        F.struct(
            (F.col("_metadata.file_modification_time") if latest_file_wins else F.lit(None).cast("timestamp")).alias("t"),
            F.col("_metadata.file_path").alias("p"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias(ROW_ORDER),
    )
    return _tidy_header(ordered)


def split_bytes(spark: SparkSession) -> int:
    """What a task reads of a file at most."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def largest_file(spark: SparkSession, paths: str | list[str]) -> int:
    """Bytes of the largest file; the files are listed, not read."""
    try:
        return spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()[0] or 0
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return 0  # told by the reader itself
        raise


def read_split_upload(spark: SparkSession, paths: str | list[str], latest_file_wins: bool = False) -> DataFrame:
    """The same rows in the same order as ``read_upload``, with each file read by as many tasks as it has splits.

    A quote opens a field at its start only; one inside a field that is not
    quoted is a character like any other.
    """
    rows = split_csv.whole_rows(spark, paths, latest_file_wins)
    headers = [r["text"] for r in rows.filter("is_first").select("text").distinct().limit(100).collect()]
    if not headers:
        raise UploadError("Uploaded file is empty")
    fields = split_csv.parsed(split_csv.header_of(headers), DIALECT)
    return _tidy_header(rows.filter(~F.col("is_first")).select(*fields, F.struct("t", "p", "b", "i").alias(ROW_ORDER)))


def date_orders(rows: DataFrame, file: Column, column: str = "date") -> DataFrame:
    """(file, date_order, day_only, month_only): which order of day and month fits all dates of a file.

    ``date_order`` is ``day_first`` or ``month_first`` where a date above the
    12th decides it, ``ambiguous`` where both fit every row, ``mixed`` where
    neither does, and ``none`` where no date has that form.
    """
    first, second = _year_last_numbers(column)
    seen = rows.select(file.alias("file"), first.alias("first"), second.alias("second"))
    # one row per file and pair of numbers leaves a task, whatever the number of its rows
    pairs = seen.groupBy("file", "first", "second").agg(F.lit(1).alias("one"))
    return _orders_of(pairs.groupBy("file").agg(*_order_flags(F.col("first"), F.col("second"))))


def _year_last_numbers(column: str) -> list[Column]:
    """First and second number of a date that ends with its year, else null."""
    raw = F.col(column).cast("string")
    text = strip(raw)

    def number(group: int) -> Column:
        # dates that begin with their year and those of the commonest form are told first, before any is trimmed
        found = F.when((F.length(raw) == 10) & raw.rlike(QUICK_YEAR_LAST), F.substring(raw, 3 * group - 2, 2).cast("int"))
        return F.when(~raw.rlike("^[0-9]{4}"), found.when(text.rlike(YEAR_LAST), F.regexp_extract(text, YEAR_LAST, group).cast("int")))

    return [number(1), number(2)]


def _order_flags(first: Column, second: Column) -> list[Column]:
    """Aggregates: whether some date fits day first only, month first only, both."""
    is_day = (first > 12) & (first <= 31) & second.between(1, 12)
    is_month = (second > 12) & (second <= 31) & first.between(1, 12)
    either = first.between(1, 12) & second.between(1, 12)
    return [F.max(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in (("d", is_day), ("m", is_month), ("e", either))]


def _orders_of(totals: DataFrame) -> DataFrame:
    order = (
        F.when(F.col("d") & F.col("m"), "mixed").when(F.col("d"), "day_first").when(F.col("m"), "month_first")
        .when(F.col("e"), "ambiguous").otherwise("none")
    )
    return totals.select("file", order.alias("date_order"), F.col("d").alias("day_only"), F.col("m").alias("month_only"))


def with_date_order(rows: DataFrame, file: Column | None = None, column: str = "date") -> DataFrame:
    """``rows`` with ``day_first``, the order of their file; an ambiguous or mixed file counts as month first.

    Dates of a mixed file that do not fit are then no dates, and their rows are
    rejected with a reason instead of becoming other months.
    """
    file = F.col(f"{ROW_ORDER}.p") if file is None else file
    orders = date_orders(rows, file, column).select(F.col("file").alias("_file"), (F.col("date_order") == "day_first").alias(DAY_FIRST))
    # one row per file: hashed by file, all rows of one would meet in one task
    return rows.withColumn("_file", file).join(F.broadcast(orders), "_file", "left").drop("_file")


def number_rows(rows: DataFrame) -> DataFrame:
    """``row_order`` as one whole number, so that "keep last" needs no sorting.

    Rows are counted per split of a file; the sums of the counts before a split,
    in the order of the files, make its first number. There are as many splits
    as reading tasks at least, so that table is small.
    """
    return _numbered(rows, _splits_of(rows))


def number_dated_rows(rows: DataFrame, column: str = "date") -> tuple[DataFrame, DataFrame]:
    """``number_rows`` of rows with the order of their file, and the orders as ``date_orders`` has them, from one look at the rows for both."""
    first, second = _year_last_numbers(column)
    splits = cut(_splits_of(rows.withColumns({"_first": first, "_second": second}), *_order_flags(F.col("_first"), F.col("_second"))))
    orders = _orders_of(splits.groupBy(F.col("p").alias("file")).agg(*[F.max(c).alias(c) for c in ("d", "m", "e")]))
    day_first = orders.select(F.col("file").alias("p"), (F.col("date_order") == "day_first").alias(DAY_FIRST))
    return _numbered(rows, splits.join(day_first, "p"), DAY_FIRST), orders


def _splits_of(rows: DataFrame, *more: Column) -> DataFrame:
    """(t, p, b, low, n) and other aggregates of the rows of each split."""
    place = [F.col(f"{ROW_ORDER}.{part}").alias(part) for part in ("t", "p", "b")]
    i = F.col(f"{ROW_ORDER}.i")
    return rows.groupBy(*place).agg(F.min(i).alias("low"), (F.max(i) - F.min(i) + 1).alias("n"), *more)


def _numbered(rows: DataFrame, splits: DataFrame, *names: str) -> DataFrame:
    before = F.coalesce(F.sum("n").over(Window.orderBy("t", "p", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("t", "p", "b", (before - F.col("low")).alias("shift"), *names)
    same = " AND ".join(f"{ROW_ORDER}.{part} <=> s.{part}" for part in ("t", "p", "b"))
    joined = rows.join(F.broadcast(starts).alias("s"), F.expr(same), "left")  # hashed by split, a split's rows would meet in one task
    return joined.select(*[c for c in rows.columns if c != ROW_ORDER], *names, (F.col(f"{ROW_ORDER}.i") + F.col("shift")).alias(ROW_ORDER))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise UploadError("CSV contains no data rows")
    return df


def missing_columns(columns: Iterable[str]) -> dict[str, list[str]]:
    have = set(columns)
    return {
        "sales": sorted(set(SALES_COLUMNS) - have),
        "sku": sorted(set(SKU_COLUMNS) - have),
    }


def detect_kind(columns: Iterable[str]) -> str:
    """``sku`` when all item columns are there (checked first), else ``sales``."""
    missing = missing_columns(columns)
    if not missing["sku"]:
        return "sku"
    if not missing["sales"]:
        return "sales"
    raise UploadError(
        f"Missing required columns for sales: {missing['sales']}; for sku: {missing['sku']}"
    )


def missing_column_arrays(columns: Column) -> tuple[Column, Column]:
    """The same set difference for headers held in an array column."""
    def lacking(required: tuple[str, ...]) -> Column:
        return F.array_sort(F.array_except(F.array(*map(F.lit, required)), columns))

    return lacking(SALES_COLUMNS), lacking(SKU_COLUMNS)


def is_wrong_version(column: Column) -> Column:
    """Whether a non-blank version differs; more zeros may follow, so ``1.00`` counts as ``1.0``, but ``1`` does not."""
    version = strip(column)
    return version.isNotNull() & (version != "") & ~version.rlike(f"^{re.escape(SCHEMA_VERSION)}0*$")


def wrong_version(df: DataFrame, column: str = "schema_version") -> DataFrame:
    return df.filter(is_wrong_version(F.col(column)))


def check_version(df: DataFrame) -> DataFrame:
    if "schema_version" in df.columns and not wrong_version(df).isEmpty():
        raise UploadError(f"Expected schema_version '{SCHEMA_VERSION}'")
    return df


def accept(df: DataFrame) -> tuple[str, DataFrame]:
    """Kind of an upload and its rows, after the checks on the file as a whole."""
    data = df.drop(ROW_ORDER)
    kind = detect_kind(data.columns)
    check_version(require_rows(df))
    return kind, df


def archive_rows(df: DataFrame, kind: str, file_name: str, as_of: Column) -> DataFrame:
    """Raw rows in archive form: one JSON text per row under a stable archive name."""
    data = [c for c in df.columns if c != ROW_ORDER]
    stamp = F.date_format(as_of, "yyyyMMdd'T'HHmmss'Z'")
    name = F.concat(F.lit("uploads/"), slug(F.lit(kind)), F.lit("/"), stamp, F.lit("_"), slug(F.lit(file_name)), F.lit(".csv"))
    return df.select(
        F.to_json(F.struct(*data)).alias("raw"),
        name.alias("archive_name"),
        F.lit(kind).alias("kind"),
        F.to_date(as_of).alias("ingest_date"),
    )


def write_archive(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("kind", "ingest_date").parquet(path)


def bulk_skus(df: DataFrame) -> DataFrame:
    """Item rows of a trusted file: typed, not validated."""
    return df.select(
        "sku_id", "product_name", "category",
        to_number(F.col("mrp")).alias("mrp"),
        to_number(F.col("cost")).alias("cost"),
        to_number(F.col("current_inventory")).cast("int").alias("current_inventory"),
        *([ROW_ORDER] if ROW_ORDER in df.columns else []),
    )


def bulk_sales(df: DataFrame) -> DataFrame:
    """Sales rows of a trusted file: nulls dropped, unreadable units become 0."""
    return df.select(
        to_day(F.col("date")).alias("date"),
        "sku_id",
        F.when(F.col("units_sold").isNotNull(), F.coalesce(to_number(F.col("units_sold")), F.lit(0.0)))
        .cast("bigint")
        .alias("units_sold"),
        *([ROW_ORDER] if ROW_ORDER in df.columns else []),
    ).na.drop(subset=["date", "sku_id", "units_sold"])


def text_schema(columns: Iterable[str]) -> str:
    return ", ".join(f"{c} string" for c in columns)


# --- category of a file ------------------------------------------------------

def category_prefixes(skus: DataFrame) -> DataFrame:
    """(prefix, category): how file names of a category may start, from the items' categories and the fixed prefixes.

    ``Edible Oil`` is written with its blank, ``_``, ``-`` or nothing between
    the words. A prefix of two categories is the first one's by name.
    """
    spark = skus.sparkSession
    plain = F.lower("category")
    forms = F.array(plain, *[F.regexp_replace(plain, r"\s+", mark) for mark in ("_", "-", "")])
    known = skus.select(strip(F.col("category")).alias("category")).filter("category <> ''").distinct()
    made = known.select(F.explode(F.array_distinct(forms)).alias("prefix"), "category")
    fixed = spark.createDataFrame(list(CATEGORY_PREFIXES.items()), "prefix string, category string")
    return made.unionByName(fixed).groupBy("prefix").agg(F.min("category").alias("category"))


def file_categories(files: DataFrame, prefixes: DataFrame, path: str = "path") -> DataFrame:
    """(path, category) per distinct path: the category of the longest prefix its file name starts with, or null.

    The starts of each name that are as long as some prefix are exploded and
    joined by equality. Both tables may be of any size, and a small file may hold
    many of them, so neither is broadcast; names without a hit stay in the join.
    """
    names = files.select(F.col(path).alias("path")).distinct().withColumn("stem", file_stem(F.col("path")))
    # as many numbers as there are lengths of prefixes, whatever the number of prefixes
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct().agg(F.collect_list("n")).scalar()
    starts = names.select("path", "stem", F.explode(F.array_union(F.array(F.lit(0)), lengths)).alias("length"))
    starts = starts.filter((F.col("length") == 0) | (F.col("length") <= F.length("stem")))
    # the start of no letters keeps each name; a key of its own, as no file name holds a slash, keeps it out of a common task
    key = F.when(F.col("length") == 0, F.concat(F.lit("/"), "path")).otherwise(F.substring("stem", F.lit(1), F.col("length")))
    known = prefixes.filter(~F.contains("prefix", F.lit("/"))).select("prefix", "category")
    hits = starts.select("path", "length", key.alias("prefix")).join(known.hint("merge"), "prefix", "left")
    return hits.groupBy("path").agg(F.max_by("category", F.when(F.col("category").isNotNull(), F.col("length"))).alias("category"))
