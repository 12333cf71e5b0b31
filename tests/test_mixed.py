"""Files of any kind through one stream."""

import codecs
import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockcast.operators import demand, moments
from stockcast.plans.ingest import Tables
from stockcast.sources import changes, split_csv, store
from stockcast.streaming import mixed

ITEMS = "current_inventory,SKU_ID, product_name ,category,mrp,cost,note"
FILES = {
    # a mark before the header, another order of columns, a column of its own, line breaks in a field, and one row that breaks two rules
    "items.csv": f'{ITEMS}\n5,a,"Rice, ""long""\nand white",Staples,2,1,x\n7,b,Chips,Snacks,3,1,\n-1,c,Cola,Drinks,1,2,\n',
    # days first: 13 to 31 say so, and 2 January is no 1 February
    "sales_in.csv": "date,sku_id,units_sold,schema_version\n13/01/2026,A,4,1.0\n02/01/2026,A,5,\n02/01/2026,b,6,1.00\n02/01/2026,ZZ,9,1.0\n02/01/2026,b,x,1.0\n",
    "sales_us.csv": 'units_sold,"date",sku_id\n8,01/14/2026,A\n',
    "old.csv": "date,sku_id,units_sold,schema_version\n2026-01-01,A,1,1.0\n2026-01-02,A,1,0.9\n",
    "other.csv": "date,units\n2026-01-01,1\n",
    "head.csv": "date,sku_id,units_sold\n",
    "strangers.csv": "date,sku_id,units_sold\n2026-01-01,YY,1\n",
    "broken.csv": "date,sku_id,units_sold\nsoon,A,1\n",
    "zero.csv": "",
}


@pytest.fixture
def folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in FILES.items():
        (folder / name).write_bytes((codecs.BOM_UTF8 if name == "items.csv" else b"") + text.encode())
    return folder


def run(spark, folder, tables, tmp_path, festivals=None):
    mixed.start(spark, str(folder), tables, str(tmp_path / "cp"), festivals).awaitTermination()


def state(spark, tables):
    names = ("events", "files", "rejects", "archived_lines", "daily", "sales")
    found = {n: spark.read.parquet(getattr(tables, n)) for n in names}
    found["skus"] = tables.read_skus(spark)
    clock = ("uploaded_at", "archived_at")
    return {n: sorted(str(r) for r in df.drop(*clock).collect()) for n, df in found.items()}


def test_files_of_any_kind(spark, tmp_path, folder):
    tables = Tables(str(tmp_path / "tables"))
    run(spark, folder, tables, tmp_path)

    items = {r["sku_id"]: (r["product_name"], r["category"], r["current_inventory"]) for r in tables.read_skus(spark).collect()}
    assert items == {"A": ('Rice, "long"and white', "Staples", 5), "B": ("Chips", "Snacks", 7)}
    sales = {(r["date"], r["sku_id"]): r["units_sold"] for r in tables.read_sales(spark).collect()}
    assert sales == {(dt.date(2026, 1, 13), "A"): 4, (dt.date(2026, 1, 2), "A"): 5, (dt.date(2026, 1, 2), "B"): 6, (dt.date(2026, 1, 14), "A"): 8}

    files = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:6] for r in spark.read.parquet(tables.files).collect()}
    lacking = "Missing required columns for sales: ['sku_id', 'units_sold']; for sku: ['category', 'cost', 'current_inventory', 'mrp', 'product_name', 'sku_id']"
    assert files == {
        "items.csv": ("sku", "accepted", None, 3, 1), "sales_in.csv": ("sales", "accepted", None, 5, 2), "sales_us.csv": ("sales", "accepted", None, 1, 0),
        "old.csv": ("sales", "rejected", "Expected schema_version '1.0'", 2, 0), "other.csv": (None, "rejected", lacking, 1, 0),
        "head.csv": ("sales", "rejected", "CSV contains no data rows", 0, 0),
        "strangers.csv": ("sales", "rejected", "No valid Sales rows reference known SKU IDs", 1, 1),
        "broken.csv": ("sales", "rejected", "No valid Sales rows found after validation", 1, 1),
    }
    rejects = sorted((r["line"], r["failed_rules"]) for r in spark.read.parquet(tables.rejects).collect())
    assert rejects == [
        ("-1,c,Cola,Drinks,1,2,", ["negative_inventory", "cost_not_below_mrp"]), ("02/01/2026,ZZ,9,1.0", ["unknown_sku"]),
        ("02/01/2026,b,x,1.0", ["bad_units"]), ("2026-01-01,YY,1", ["unknown_sku"]), ("soon,A,1", ["bad_date"]),
    ]
    lines = spark.read.parquet(tables.archived_lines)
    path = lines.filter(F.col("path").endswith("/items.csv")).first()["path"]
    back = "".join(r["text"].lstrip("﻿") + "\n" for r in mixed.archived_file(lines, path).collect())
    assert back == FILES["items.csv"]
    assert {r["path"].rsplit("/", 1)[1] for r in lines.select("path").distinct().collect()} == {"items.csv", "sales_in.csv", "sales_us.csv", "strangers.csv", "broken.csv"}


def test_small_splits_give_the_same_tables(spark, tmp_path, folder):
    whole, split = Tables(str(tmp_path / "whole")), Tables(str(tmp_path / "split"))
    run(spark, folder, whole, tmp_path / "one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40)
    try:
        run(spark, folder, split, tmp_path / "two")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    left, right = state(spark, whole), state(spark, split)
    left.pop("archived_lines"), right.pop("archived_lines")  # their places differ
    assert left == right


def test_a_batch_that_stops_half_way(spark, tmp_path, folder, monkeypatch):
    """An item changes its category; the run stops once the items are published, then again before the ledger."""
    tables, clean_run = Tables(str(tmp_path / "tables")), Tables(str(tmp_path / "clean"))
    for t, place in ((tables, "a"), (clean_run, "b")):
        run(spark, folder, t, tmp_path / place)
    later = tmp_path / "later"
    later.mkdir()
    (later / "moved.csv").write_text("sku_id,product_name,category,mrp,cost,current_inventory\nA,Rice,Snacks,2,1,5\n")
    (later / "more.csv").write_text("date,sku_id,units_sold\n2026-01-02,B,60\n")
    text = spark.read.option("lineSep", "\n").text(str(later))
    batch = text.select(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), "value")

    def fail(*args):
        raise ZeroDivisionError

    for place, name in ((mixed, "refresh_categories"), (store, "mark_done")):
        with monkeypatch.context() as stop:
            stop.setattr(place, name, fail)
            with pytest.raises(ZeroDivisionError):
                mixed.take_batch(spark, tables, None, batch, 7)
    for t in (tables, clean_run):
        mixed.take_batch(spark, t, None, batch, 7)
        mixed.take_batch(spark, t, None, batch, 7)
    assert state(spark, tables) == state(spark, clean_run)
    daily = {(r["category"], r["date"]): r["units_sold"] for r in tables.read_daily(spark).collect()}
    assert daily == {(r["category"], r["date"]): r["units_sold"] for r in demand.daily_demand(tables.read_sales(spark), tables.read_skus(spark)).collect()}
    assert daily["Snacks", dt.date(2026, 1, 2)] == 65 and ("Staples", dt.date(2026, 1, 2)) not in daily


def test_fields(spark):
    rows = ['a,b', '', ',', '"a,""b""",c', '"",x', '"two\nlines",', 'a"b,c', '"open,x']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = [r["f"] for r in df.select("i", split_csv.fields(F.col("r")).alias("f")).orderBy("i").collect()]
    assert got == [["a", "b"], [None], [None, None], ['a,"b"', "c"], ["", "x"], ["two\nlines", None], ['a"b', "c"], ["open,x"]]


def test_models_follow_files_and_moved_items(spark, tmp_path, festivals):
    """Sales give a category its model; an item that moves gives its new one another, summed from the start, and leaves the old one empty."""
    tables = Tables(str(tmp_path / "tables"))
    head = "sku_id,product_name,category,mrp,cost,current_inventory\n"
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(30)]

    def take(number, **files):
        folder = tmp_path / f"in{number}"
        folder.mkdir()
        for name, text in files.items():
            (folder / f"{name}.csv").write_text(text)
        text = spark.read.option("lineSep", "\n").text(str(folder))
        place = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_modification_time", "t"), ("file_path", "p"), ("file_block_start", "b"))]
        mixed.take_batch(spark, tables, festivals, text.select(*place, "value"), number)

    sales = "date,sku_id,units_sold\n" + "".join(f"{d},{s},{u + i % 5}\n" for i, d in enumerate(days) for s, u in (("A", 10), ("B", 20)))
    take(0, items=head + "A,x,Snacks,2,1,5\nB,y,Toys,2,1,5\n", sales=sales)
    take(1, items=head + "A,x,Toys,2,1,5\n")
    models = {(r["category"], r["trained_at"]): r["intercept"] for r in spark.read.parquet(tables.models).collect()}
    rows = sorted((c, at, round(v)) for (c, at), v in models.items())
    assert [(c, v) for c, _, v in rows] == [("Snacks", 12), ("Toys", 22), ("Toys", 34)]
    kept = changes.read(spark, tables.moments, ["category"], moments.schema(tables.read_daily(spark)))
    assert {r["category"]: r["n_samples"] for r in kept.collect()} == {"Snacks": 0, "Toys": 23}


def test_rows_do_not_meet_by_their_file(spark):
    rows = [(None, "a", 0, 0, "SKU_id,x,Date,units_sold", True), (None, "a", 0, 1, "s1,9,2024-01-02,3", False), (None, "b", 0, 5, "date", True), (None, "b", 0, 6, "1,2", False)]
    lines = spark.createDataFrame(rows, "t timestamp, p string, b long, i long, text string, is_first boolean")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        data = mixed.fields_by_name(lines, mixed.headers(lines))
        plan = data._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
        found = data.orderBy("path").select("path", "kind", "line", "sku_id", "date", "units_sold", "mrp", mixed.VERSION).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert list(map(tuple, found)) == [
        ("a", "sales", "s1,9,2024-01-02,3", "s1", "2024-01-02", "3", None, None), ("b", None, "1,2", None, "1", None, None, None)]
