"""Uploads of many rows: how often they are typed, in how many files they come, and the quick ways of typing."""

import pytest
from pyspark.sql import functions as F

import suite.all_checks  # noqa: F401  (fills the registry)
from stockcast.functions import text as tx
from stockcast.operators import clean
from stockcast.plans.ingest import Tables, ingest
from stockcast.sources import store, upload
from suite import store_checks
from suite.base import QUERIES, Domain
from suite.ingest_checks import raw_sales

ITEMS = [("A1", "n", "X", 2.0, 1.0, 1), ("B2", "n", "Y", 2.0, 1.0, 1), ("C3", "n", None, 2.0, 1.0, 1)]


@pytest.fixture
def tables(spark, tmp_path):
    tables = Tables(str(tmp_path / "tables"))
    store.write_snapshot(spark, tables.skus, spark.createDataFrame(ITEMS, "sku_id string, product_name string, category string, mrp double, cost double, current_inventory int"))
    return tables


def test_rows_are_typed_once(spark, tables, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("date,sku_id,units_sold\n13/01/2026,a1,4\n02/01/2026,B2,2\n13/01/2026,a1,9\n13/01/2026,a1,4\n02/01/2026,B2,-1\n02/01/2026,Z9,1\nsoon,B2,1\n")
    (tmp_path / "b.csv").write_text("date,sku_id,units_sold\n01/13/2026,A1,7\n02/03/2026, b2 ,5\n02/03/2026,c3,1\n")
    typed, plain = [], clean._typed_once
    monkeypatch.setattr(clean, "_typed_once", lambda *a: typed.append(1) or plain(*a))
    raw = upload.read_upload(spark, str(tmp_path / "*.csv"))
    _, metrics = ingest(spark, tables, raw, F.lit("2026-03-01").cast("timestamp"), archive=False)
    assert sorted(map(str, [tuple(r) for r in tables.read_sales(spark).selectExpr("cast(date as string)", "sku_id", "units_sold").collect()])) == [
        "('2026-01-02', 'B2', 2)", "('2026-01-13', 'A1', 7)", "('2026-02-03', 'B2', 5)", "('2026-02-03', 'C3', 1)"]
    m = metrics.first().asDict()
    # ten rows: one exact copy; the rows of A1 on one day count once, twice replaced; three that are not valid or not known
    assert (m["rows_received"], m["rows_cleaned"], m["duplicates_removed"], m["invalid_rows_dropped"], m["files_of_unclear_date_order"]) == (10, 4, 3, 3, 0)
    events = spark.read.parquet(tables.events)
    assert {r["category"] for r in events.select("category").collect()} == {"X", "Y", None}
    assert len(typed) == 1


def test_files_grow_in_number_with_the_rows_and_keep_their_order(spark, monkeypatch):
    class Stop(Exception):
        pass

    def stop(session, path):
        read.append(path)
        raise Stop

    read = []
    monkeypatch.setattr(store_checks, "ROWS_A_FILE", 500)
    monkeypatch.setattr(upload, "read_upload", stop)
    with pytest.raises(Stop):
        QUERIES["csv_upload_to_tables"](spark, "/root/testdata/sf0.001")
    assert len(spark.read.text(read[0]).inputFiles()) > 4
    monkeypatch.undo()
    # rows of one key follow each other as in the table, whichever file they are in
    found = upload.number_rows(upload.read_upload(spark, read[0])).orderBy("row_order").select("sku_id", "date", "units_sold", "schema_version").collect()
    want = raw_sales(Domain(spark, "/root/testdata/sf0.001")).orderBy("row_order").select("sku_id", "date", "units_sold", "schema_version").collect()
    assert found == want


def test_quick_ways_take_no_more_than_the_others(spark):
    texts = {
        "1999/01/02": "1999-01-02", "1999/01/1T": None, "1999/13/01": None, "1999-01-02 10:30:00": "1999-01-02", "1999-01-02T99:99:99": "1999-01-02", "1999-01-02 10:30:0x": None,
        "1999/1/02 ": "1999-01-02", "05/01/1999": "1999-01-05", "12/3 /1999": None, "01/31/1999": None, " 5/01/1999": "1999-01-05", "05-01-1999": "1999-01-05", "1999/01/02\n": "1999-01-02",
    }
    df = spark.createDataFrame([(k,) for k in texts], "x string")
    days = df.select("x", tx.to_day(F.col("x"), order=F.col("x").isNotNull()).cast("string").alias("d")).collect()
    assert {r["x"]: r["d"] for r in days} == texts
    numbers = {"12": 12.0, "007": 7.0, "12\n": 12.0, "1234567890123456": 1234567890123456.0, "٣": None, "1d": None, "": None, "9e2": 900.0, "1e999": None}
    df = spark.createDataFrame([(k,) for k in numbers], "x string")
    assert {r["x"]: r["n"] for r in df.select("x", tx.to_number(F.col("x")).alias("n")).collect()} == numbers
    ids = {"sku1": "SKU1", " sku1​ ": "SKU1", "straße": "STRASSE", "a b": "A B", "a\n": "A"}
    df = spark.createDataFrame([(k,) for k in ids], "x string")
    assert {r["x"]: r["s"] for r in df.select("x", tx.norm_sku(F.col("x")).alias("s")).collect()} == ids
