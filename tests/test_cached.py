"""Batches that read through the forecast cache."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockcast.plans import cached
from stockcast.plans.ingest import Tables
from stockcast.schemas import SALES, SKUS
from stockcast.sources import store

ASKED = "category string, current_inventory int, lead_time_days int, supplier_pack_size int"


def clock(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture
def tables(spark, tmp_path):
    """Three categories with history and one with two days only."""
    out = Tables(str(tmp_path / "tables"))
    items = [(f"{c}{i}", f"item {i}", c, 10.0, 5.0, 40) for c in ("A", "B", "C", "D") for i in range(2)]
    store.upsert_skus(spark, out.skus, spark.createDataFrame(items, SKUS), SKUS)
    first = dt.date(2024, 1, 1)
    sales = [(first + dt.timedelta(days=i), s, 20 + (i * 7 + len(s) + ord(s[0])) % 13) for s, _, c, *_ in items for i in range(2 if c == "D" else 60)]
    store.upsert_sales(spark, out.sales, spark.createDataFrame(sales, SALES), SALES)
    return out


def asked(spark, *categories):
    return spark.createDataFrame([(c, 100, 7, 1) for c in categories], ASKED)


def origins(answers):
    return {r["category"]: r["origin"] for r in answers.collect()}


def test_read_through(spark, tables, festivals):
    ask = asked(spark, "A", "B", "D", "unknown")
    assert origins(cached.serve(spark, tables, ask, festivals, clock("2024-03-01 10:00:00"))) == {"A": "new model", "B": "new model"}
    assert cached.read_log(spark, tables).count() == 2
    # within the hour all comes from the cache, and every answer is logged again
    again = cached.serve(spark, tables, ask, festivals, clock("2024-03-01 10:30:00"))
    assert origins(again) == {"A": "cache", "B": "cache"}
    assert {str(r["generated_at"]) for r in again.collect()} == {"2024-03-01 10:00:00"}
    assert cached.read_log(spark, tables).count() == 4
    # an hour later the models are still good; only C is fitted
    later = cached.serve(spark, tables, asked(spark, "A", "B", "C"), festivals, clock("2024-03-01 11:30:00"))
    assert origins(later) == {"A": "stored model", "B": "stored model", "C": "new model"}
    assert spark.read.parquet(tables.models).count() == 3
    # an upload for A makes its model and its cache rows old
    store.append(spark.createDataFrame([("A", dt.datetime(2024, 3, 1, 11, 40))], "category string, uploaded_at timestamp"), tables.events)
    last = cached.serve(spark, tables, asked(spark, "A", "B", "C"), festivals, clock("2024-03-01 11:50:00"))
    assert origins(last) == {"A": "new model", "B": "cache", "C": "cache"}
    assert {r["category"]: r["data_stale"] for r in last.collect()} == {"A": False, "B": False, "C": False}


def test_only_misses_are_fitted_and_forecast(spark, tables, festivals):
    cached.serve(spark, tables, asked(spark, "A", "B"), festivals, clock("2024-03-01 10:00:00"))
    events = spark.createDataFrame([], "category string, uploaded_at timestamp")
    cache = spark.read.parquet(tables.cache)
    broken = cache.withColumn("payload_json", F.when(F.col("category") == "B", F.lit('{"forecast":[]}')).otherwise(F.col("payload_json")))

    def batch(entries, models=None):
        return cached.batch_with_cache(
            asked(spark, "A", "B", "C", "D"), tables.read_sales(spark), tables.read_skus(spark), festivals, entries, events, models, clock("2024-03-01 10:20:00"))

    served = batch(broken, spark.read.parquet(tables.models).filter("category = 'B'"))
    assert origins(served.answers) == {"A": "cache", "B": "stored model", "C": "new model"}
    assert {r[0]: r[1] for r in served.points.groupBy("category").count().collect()} == {"B": 30, "C": 30}
    assert [r[0] for r in served.models.select("category").collect()] == ["C"]
    assert [r[0] for r in served.skipped.collect()] == ["D"]
    assert sorted(r[0] for r in served.cache.select("category").collect()) == ["B", "C"]
    assert sorted(r[0] for r in served.log.select("category").collect()) == ["A", "B", "C"]
    # a stored model gives what a new one of the same data gives
    known = {r["category"]: r["payload_json"] for r in cache.collect()}
    assert {r["category"]: r["payload_json"] for r in served.answers.collect() if r["category"] in "AB"} == known


def test_other_parameters_and_empty_batches(spark, tables, festivals):
    cached.serve(spark, tables, asked(spark, "A"), festivals, clock("2024-03-01 10:00:00"))
    other = spark.createDataFrame([("A", 100, 7, 6)], ASKED)
    assert origins(cached.serve(spark, tables, other, festivals, clock("2024-03-01 10:01:00"))) == {"A": "stored model"}
    assert origins(cached.serve(spark, tables, asked(spark).limit(0), festivals, clock("2024-03-01 10:02:00"))) == {}
