"""Stored sums of a series against sums over all of its days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stockcast.operators import demand, model, moments
from stockcast.plans.ingest import Tables
from stockcast.schemas import SKUS
from stockcast.sources import changes, store
from stockcast.streaming import uploads

FIRST = dt.date(2024, 1, 1)


def days(spark, seed, **lengths):
    rng = random.Random(seed)
    rows = []
    for name, n in lengths.items():
        at = FIRST
        for _ in range(n):
            at += dt.timedelta(days=rng.choice((1, 1, 1, 3)))
            rows.append((name, at, rng.randrange(50_000, 50_900) if name == "Large" else 12 if name == "Flat" else rng.randrange(0, 60)))
    return spark.createDataFrame(rows, "category string, date date, units_sold bigint")


def equal(got, want):
    got, want = ({r["category"]: r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for name, row in want.items():
        assert set(row) <= set(got[name])
        for column, value in row.items():
            if isinstance(value, (float, list)):
                size = max(map(abs, value)) if isinstance(value, list) else abs(value)
                assert got[name][column] == pytest.approx(value, rel=1e-9, abs=1e-9 * max(1.0, size)), (name, column)
            else:
                assert got[name][column] == value, (name, column)


def full(daily, festivals):
    return model.series_statistics(demand.training_frame(daily, festivals))


def test_days_added_in_turn(spark, festivals):
    """Three batches of later days: sums, scales and models as from all days; short series grow into long ones."""
    daily = days(spark, 1, Large=400, Snacks=150, Flat=90, Short=10, New=40).cache()
    stored = spark.createDataFrame([], moments.schema(daily))
    edges = [FIRST, FIRST + dt.timedelta(days=14), FIRST + dt.timedelta(days=60), FIRST + dt.timedelta(days=61), FIRST + dt.timedelta(days=2000)]
    for low, high in zip(edges, edges[1:]):
        seen = daily.filter(F.col("date") <= high)
        fresh = seen.filter(F.col("date") > low).groupBy("category").agg(F.min("date").alias("first_change"))
        new = moments.updated(stored, seen, fresh, festivals)
        stored = spark.createDataFrame(stored.join(new, "category", "left_anti").unionByName(new).collect(), stored.schema)
        equal(moments.statistics(stored), full(seen, festivals))
    equal(model.fit(moments.statistics(stored)).drop("n_passes"), model.fit(full(daily, festivals)).drop("n_passes"))


def test_only_last_days_are_read(spark, festivals):
    """The history before the last seven days may be anything once it is stored."""
    daily = days(spark, 2, Snacks=80, Large=60)
    ends = {r["category"]: r["d"] for r in daily.groupBy("category").agg(F.max("date").alias("d")).collect()}
    later = spark.createDataFrame([(c, d + dt.timedelta(days=i), 5 * i) for c, d in ends.items() for i in (1, 2, 4)], daily.schema)
    stored = moments.updated(spark.createDataFrame([], moments.schema(daily)), daily, daily.groupBy("category").agg(F.min("date").alias("first_change")), festivals)
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    starts = stored.select("category", F.col("recent")[0]["date"].alias("from"))
    recent = daily.join(starts, "category").filter(F.col("date") >= F.col("from")).select(*daily.columns)
    assert recent.count() == 14
    changed = later.groupBy("category").agg(F.min("date").alias("first_change"))
    nothing = daily.limit(0)
    equal(moments.statistics(moments.updated(stored, nothing, changed, festivals, recent=recent.unionByName(later))), full(daily.unionByName(later), festivals))


def test_what_makes_a_series_read_whole(spark, festivals):
    daily = days(spark, 3, Snacks=60, Large=50)
    first = daily.groupBy("category").agg(F.min("date").alias("first_change"))
    stored = moments.updated(spark.createDataFrame([], moments.schema(daily)), daily, first, festivals)
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    # a correction of an old day, and a day put in between; no changed day; then another festival table
    third = sorted(r["date"] for r in daily.filter("category = 'Snacks'").collect())[2]
    corrected = daily.withColumn("units_sold", F.when((F.col("category") == "Snacks") & (F.col("date") == third), 999).otherwise(F.col("units_sold")))
    corrected = corrected.unionByName(spark.createDataFrame([("Snacks", FIRST, 7)], daily.schema))
    changed = spark.createDataFrame([("Snacks", FIRST), ("Large", None)], "category string, first_change date")
    equal(moments.statistics(moments.updated(stored, corrected, changed, festivals)), full(corrected, festivals))
    fewer = festivals.filter("month(date) > 6")
    untouched = spark.createDataFrame([("Snacks", None), ("Gone", None)], "category string, first_change date")
    equal(moments.statistics(moments.updated(stored, daily, untouched, fewer)), full(daily.filter("category = 'Snacks'"), fewer))
    assert moments.updated(stored.limit(0), daily.limit(0), untouched.limit(0), festivals).count() == 0


def test_models_of_the_stream(spark, tmp_path, festivals):
    """Batches of later days, one of them twice, leave the model of all days; only touched series get a new one."""
    tables = Tables(str(tmp_path / "tables"))
    store.write_snapshot(spark, tables.skus, spark.createDataFrame([("A", "x", "Snacks", 2.0, 1.0, 5), ("B", "y", "Toys", 2.0, 1.0, 5)], SKUS))
    rng = random.Random(5)
    sales = [(FIRST + dt.timedelta(days=i), s, rng.randrange(60)) for i in range(60) for s in ("A", "B")]

    def batch(number, rows):
        df = spark.createDataFrame([(str(d), s, str(u)) for d, s, u in rows], "date string, sku_id string, units_sold string")
        place = F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit("f").alias("p"), F.lit(0).cast("long").alias("b"))
        uploads.upsert_batch(spark, tables, festivals, df.select("*", F.lit(None).cast("string").alias("file_category"), place.alias("place")), number)

    batch(0, [r for r in sales if r[0] < FIRST + dt.timedelta(days=40)])
    batch(1, [r for r in sales if r[0] >= FIRST + dt.timedelta(days=40) and r[1] == "A"])
    batch(2, [r for r in sales if r[0] >= FIRST + dt.timedelta(days=40) and r[1] == "A"])
    models = spark.read.parquet(tables.models)
    assert {(r["category"], r["n"]) for r in models.groupBy("category").agg(F.count("*").alias("n")).collect()} == {("Snacks", 3), ("Toys", 1)}
    seen = tables.read_daily(spark)
    assert seen.count() == 100
    want = model.fit(full(seen, festivals)).drop("n_passes")
    equal(store.latest_models(models, ["category"]).select(*want.columns), want)
    kept = changes.read(spark, tables.moments, ["category"], moments.schema(seen))
    equal(moments.statistics(kept), full(seen, festivals))
