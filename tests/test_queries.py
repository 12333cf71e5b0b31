"""Every check query against its SQL counterpart, and what the plans look like."""

import importlib.util
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from suite.compare import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("entry_module", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
entry_module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_module)
QUERIES, ORACLES = entry_module.QUERIES, entry_module.ORACLES

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 6


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"csv_upload_to_tables", "batch_with_cache", "sku_snapshots", "sales_months_upserted", "streamed_uploads_daily_totals", "streamed_mixed_files"}))
def test_no_cartesian_product_and_no_row_at_a_time_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "FlatMapGroupsInPandas" not in plan


def test_python_only_in_fit_and_recursion(spark):
    plan = plan_of(QUERIES["recursive_forecast"](spark, SMALL))
    assert len(re.findall(r"MapInArrow run", plan)) == 2
    assert "ArrowEvalPython" not in plan


def test_one_shuffle_by_series_for_features_fit_and_forecast(spark):
    """After the daily totals, windows, Gram sums and forecast share one exchange."""
    from stockcast.operators import demand, model
    from suite.base import Domain

    t = Domain(spark, SMALL)
    daily = t.daily
    plan = plan_of(model.forecast(model.train_models(demand.training_frame(daily, t.festivals)), t.festivals, 30))
    assert len(re.findall(r"Exchange hashpartitioning\(category#\d+, \d+\)", plan)) == 1


def test_filter_on_the_series_reaches_the_scan(spark):
    from suite.base import Domain

    plan = plan_of(Domain(spark, SMALL).daily.filter(F.col("category") == "Snacks"))
    scan = [line for line in plan.splitlines() if "part.parquet" in line]
    assert scan and "p_type" in scan[0] and "STANDARD" in plan
