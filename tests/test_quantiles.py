"""Exact quantiles per series against numpy: hot series, narrow ranges, ties, signs, few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockcast.operators import clean

SERIES = {
    "one": [5.0],
    "two": [1.0, 2.0],
    "ties": [3.0] * 40 + [4.0],
    "signs": [-1e300, -2.5, -2.5, -0.0, 0.0, 1e-320, 2.5, 1e300],
    "narrow": list(1000 + np.random.default_rng(1).random(3000) * 1e-6),
    "level": list(np.random.default_rng(2).integers(99_900, 100_100, 4000) / 100),
    "wide": list(np.random.default_rng(3).lognormal(3, 6, 2000) * np.random.default_rng(4).choice([-1, 1], 2000)),
}


@pytest.mark.parametrize("probabilities", [[0.25, 0.75], [0.0, 0.5, 0.999, 1.0]])
def test_quantiles_of_each_series_equal_numpy(spark, probabilities):
    rows = [(k, "x", float(v)) for k, values in SERIES.items() for v in values] + [("none", "x", None), (None, "x", 1.0)]
    df = spark.createDataFrame(rows, "k string, other string, x double")
    out = {r["k"]: r for r in clean.quantiles_per_series(df, ["k", "other"], "x", probabilities).collect()}
    assert set(out) == set(SERIES)
    for k, values in SERIES.items():
        assert out[k]["n"] == len(values)
        for i, p in enumerate(probabilities):
            assert out[k][f"p{i}"] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-12)


def test_no_buffer_of_values_and_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert clean.quantiles_per_series(df, ["k"], "x", [0.5]).collect() == []
    table = spark.range(4000).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") * F.col("id") % 997).cast("double").alias("x"))
    plan = clean.outliers_per_series(table, ["k"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_series_are_narrowed_down_and_short_ones_put_in_order(spark, monkeypatch):
    monkeypatch.setattr(clean, "CELLS", 45)
    df = spark.createDataFrame([(k, float(v)) for k, values in SERIES.items() for v in values], "k string, x double")
    out = {r["k"]: r for r in clean.quantiles_per_series(df, ["k"], "x", [0.25, 0.75]).collect()}
    for k, values in SERIES.items():
        assert [out[k]["p0"], out[k]["p1"], out[k]["n"]] == pytest.approx([*np.percentile(values, [25, 75]), len(values)], rel=1e-12, abs=1e-12)


def test_rows_are_made_once(spark, tmp_path):
    spark.range(400).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") > 396, 900).otherwise(F.col("id") % 7).alias("x")).write.parquet(f"{tmp_path}/source")
    found = clean.outliers_per_series(spark.read.parquet(f"{tmp_path}/source"), ["k"], "x")
    assert f"{tmp_path}" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in found.select("k", "x").collect()) == [(k, 900) for k in "012"]
