import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockcast.operators import demand, model
from stockcast.plans.batch import batch_forecast
from stockcast.sources import store
from tests.test_features import brute_score


@pytest.fixture
def oil(spark):
    """180 days of two items with trend, weekend and festival pulse; a third item without sales."""
    first = dt.date(2024, 1, 1)
    sales = []
    for i in range(180):
        day = first + dt.timedelta(days=i)
        pulse = 30 * math.exp(-abs((day - dt.date(2024, 4, 10)).days) / 5)
        base = 40 + 0.2 * i + (12 if day.weekday() >= 5 else 0) + pulse
        sales += [(day, "O1", int(base)), (day, "O2", int(base * 0.6))]
    skus = [("O1", "Edible Oil"), ("O2", "Edible Oil"), ("O3", "Edible Oil"), ("T1", "Toys")]
    return (
        spark.createDataFrame(sales, "date date, sku_id string, units_sold bigint"),
        spark.createDataFrame(skus, "sku_id string, category string"),
    )


def _forecast(oil, festivals, n, keys=("category",)):
    sales, skus = oil
    carry = [] if "category" in keys else ["category"]
    daily = demand.daily_demand(sales, skus, [*keys, *carry])
    models = model.train_models(demand.training_frame(daily, festivals, keys), keys, carry)
    return model.forecast(models, festivals, n, keys)


def test_forecast_invariants(oil, festivals):
    out = _forecast(oil, festivals, 30).orderBy("day_index").collect()
    assert [r["day_index"] for r in out] == list(range(1, 31))
    assert [r["date"] for r in out] == [dt.date(2024, 6, 29) + dt.timedelta(days=i) for i in range(30)]
    assert all(0 <= r["lower_95"] <= r["predicted_mean"] <= r["upper_95"] for r in out)
    assert len({round(r["predicted_mean"], 6) for r in out}) > 1
    for r in out:
        assert r["festival_score"] == pytest.approx(
            brute_score(r["date"], "Edible Oil", {"holi": (3, 13), "independence day": (8, 15), "navratri": (9, 22),
                                                  "diwali": (10, 21), "christmas": (12, 25)})[0]
        )


def test_shorter_horizon_is_a_prefix(oil, festivals):
    short = [r["predicted_mean"] for r in _forecast(oil, festivals, 7).orderBy("day_index").collect()]
    long = [r["predicted_mean"] for r in _forecast(oil, festivals, 21).orderBy("day_index").collect()]
    assert short == pytest.approx(long[:7], rel=1e-12)


def test_item_level_series(oil, festivals):
    out = _forecast(oil, festivals, 5, ["sku_id"])
    assert {r["sku_id"]: r["count"] for r in out.groupBy("sku_id").count().collect()} == {"O1": 5, "O2": 5}


def test_whole_chain_against_numpy(oil, festivals):
    """Scaling, Gram sums, fit and recursion rebuilt from the feature table alone."""
    from tests.test_ridge import svd_fit

    sales, skus = oil
    train = demand.training_frame(demand.daily_demand(sales, skus), festivals)
    pdf = train.toPandas().sort_values("date")
    x = pdf[list(demand.FEATURES)].to_numpy(float)
    y = pdf["units_sold"].to_numpy(float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    coef, sigma, alpha, _ = svd_fit((x - mean) / sd, y)
    known, expected = list(y), []
    out = _forecast(oil, festivals, 30).orderBy("day_index").collect()
    for i, r in enumerate(out):
        last = known[-7:]
        row = np.array([pdf["time_index"].max() + 1 + i, r["date"].weekday(), r["festival_score"], known[-1], known[-7],
                        np.mean(last), np.std(last)])
        z = (row - mean) / sd
        m, s = z @ coef + y.mean(), math.sqrt(z @ sigma @ z + 1 / alpha)
        expected.append((max(m, 0), max(m - 1.96 * s, 0), max(m + 1.96 * s, 0)))
        known.append(max(m, 0.0))
    np.testing.assert_allclose([(r["predicted_mean"], r["lower_95"], r["upper_95"]) for r in out], expected, rtol=1e-6)


def test_constant_feature_is_not_blown_up(series, festivals):
    stats = model.series_statistics(demand.training_frame(series(A=[100 + i for i in range(30)]), festivals)).first()
    assert stats["scales"][demand.FEATURES.index("rolling_std_7")] == 1.0
    assert stats["n_samples"] == 23 and stats["tail"] == [float(100 + i) for i in range(23, 30)]


def test_short_series_are_skipped_and_listed(series, festivals):
    daily = series(A=[50 + i % 7 for i in range(40)], B=[5] * 13, C=[5] * 14)
    train = demand.training_frame(daily, festivals)
    assert {r["category"] for r in model.train_models(train).select("category").collect()} == {"A", "C"}
    skipped = model.skipped_series(daily, train).collect()
    assert [(r["category"], r["training_rows"]) for r in skipped] == [("B", 6)]


def test_scoring_in_columns_equals_one_step_forecast(series, festivals):
    daily = series(A=[60 + 7 * (i % 7) + i for i in range(60)])
    models = model.train_models(demand.training_frame(daily, festivals))
    first = model.forecast(models, festivals, 1).first()
    tail = models.first()["tail"]
    row = {"category": "A", "time_index": 60, "weekday": first["date"].weekday(), "festival_score": first["festival_score"],
           "lag_1": tail[-1], "lag_7": tail[0], "rolling_mean_7": float(np.mean(tail)), "rolling_std_7": float(np.std(tail))}
    out = model.score(daily.sparkSession.createDataFrame([row]), models).first()
    for c in ("predicted_mean", "lower_95", "upper_95"):
        assert out[c] == pytest.approx(first[c], rel=1e-9)


def test_diagnostics(series, festivals):
    daily = series(A=[100 + i + (40 if i == 14 else 0) for i in range(60)], B=[80 + 5 * (i % 7) for i in range(60)])
    models = model.train_models(demand.training_frame(daily, festivals)).cache()
    analysed = {r["category"]: r for r in model.analyze(models).collect()}
    assert set(analysed) == {"A", "B"} and analysed["A"]["n_samples"] == 53
    a = analysed["A"]
    assert all(a["feature_importance"][f] == abs(a["coefficients"][f]) for f in demand.FEATURES)
    long = model.coefficients(models)
    ranked = model.rank_by_feature(long, "lag_7").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2] and ranked[0]["abs_coefficient"] >= ranked[1]["abs_coefficient"]
    unknown = model.rank_by_feature(long, "no_such_feature").orderBy("rank").collect()
    assert [(r["category"], r["coefficient"]) for r in unknown] == [("A", 0.0), ("B", 0.0)]
    wide = {r["category"]: r for r in model.compare(models).collect()}
    assert wide["B"]["lag_7"] == analysed["B"]["coefficients"]["lag_7"]
    assert {r["trait"] for r in model.most_sensitive(long).collect()} == set(model.SENSITIVITY)


@pytest.mark.parametrize(
    "values, expected",
    [
        ({"festival_score": 15.1, "lag_1": 0.2}, ("high", True, False, "stable", "X is highly festival-sensitive with strong momentum effects")),
        ({"festival_score": -8.5, "lag_7": 0.06, "rolling_std_7": -0.1}, ("medium", False, True, "volatility-averse", "X is moderately festival-sensitive with weekly seasonality")),
        ({"lag_1": 0.1, "lag_7": 0.05, "rolling_std_7": 0.3}, ("low", False, False, "volatility-responsive", "X is festival-independent with stable demand patterns")),
    ],
)
def test_behaviour_classes(spark, values, expected):
    rows = [("X", f, float(values.get(f, 0.0))) for f in demand.FEATURES]
    r = model.behaviour(spark.createDataFrame(rows, "category string, feature string, coefficient double")).first()
    assert (r["festival_sensitivity"], r["momentum_driven"], r["weekly_pattern"], r["stability"], r["summary"]) == expected


def test_global_rank_over_many_partitions(spark):
    from stockcast.operators.keep import global_rank

    rows = spark.range(0, 5000, 1, 8).select((F.col("id") * 7919 % 311).alias("v"), "id")
    out = global_rank(rows, [F.desc("v"), F.asc("id")]).collect()
    expected = sorted(((r["v"], r["id"]) for r in out), key=lambda p: (-p[0], p[1]))
    assert {(r["v"], r["id"]): r["rank"] for r in out} == {pair: i + 1 for i, pair in enumerate(expected)}


def test_batch(oil, festivals, spark):
    sales, skus = oil
    params = spark.createDataFrame(
        [("Edible Oil", 1900, 10, 12, None)],
        "category string, current_inventory int, lead_time_days int, supplier_pack_size int, last_upload timestamp",
    )
    out = batch_forecast(sales, skus, festivals, params, F.lit("2024-07-01").cast("timestamp"), 30)
    assert [r["category"] for r in out.decisions.collect()] == ["Edible Oil"]
    assert [(r["category"], r["training_rows"]) for r in out.skipped.collect()] == [("Toys", 0)]
    assert out.forecast.count() == 30 and out.warnings.count() == 1


def test_model_store(spark, series, festivals, tmp_path):
    daily = series(A=[50 + i % 7 for i in range(40)], B=[20 + i % 5 for i in range(40)])
    models = model.train_models(demand.training_frame(daily, festivals))
    path = str(tmp_path / "models")
    for stamp in ("2024-01-01", "2024-03-01"):
        store.save_models(models, path, F.lit(stamp).cast("timestamp"))
    saved = spark.read.parquet(path)
    assert [str(r["trained_at"])[:7] for r in store.model_versions(saved, ["category"]).collect()] == ["2024-03"] * 2 + ["2024-01"] * 2
    latest = store.latest_models(saved, ["category"])
    assert {(r["category"], str(r["trained_at"])[:10]) for r in latest.collect()} == {("A", "2024-03-01"), ("B", "2024-03-01")}
    again = model.forecast(latest, festivals, 5).orderBy("category", "day_index").collect()
    direct = model.forecast(models, festivals, 5).orderBy("category", "day_index").collect()
    assert [r["predicted_mean"] for r in again] == pytest.approx([r["predicted_mean"] for r in direct])
    uploads = spark.createDataFrame([("A", dt.datetime(2024, 4, 1))], "category string, last_upload timestamp")
    assert [r["category"] for r in store.fresh_models(saved, uploads, ["category"]).collect()] == ["B"]
