import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from stockcast.operators import decide as d
from stockcast.operators import reports, reuse, scenario
from stockcast.sources import festivals as fest
from stockcast.sources import store


def when():
    return F.lit("2024-06-01").cast("timestamp")


@pytest.fixture
def params(spark):
    def build(*rows):
        return spark.createDataFrame(
            rows, "category string, current_inventory int, lead_time_days int, supplier_pack_size int, last_upload timestamp"
        )

    return build


FLAT = [(50, 40, 60, 0)] * 30


def plain_decision(points, stock, lead, pack, service=0.95):
    n = len(points)
    stds = [(hi - m) / 1.96 for m, _, hi, _ in points]
    safety = (1.65 if service >= 0.95 else 1.28) * sum(stds) / n * math.sqrt(n)
    if any(s > 0.6 for *_, s in points[:30]):
        safety *= 1.3
    reorder = safety if lead <= 0 else sum(m for m, *_ in points[:lead]) + safety
    quantity = 0 if stock >= reorder else max(0, math.ceil(sum(m for m, *_ in points) + reorder - stock))
    packed = math.ceil(quantity / pack) * pack if pack > 1 and quantity else quantity
    mean = sum(m for m, *_ in points) / n
    risk = 0.6 * (min(1, max(0, 1 - stock / reorder)) if reorder > 0 else 0) + 0.4 * (min(1, sum(stds) / n / mean) if mean > 0 else 0)
    action = ("URGENT_ORDER" if risk >= 0.7 else "ORDER") if packed else ("MONITOR" if risk >= 0.5 else "MAINTAIN")
    return action, packed, round(reorder, 2), round(safety, 2), round(min(1, max(0, risk)), 3), packed != quantity


@pytest.mark.parametrize("stock, lead, pack", [(0, 7, 1), (300, 7, 12), (5000, 7, 12), (100, 0, 1), (400, 45, 50), (395, 7, 1)])
@pytest.mark.parametrize("points", [FLAT, [(98 + 2 * i, 78 + 2 * i, 119 + 2 * i, 0.1 * i) for i in range(10)], [(0, 0, 0, 0)] * 30])
def test_decision_against_plain_arithmetic(forecast, params, points, stock, lead, pack):
    r = d.decide(forecast(A=points), params(("A", stock, lead, pack, None)), when()).first()
    got = (r["recommended_action"], r["order_quantity"], r["reorder_point"], r["safety_stock"], r["risk_score"], r["pack_size_applied"])
    assert got == plain_decision(points, stock, lead, pack)


def test_empty_forecast_and_stale_flag(forecast, params):
    p = params(("A", 10, 7, 1, dt.datetime(2024, 5, 1)), ("B", 10, 7, 1, dt.datetime(2024, 5, 30)), ("C", 10, 7, 5, dt.datetime(2020, 1, 1)))
    out = {r["category"]: r for r in d.decide(forecast(A=FLAT, B=FLAT), p, when()).collect()}
    assert (out["A"]["data_stale_warning"], out["B"]["data_stale_warning"]) == (True, False)
    c = out["C"]
    assert c["recommended_action"] == "INSUFFICIENT_DATA" and not c["data_stale_warning"]
    assert (c["order_quantity"], c["reorder_point"], c["safety_stock"], c["risk_score"]) == (0, 0.0, 0.0, 0.0)


def test_param_defaults(forecast, params, spark):
    skus = spark.createDataFrame([("A",), ("B",)], "category string")
    out = {r["category"]: r for r in d.with_params(forecast(A=FLAT, B=FLAT, Z=FLAT), params(("A", 5, 3, 2, None)), skus).collect()}
    assert set(out) == {"A", "B"}
    assert (out["B"]["current_inventory"], out["B"]["lead_time_days"], out["B"]["supplier_pack_size"]) == (0, 7, 1)


@pytest.mark.parametrize(
    "means, upper, expected",
    [
        ([0.0] * 30, 0, ["model_collapse"]),
        ([50.0] * 10, 10, []),
        ([10.0] * 10 + [60.0], 1, ["spike_anomaly", "runaway_trend"]),
        ([10.0] * 10, 100, ["high_uncertainty"]),
        ([10.0 + 3 * i for i in range(10)], 1, ["runaway_trend"]),
        ([0.0, 5.0, 5.0], 1, []),
    ],
)
def test_sanity_warnings(forecast, means, upper, expected):
    r = d.sanity_warnings(forecast(A=[(m, 0, m + upper, 0) for m in means])).first()
    assert (r["warnings"], r["valid"]) == (expected, not expected)


def test_scenarios_against_plain_arithmetic(spark, forecast):
    points = [(98 + 2 * i, 78 + 2 * i, 118 + 2 * i, 0.1 * i) for i in range(10)]
    asked = spark.createDataFrame(
        [(c, s, p, m) for c in ("Snacks", "Toys") for s, p, m in (("a", 20.0, "balanced"), ("b", 70.0, "aggressive"), ("c", 0.0, "conservative"))],
        "category string, scenario_id string, discount_percent double, elasticity_mode string",
    )
    out = scenario.apply_scenarios(forecast(Snacks=points, Toys=points), asked).collect()
    assert len(out) == 60
    for r in out:
        m, lo, hi, s = points[r["day_index"] - 1]
        share = r["discount_percent"] / 100
        weekend = 1.05 if r["date"].weekday() >= 5 else 1.0
        uplift = min(1.2, share * scenario.ELASTICITY[r["elasticity_mode"]] * (1.1 if r["category"] == "Snacks" else 1.0) * weekend * (1 + min(0.2, s * 0.2)))
        mean, half = m * (1 + uplift), (hi - lo) * (1 + min(0.35, share / 2)) / 2
        assert r["uplift"] == pytest.approx(uplift)
        assert [r["predicted_mean"], r["lower_95"], r["upper_95"]] == pytest.approx([mean, max(0, mean - half), mean + half])


def test_scenario_report(spark, forecast, params):
    asked = spark.createDataFrame([("A", "s", 20.0, "balanced")], "category string, scenario_id string, discount_percent double, elasticity_mode string")
    r = scenario.scenario_report(forecast(A=FLAT), asked, params(("A", 300, 7, 1, dt.datetime(2020, 1, 1))), when()).first()
    assert r["forecast_total_delta"] > 0 and r["order_quantity_delta"] > 0 and not r["data_stale_warning"]
    assert 0 <= r["supply_stability_index"] <= 100 and r["interval_scale"] == pytest.approx(1.1)
    zero = spark.createDataFrame([("A", "s", 0.0, "balanced")], asked.schema)
    r = scenario.scenario_report(forecast(A=FLAT), zero, params(("A", 300, 7, 1, None)), when()).first()
    assert (r["forecast_total_delta"], r["risk_delta"], r["order_quantity_delta"]) == (0.0, 0.0, 0)


def test_rounding_takes_ties_to_even(spark):
    from stockcast.functions.numbers import py_round

    values = [0.125, 0.375, 2.5, 1.234567, -0.125, 99.999, 1e9 + 0.126, 1.115, 2.675, -2.675, 1.005, 5e15 + 0.5, 0.0]
    values += [k / 200 for k in range(-5000, 5000)] + [k / 1000 + 0.0005 for k in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["r"] for r in df.select(py_round(F.col("v"), 2).alias("r")).collect()]
    assert got == [round(v, 2) for v in values]


def test_built_in_calendar(spark, festivals):
    assert festivals.count() == 28
    merged = {r["festival_name"]: r for r in fest.rollup(festivals, F.lit("2026-10-01").cast("date")).collect()}
    diwali = merged["Diwali"]
    assert diwali["categories"] == ["Snacks", "Staples", "Edible Oil"] and diwali["category"] == "Snacks,Staples,Edible Oil"
    assert diwali["category_uplifts"] == {"Snacks": 0.8, "Staples": 0.5, "Edible Oil": 0.6}
    assert (diwali["historical_uplift"], diwali["demand_multiplier"], diwali["days_until"]) == (0.8, 1.8, 20)
    assert fest.expand(fest.rollup(festivals, F.lit("2026-10-01").cast("date"))).count() == 28
    empty = festivals.limit(0)
    assert fest.seed_if_empty(empty, festivals).count() == 28
    assert fest.seed_if_empty(festivals.limit(3), festivals).count() == 3


def test_export_of_older_items(spark):
    old = spark.createDataFrame(
        [("Holi", dt.date(2026, 3, 13), "Snacks,Staples", 0.4, None)],
        "festival_name string, date date, category string, historical_uplift double, category_uplifts map<string,double>",
    )
    assert [tuple(r)[2:] for r in fest.expand(old).collect()] == [("Snacks,Staples", 0.4)]


def test_light_prediction_without_data(spark, series, festivals):
    from stockcast.operators.demand import recent_level

    asked = spark.createDataFrame([("A", dt.date(2026, 10, 21)), ("Z", dt.date(2026, 10, 21))], "category string, date date")
    out = {r["category"]: r for r in reports.light_prediction(recent_level(series(A=[10] * 40)), asked, fest.on_date(festivals)).collect()}
    assert (out["A"]["predicted_demand"], out["A"]["risk_score"], out["A"]["confidence_level"]) == (18.0, 0.0, "high")
    assert out["A"]["suggested_action"].startswith("Increase inventory")
    assert out["Z"]["predicted_demand"] is None and out["Z"]["confidence_level"] == "low"


def test_overrides(spark, params):
    given = spark.createDataFrame([("A", 12.5), ("B", -1.0), ("C", float("nan"))], "category string, stock double")
    base = params(("A", 1, 7, 1, None), ("B", 2, 7, 1, None), ("C", 3, 7, 1, None))
    out = {r["category"]: r["current_inventory"] for r in reports.apply_overrides(base, given).collect()}
    assert out == {"A": 13, "B": 2, "C": 3}
    assert {r["category"] for r in reports.invalid_overrides(given).collect()} == {"B", "C"}


def test_cache_round_trip(spark, forecast, params):
    from stockcast.functions.calendar import confidence

    base, plan = forecast(A=FLAT), params(("A", 10, 7, 4, None))
    points = base.withColumn("confidence_level", confidence(F.col("day_index")))
    payload = store.payloads(points, d.decide(base, plan, when()), plan.drop("last_upload"), d.sanity_warnings(base), 30)
    cache = store.cache_rows(payload, when())
    ask = spark.createDataFrame(
        [("hit", "A", 30, 10, 7, 4), ("other pack", "A", 30, 10, 7, 1), ("other category", "B", 30, 10, 7, 4)],
        "request_id string, category string, n_days int, current_inventory int, lead_time_days int, supplier_pack_size int",
    )
    no_events = spark.createDataFrame([], "category string, uploaded_at timestamp")
    later = F.lit("2024-06-01 00:30:00").cast("timestamp")
    hits = reuse.cached_forecasts(ask, cache, no_events, later)
    assert {r["request_id"]: r["cache_hit"] for r in hits.collect()} == {"hit": True, "other pack": False, "other category": False}
    assert {r["request_id"]: r["reusable"] for r in reuse.baseline_reusable(hits).collect()}["hit"] is True
    back = reuse.payload_points(hits).orderBy("day_index").collect()
    assert len(back) == 30 and back[0]["predicted_mean"] == 50.0 and back[14]["confidence_level"] == "low"
    assert not reuse.cached_forecasts(ask, cache, no_events, F.lit("2024-06-01 02:00:00").cast("timestamp")).filter("cache_hit").count()
    newer = spark.createDataFrame([("A", dt.datetime(2024, 6, 1, 0, 10))], "category string, uploaded_at timestamp")
    assert not reuse.cached_forecasts(ask, cache, newer, later).filter("cache_hit").count()


def test_broken_points_are_left_out(spark):
    text = '{"forecast":[{"date":"2024-01-01","predicted_mean":1,"lower_95":0,"upper_95":2},{"date":"x","predicted_mean":1,"lower_95":0,"upper_95":2},{"date":"2024-01-03"}]}'
    hits = spark.createDataFrame([("r", text, True)], "request_id string, payload_json string, cache_hit boolean")
    out = reuse.payload_points(hits).collect()
    assert [(r["day_index"], r["confidence_level"], r["festival_score"]) for r in out] == [(1, "high", 0.0)]


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, False), ("  ", False), ("Order now.", True), ("{not json", True), ('{"a":1}', True),
        ('{"type":"forecast_decision"}', False), ('{"decision":{"recommended_action":"ORDER"}}', False), ('{"decision":{"x":1}}', True),
    ],
)
def test_reusable_insight(spark, text, expected):
    from stockcast.functions.text import is_reusable_insight

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(is_reusable_insight(F.col("t")).alias("r")).first()["r"] is expected
