import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from stockcast.functions import calendar as cal
from stockcast.operators import demand


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*(order or ("category", "date"))).collect()]


def test_lags_and_rolling_values(series):
    out = rows(demand.add_lag_features(demand.add_time_index(series(A=[100 + i for i in range(30)]))))
    assert len(out) == 23
    assert out[0]["time_index"] == 7 and out[0]["units_sold"] == 107
    for r in out:
        window = [r["units_sold"] - i for i in range(7)]
        assert (r["lag_1"], r["lag_7"]) == (r["units_sold"] - 1, r["units_sold"] - 7)
        assert r["rolling_mean_7"] == pytest.approx(statistics.mean(window))
        assert r["rolling_std_7"] == pytest.approx(statistics.stdev(window))


def test_shortest_history(series, festivals):
    train = demand.training_frame(series(A=[100 + i for i in range(10)], B=[5] * 7), festivals)
    assert {r["category"]: r["count"] for r in train.groupBy("category").count().collect()} == {"A": 3}


def test_stockout_flags(series):
    out = rows(demand.add_lag_features(demand.add_time_index(series(A=[9] * 8 + [5, 0, 9, 5, 9, 9, 9, 9, 9]))))
    assert [r["potential_stockout"] for r in out] == [False, True, True, False, True] + [False] * 5
    assert [r["stockout_suspected"] for r in out] == [False] * 4 + [True] * 4 + [False] * 2


def test_gaps_are_not_filled_and_lags_go_by_row(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=3 * i) for i in range(9)]
    daily = spark.createDataFrame([("A", d, i) for i, d in enumerate(days)], "category string, date date, units_sold bigint")
    out = rows(demand.add_lag_features(demand.add_time_index(daily)))
    assert [(r["time_index"], r["lag_1"], r["lag_7"]) for r in out] == [(7, 6, 0), (8, 7, 1)]


def test_weekday_one_hot(series):
    out = rows(demand.add_weekday(series(A=[1] * 7), one_hot=True))
    assert [r["weekday"] for r in out] == list(range(7))  # 2024-01-01 is a Monday
    assert all(r[f"dow_{i}"] == int(i == r["day_of_week"]) for r in out for i in range(7))


def brute_score(day, category, dates, k=0.2):
    """Plain loops over festivals and years."""
    total, nearest = 0.0, None
    weights = cal.CATEGORY_WEIGHTS.get(category.strip().lower(), {})
    for name, (tier_name, m, d) in cal.ANCHORS.items():
        m, d = dates.get(name, (m, d))
        tier, deltas = cal.TIERS[tier_name], []
        for year in (day.year - 1, day.year, day.year + 1):
            try:
                deltas.append((dt.date(year, m, d) - day).days)
            except ValueError:
                continue
        if not deltas:
            continue
        best = min(deltas, key=abs)
        if nearest is None or abs(best) < abs(nearest):
            nearest = best
        if abs(best) <= max(12, tier.window_days):
            total += tier.weight * weights.get(name, 0.4) * math.exp(-max(0.05, k * tier.decay_scale) * abs(best))
    return 1 - math.exp(-total), nearest


@pytest.mark.parametrize("k", [0.2, 0.01])
def test_festival_score_against_loops(spark, k):
    listed = [("Diwali", dt.date(2023, 10, 30), "x", 0.5, 0), (" EID ", dt.date(2024, 2, 29), "x", 0.5, 1),
              ("Eid ul-Fitr", dt.date(2024, 5, 5), "x", 0.5, 2), ("diwali", dt.date(2024, 11, 9), "x", 0.1, 3)]
    table = spark.createDataFrame(listed, "festival_name string, date date, category string, historical_uplift double, row_order int")
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(0, 1100)]
    frame = spark.createDataFrame(
        [(c, d) for d in days for c in ("Snacks", " edible oil", "Other")], "category string, date date"
    )
    out = demand.add_festival_score(frame, table, k=k, with_distance=True).collect()
    dates = {"diwali": (11, 9), "eid": (2, 29)}
    assert len(out) == 3300
    for r in out:
        score, nearest = brute_score(r["date"], r["category"], dates, k)
        assert r["festival_score"] == pytest.approx(score, abs=1e-12), r
        assert r["days_to_event"] == nearest, r


def test_missing_date_has_no_score(spark, festivals):
    frame = spark.createDataFrame([("Snacks", None)], "category string, date date")
    r = demand.add_festival_score(frame, festivals, with_distance=True).first()
    assert (r["festival_score"], r["days_to_event"]) == (0.0, 999)


def test_future_calendar(spark, festivals):
    ends = spark.createDataFrame([("Snacks", dt.date(2024, 2, 27), 41)], "category string, last_date date, last_time_index int")
    out = rows(demand.future_calendar(ends, festivals, 3), "day_index")
    assert [str(r["date"]) for r in out] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert [r["time_index"] for r in out] == [42, 43, 44] and [r["weekday"] for r in out] == [2, 3, 4]
    with pytest.raises(ValueError):
        demand.future_calendar(ends, festivals, 0)


def test_daily_demand_leaves_out_unknown_items(spark):
    day = dt.date(2024, 1, 1)
    sales = spark.createDataFrame([(day, "a", 2), (day, "b", 3), (day, "zz", 9)], "date date, sku_id string, units_sold bigint")
    skus = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "sku_id string, category string")
    assert [(r["category"], r["units_sold"]) for r in demand.daily_demand(sales, skus).collect()] == [("X", 5)]


def test_same_day_history_of_leap_day(spark, series):
    daily = series("2022-02-28", A=[10] * 800)
    ask = spark.createDataFrame([("A", dt.date(2024, 2, 29)), ("A", dt.date(2024, 3, 1))], "category string, date date")
    out = {(str(r["request_date"]), r["year"]): r for r in demand.same_day_history(daily, ask).collect()}
    assert out["2024-02-29", 2023]["sales_volume"] is None and out["2024-02-29", 2023]["demand_trend"] is None
    assert out["2024-03-01", 2023]["sales_volume"] == 10.0
    assert (out["2024-03-01", 2023]["demand_trend"], out["2024-03-01", 2023]["percent_change"]) == ("flat", "+0.0%")


def test_confidence_levels(spark):
    df = spark.createDataFrame([(1,), (7,), (8,), (14,), (15,)], "d int").select(cal.confidence(F.col("d")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["high", "high", "medium", "medium", "low"]


def test_scores_ahead_match_single_days(spark, festivals):
    """Array of a horizon over several years against the per-day lookup."""
    ends = spark.createDataFrame([("Snacks", dt.date(2023, 12, 28)), ("Staples", dt.date(2024, 2, 28))], "category string, last_date date")
    n = 800
    ahead = ends.withColumn("s", cal.festival_scores_ahead(F.col("last_date"), n, F.col("category"), cal.score_table(festivals)))
    for r in ahead.collect():
        assert len(r["s"]) == n
        days = [(r["category"], r["last_date"] + dt.timedelta(days=i + 1)) for i in range(n)]
        rows_ = demand.add_festival_score(spark.createDataFrame(days, "category string, date date"), festivals)
        single = {x["date"]: x["festival_score"] for x in rows_.collect()}
        assert [single[d] for _, d in days] == r["s"]


def test_spread_of_large_and_close_units(spark):
    sales = spark.createDataFrame([(f"s{i % 2}", dt.date(2024, 1, 1 + i), 4 * 10**9 + i) for i in range(3)], "sku_id string, date date, units_sold bigint")
    skus = spark.createDataFrame([("s0", "a"), ("s1", "a")], "sku_id string, category string")
    row = demand.dataset_summary(sales, skus).first()
    assert abs(row["std_units"] - 1) < 1e-6 and row["n_items"] == 2 and row["n_rows"] == 3


def test_rows_of_a_task_are_bounded_by_their_number_not_by_compressed_bytes(spark, monkeypatch):
    from stockcast import session
    from suite.base import Domain

    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    t = Domain(spark, "/root/testdata/sf0.001")
    n = -(-t.table("lineitem").count() // 500)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions")) and t.sales_tasks == n
    daily = demand.daily_demand(t.sales, t.skus, ["sku_id"], t.sales_tasks)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {n})") >= 2 and daily.rdd.getNumPartitions() == n
    assert sorted(daily.collect()) == sorted(demand.daily_demand(t.sales, t.skus, ["sku_id"]).collect())
