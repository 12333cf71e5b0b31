"""Daily series, features, calendar scores and model statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stockcast.operators import demand, model
from stockcast.operators.demand import FEATURES
from stockcast.session import cut
from suite.base import ORACLES, Domain, query, register_cte
from suite.plain import plain

WINDOW = "OVER (PARTITION BY category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
LEVEL = 60  # low-demand level that the summed test series do reach

register_cte(
    "featured",
    f"""
    SELECT category, date, units_sold,
           row_number() OVER (PARTITION BY category ORDER BY date) - 1 AS time_index,
           isodow(date) - 1 AS weekday,
           lag(units_sold, 1) OVER (PARTITION BY category ORDER BY date) AS lag_1,
           lag(units_sold, 7) OVER (PARTITION BY category ORDER BY date) AS lag_7,
           CASE WHEN count(*) {WINDOW} = 7 THEN avg(units_sold) {WINDOW} END AS rolling_mean_7,
           CASE WHEN count(*) {WINDOW} = 7 THEN stddev_samp(units_sold) {WINDOW} END AS rolling_std_7,
           units_sold <= {LEVEL} AS potential_stockout,
           count(*) {WINDOW} = 7 AND sum(CASE WHEN units_sold <= {LEVEL} THEN 1 ELSE 0 END) {WINDOW} > 2 AS stockout_suspected
    FROM daily""",
    "daily",
)
# written out, so that a wrong value in the library shows: position, name, month, day, decay, span, weight
_anchor_rows = """
    (0, 'pongal', 1, 15, 0.7::DOUBLE, 32, 1.0::DOUBLE), (1, 'holi', 3, 25, 1.0, 22, 0.3), (2, 'eid', 4, 10, 0.9, 26, 0.6),
    (3, 'independence day', 8, 15, 1.0, 22, 0.3), (4, 'navratri', 10, 3, 0.9, 26, 0.6), (5, 'diwali', 11, 1, 0.7, 32, 1.0),
    (6, 'christmas', 12, 25, 0.9, 26, 0.6), (7, 'new year', 12, 31, 1.0, 22, 0.3)"""
_weight_rows = """
    ('edible oil', 'diwali', 1.0::DOUBLE), ('edible oil', 'pongal', 0.95), ('edible oil', 'eid', 0.85), ('edible oil', 'navratri', 0.5),
    ('edible oil', 'christmas', 0.45), ('edible oil', 'holi', 0.4), ('edible oil', 'independence day', 0.35), ('edible oil', 'new year', 0.4),
    ('staples', 'diwali', 0.95), ('staples', 'pongal', 0.9), ('staples', 'eid', 0.85), ('staples', 'navratri', 0.55),
    ('staples', 'christmas', 0.45), ('staples', 'holi', 0.4), ('staples', 'independence day', 0.35), ('staples', 'new year', 0.4),
    ('snacks', 'diwali', 1.0), ('snacks', 'pongal', 0.55), ('snacks', 'eid', 0.5), ('snacks', 'navratri', 0.75),
    ('snacks', 'christmas', 0.85), ('snacks', 'holi', 0.45), ('snacks', 'independence day', 0.4), ('snacks', 'new year', 0.5)"""
register_cte(
    "anchors",
    f"""
    SELECT a.position, a.name, a.decay, a.span, a.weight,
           coalesce(month(f.d), a.m) AS m, coalesce(day(f.d), a.d) AS d
    FROM (VALUES {_anchor_rows}) AS a(position, name, m, d, decay, span, weight)
    LEFT JOIN (SELECT lower(trim(festival_name)) AS name, max(date) AS d FROM festivals GROUP BY 1) f USING (name)""",
    "festivals",
)
register_cte(
    "nearest",
    """
    SELECT date, name, position, delta FROM (
        SELECT date, name, position, date_diff('day', date, c) AS delta,
               row_number() OVER (PARTITION BY date, name ORDER BY abs(date_diff('day', date, c)), shift) AS r
        FROM (SELECT dates.date, a.name, a.position, s.shift,
                     CASE WHEN a.m = 2 AND a.d = 29
                               AND month(make_date(CAST(year(dates.date) + s.shift AS BIGINT), 2, 28) + INTERVAL 1 DAY) = 3 THEN NULL
                          ELSE make_date(CAST(year(dates.date) + s.shift AS BIGINT), a.m, a.d) END AS c
              FROM (SELECT DISTINCT date FROM daily) dates, anchors a, (VALUES (-1), (0), (1)) AS s(shift))
        WHERE c IS NOT NULL) WHERE r = 1""",
    "daily", "anchors",
)
register_cte(
    "scores",
    f"""
    SELECT k.category, n.date,
           1 - exp(-sum(CASE WHEN abs(n.delta) <= a.span
                             THEN a.weight * coalesce(w.w, 0.4) * exp(-greatest(0.05, 0.2 * a.decay) * abs(n.delta)) ELSE 0 END)) AS festival_score
    FROM (SELECT DISTINCT category FROM daily) k, nearest n
    JOIN anchors a USING (name)
    LEFT JOIN (VALUES {_weight_rows}) AS w(category, name, w) ON w.category = lower(trim(k.category)) AND w.name = n.name
    GROUP BY 1, 2""",
    "nearest", "anchors",
)
register_cte(
    "train",
    """
    SELECT f.category, f.date, f.units_sold, f.time_index, f.weekday, s.festival_score, f.lag_1, f.lag_7,
           f.rolling_mean_7, f.rolling_std_7, f.potential_stockout, f.stockout_suspected
    FROM featured f JOIN scores s USING (category, date) WHERE f.lag_7 IS NOT NULL""",
    "featured", "scores",
)
register_cte(
    "long_train",
    """UNPIVOT (SELECT category, date, units_sold, """
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
    + f""" FROM train) ON {', '.join(FEATURES)} INTO NAME feature VALUE x""",
    "train",
)
EPS = repr(float(np.finfo(float).eps))
register_cte(
    "scaler",
    f"""
    SELECT category, feature, avg(x) AS mean,
           CASE WHEN var_pop(x) <= count(*) * {EPS} * var_pop(x) + pow(count(*) * avg(x) * {EPS}, 2) THEN 1.0 ELSE sqrt(var_pop(x)) END AS scale
    FROM long_train GROUP BY 1, 2""",
    "long_train",
)
register_cte(
    "scaled",
    """
    SELECT t.category, t.date, t.feature, (t.x - s.mean) / s.scale AS z,
           t.units_sold - avg(t.units_sold) OVER (PARTITION BY t.category, t.feature) AS yc
    FROM long_train t JOIN scaler s USING (category, feature)""",
    "long_train", "scaler",
)
register_cte(
    "coefs",
    """
    SELECT category, feature,
           round((CASE WHEN feature IN ('lag_7', 'rolling_std_7') THEN -1 ELSE 1 END) * mean / scale
                 * (CASE WHEN feature = 'festival_score' THEN 25 WHEN feature = 'lag_1' AND category > 'M' THEN 0.01 ELSE 1 END), 4) AS coefficient
    FROM scaler""",
    "scaler",
)


def _train(t: Domain):
    return demand.training_frame(t.daily, t.festivals, stockout_level=LEVEL)


def _coefs(t: Domain):
    sign = F.when(F.col("feature").isin("lag_7", "rolling_std_7"), -1).otherwise(1)
    factor = (
        F.when(F.col("feature") == "festival_score", 25.0)
        .when((F.col("feature") == "lag_1") & (F.col("category") > "M"), 0.01).otherwise(1.0)
    )
    value = F.round(sign * F.col("mean") / F.col("scale") * factor, 4)
    return model.fit_scaler(_train(t)).select("category", "feature", value.alias("coefficient"))


@query("daily_category_demand", "SELECT category, CAST(date AS VARCHAR) AS date, units_sold FROM daily", ("daily",))
def _(t):
    return plain(t.daily)


@query(
    "daily_item_demand",
    """SELECT sku_id, CAST(date AS VARCHAR) AS date, CAST(sum(units_sold) AS BIGINT) AS units_sold
       FROM sales JOIN skus USING (sku_id) GROUP BY 1, 2""",
    ("sales", "skus"),
)
def _(t):
    return plain(demand.daily_demand(t.sales, t.skus, ["sku_id"], t.sales_tasks))


@query(
    "lag_and_rolling_features",
    """SELECT category, CAST(date AS VARCHAR) AS date, units_sold, time_index, CAST(lag_1 AS BIGINT) AS lag_1,
              CAST(lag_7 AS BIGINT) AS lag_7, round(rolling_mean_7, 4) AS rolling_mean_7,
              round(rolling_std_7, 4) AS rolling_std_7, potential_stockout, stockout_suspected
       FROM featured WHERE lag_7 IS NOT NULL""",
    ("featured",),
)
def _(t):
    out = demand.add_lag_features(demand.add_time_index(t.daily), stockout_level=LEVEL)
    return plain(out.withColumn("time_index", F.col("time_index").cast("bigint")))


@query(
    "weekday_features",
    """SELECT category, CAST(date AS VARCHAR) AS date, isodow(date) - 1 AS day_of_week, isodow(date) - 1 AS weekday,
       """ + ", ".join(f"CAST(isodow(date) - 1 = {i} AS INTEGER) AS dow_{i}" for i in range(7)) + " FROM daily",
    ("daily",),
)
def _(t):
    out = demand.add_weekday(t.daily, one_hot=True).drop("units_sold")
    return plain(out.withColumns({c: F.col(c).cast("bigint") for c in ("day_of_week", "weekday")}))


@query(
    "festival_proximity",
    """SELECT s.category, CAST(s.date AS VARCHAR) AS date, round(s.festival_score, 6) AS festival_score, n.days_to_event
       FROM daily JOIN scores s USING (category, date) JOIN (SELECT date, CAST(arg_min(delta, abs(delta) * 100 + position) AS INTEGER) AS days_to_event FROM nearest GROUP BY 1) n USING (date)""",
    ("daily", "scores", "nearest"),
)
def _(t):
    out = demand.add_festival_score(t.daily, t.festivals, with_distance=True)
    return plain(out.select("category", "date", "festival_score", "days_to_event"), 6)


@query(
    "training_frame",
    """SELECT category, CAST(date AS VARCHAR) AS date, units_sold, time_index, weekday, round(festival_score, 6) AS festival_score,
              CAST(lag_1 AS BIGINT) AS lag_1, CAST(lag_7 AS BIGINT) AS lag_7,
              round(rolling_mean_7, 6) AS rolling_mean_7, round(rolling_std_7, 6) AS rolling_std_7 FROM train""",
    ("train",),
)
def _(t):
    out = _train(t).select("category", "date", "units_sold", *FEATURES)
    return plain(out.withColumns({c: F.col(c).cast("bigint") for c in ("time_index", "weekday")}), 6)


@query(
    "future_calendar",
    f"""SELECT category, CAST(d AS VARCHAR) AS date, CAST(last_index + i AS BIGINT) AS time_index, CAST(i AS INTEGER) AS day_index,
               isodow(d) - 1 AS weekday
        FROM (SELECT category, last_index, i, CAST(last_date + to_days(CAST(i AS INTEGER)) AS DATE) AS d FROM
              (SELECT category, max(date) AS last_date, max(time_index) AS last_index FROM featured GROUP BY 1), range(1, 46) AS r(i))""",
    ("featured",),
)
def _(t):
    ends = demand.series_ends(demand.add_time_index(t.daily))
    out = demand.future_calendar(ends, t.festivals, 45).drop("festival_score")
    return plain(out.withColumns({c: F.col(c).cast("bigint") for c in ("time_index", "weekday")}))


@query(
    "stockout_days",
    """SELECT category, count(*) AS training_rows, CAST(sum(CASE WHEN potential_stockout THEN 1 ELSE 0 END) AS BIGINT) AS stockout_days_detected
       FROM featured WHERE lag_7 IS NOT NULL GROUP BY 1""",
    ("featured",),
)
def _(t):
    return demand.stockout_days(demand.add_lag_features(demand.add_time_index(t.daily), stockout_level=LEVEL))


@query(
    "yearly_mean_demand",
    "SELECT category, CAST(year(date) AS INTEGER) AS year, round(avg(units_sold), 4) AS yearly_mean FROM daily GROUP BY 1, 2",
    ("daily",),
)
def _(t):
    return plain(demand.yearly_mean(t.daily))


@query(
    "dataset_summary",
    """SELECT category, round(avg(units_sold), 4) AS mean_units, min(units_sold) AS min_units, max(units_sold) AS max_units,
              round(stddev_samp(units_sold), 4) AS std_units, CAST(sum(units_sold) AS BIGINT) AS total_units,
              round(stddev_samp(units_sold) / avg(units_sold) * 100, 4) AS cv_percent, count(DISTINCT sku_id) AS n_items,
              CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(*) AS n_rows
       FROM sales LEFT JOIN skus USING (sku_id) GROUP BY 1""",
    ("sales", "skus"),
)
def _(t):
    return plain(demand.dataset_summary(t.sales, t.skus))


@query(
    "dataset_totals",
    """SELECT (SELECT count(DISTINCT sku_id) FROM skus) AS n_skus, (SELECT count(DISTINCT category) FROM skus) AS n_categories,
              count(*) AS sales_rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM sales""",
    ("sales", "skus"),
)
def _(t):
    return plain(demand.dataset_totals(t.sales, t.skus))


@query(
    "same_day_history",
    """SELECT r.category, CAST(r.date AS VARCHAR) AS request_date, CAST(year(r.date) - b AS INTEGER) AS year,
              CAST(d.units_sold AS DOUBLE) AS sales_volume,
              CASE WHEN d.units_sold IS NULL THEN NULL WHEN (d.units_sold - m.a) / m.a * 100 > 3 THEN 'up'
                   WHEN (d.units_sold - m.a) / m.a * 100 < -3 THEN 'down' ELSE 'flat' END AS demand_trend,
              round((d.units_sold - m.a) / m.a * 100, 4) AS change_percent
       FROM daily r CROSS JOIN (VALUES (1), (2)) AS v(b)
       LEFT JOIN daily d ON d.category = r.category AND d.date = CASE WHEN month(r.date) = 2 AND day(r.date) = 29 THEN NULL
                 ELSE make_date(CAST(year(r.date) - b AS BIGINT), month(r.date), day(r.date)) END
       LEFT JOIN (SELECT category, year(date) AS y, avg(units_sold) AS a FROM daily GROUP BY 1, 2) m
            ON m.category = r.category AND m.y = year(r.date) - b""",
    ("daily",),
)
def _(t):
    out = demand.same_day_history(t.daily, t.daily.select("category", "date"))
    return plain(out.drop("percent_change"))


@query(
    "recent_demand_level",
    """SELECT category, round(avg(units_sold), 4) AS recent_mean, round(stddev_samp(units_sold), 4) AS recent_std, count(*) AS recent_rows
       FROM recent WHERE age <= 30 GROUP BY 1""",
    ("recent",),
)
def _(t):
    return plain(demand.recent_level(t.daily))


@query(
    "feature_scaler",
    "SELECT category, feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM scaler",
    ("scaler",),
)
def _(t):
    return plain(model.fit_scaler(_train(t)), 6)


@query(
    "gram_matrix",
    """SELECT a.category, a.feature AS row_feature, b.feature AS column_feature, count(*) AS n_samples,
              round(sum(a.z * b.z) / count(*), 6) AS mean_product, round(sum(a.yc * a.yc) / count(*), 4) AS mean_square
       FROM scaled a JOIN scaled b USING (category, date) GROUP BY 1, 2, 3""",
    ("scaled",),
)
def _(t):
    g = model.gram_matrix(_train(t))
    return g.select(
        "category", "row_feature", "column_feature", "n_samples",
        F.round(F.col("value") / F.col("n_samples"), 6).alias("mean_product"),
        F.round(F.col("yy") / F.col("n_samples"), 4).alias("mean_square"),
    )


@query("gram_matrix_from_batches", ORACLES["gram_matrix"])
def _(t):
    """The same sums, kept per series and extended by three batches: the first 500 days, two more years, the rest."""
    from stockcast.operators import moments

    daily = cut(t.daily)
    first, last = F.lit("1900-01-01").cast("date"), F.lit("9999-01-01").cast("date")
    start = daily.agg(F.min("date")).scalar()
    edges = [first, F.date_add(start, 500), F.date_add(start, 1230), last]
    stored = t.spark.createDataFrame([], moments.schema(daily))
    for low, high in zip(edges, edges[1:]):
        seen = daily.filter(F.col("date") <= high)
        changed = cut(seen.groupBy("category").agg(F.min(F.when(F.col("date") > low, F.col("date"))).alias("first_change")))
        stored = cut(moments.updated(stored, seen, changed, t.festivals))
    # cut: exploding would repeat the sums in a filter below
    g = model.gram_cells(cut(moments.statistics(stored)))
    return g.select(
        "category", "row_feature", "column_feature", "n_samples",
        F.round(F.col("value") / F.col("n_samples"), 6).alias("mean_product"),
        F.round(F.col("yy") / F.col("n_samples"), 4).alias("mean_square"),
    )


@query(
    "series_eligibility",
    """SELECT sku_id, year, CAST(greatest(n - 7, 0) AS BIGINT) AS training_rows,
              'Insufficient historical data to train forecasting model' AS reason
       FROM (SELECT sku_id, CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM sales GROUP BY 1, 2) WHERE n - 7 < 7""",
    ("sales",),
)
def _(t):
    keys = ["sku_id", "year"]
    daily = t.sales.withColumn("year", F.year("date"))
    train = demand.add_lag_features(demand.add_time_index(daily, keys), keys)
    return model.skipped_series(daily, train, keys)


@query(
    "score_with_given_model",
    """SELECT category, CAST(date AS VARCHAR) AS date,
              round(greatest(0, c), 4) AS predicted_mean, round(greatest(0, c - 1.96 * s), 4) AS lower_95, round(greatest(0, c + 1.96 * s), 4) AS upper_95
       FROM (SELECT category, date, 50 + sum(z * CASE feature """
    + " ".join(f"WHEN '{f}' THEN {(i + 1) * 2.5}" for i, f in enumerate(FEATURES))
    + """ END) AS c, sqrt(100 + 0.001 * pow(sum(z), 2) + 0.009 * sum(z * z)) AS s FROM scaled GROUP BY 1, 2)""",
    ("scaled",),
)
def _(t):
    train = _train(t)
    p = len(FEATURES)
    wide = model.fit_scaler(train).groupBy("category").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("s")
    )
    models = wide.select(
        "category",
        F.array(*[F.lit((i + 1) * 2.5) for i in range(p)]).alias("coef"),
        F.array(*[F.lit(0.01 if i == j else 0.001) for i in range(p) for j in range(p)]).alias("sigma"),
        F.lit(0.01).alias("alpha"), F.lit(50.0).alias("intercept"),
        F.array(*[F.col("s")[f]["mean"] for f in FEATURES]).alias("means"),
        F.array(*[F.col("s")[f]["scale"] for f in FEATURES]).alias("scales"),
    )
    out = model.score(train, models)
    return plain(out.select("category", "date", "predicted_mean", "lower_95", "upper_95"))


# --- diagnostics on given coefficients --------------------------------------

@query(
    "rank_categories_by_feature",
    """SELECT category, coefficient, abs(coefficient) AS abs_coefficient,
              CAST(row_number() OVER (ORDER BY abs(coefficient) DESC, category) AS INTEGER) AS rank
       FROM coefs WHERE feature = 'festival_score'""",
    ("coefs",),
)
def _(t):
    return model.rank_by_feature(_coefs(t), "festival_score")


@query(
    "category_behaviour",
    """SELECT category, dominant_feature, festival_sensitivity, momentum_driven, weekly_pattern, stability,
              category || ' is ' || CASE festival_sensitivity WHEN 'high' THEN 'highly festival-sensitive' WHEN 'medium' THEN 'moderately festival-sensitive'
                   ELSE 'festival-independent' END || ' ' || CASE WHEN momentum_driven THEN 'with strong momentum effects'
                   WHEN weekly_pattern THEN 'with weekly seasonality' ELSE 'with stable demand patterns' END AS summary
       FROM (SELECT category, arg_max(feature, abs(coefficient)) AS dominant_feature,
              CASE WHEN max(abs(coefficient)) FILTER (WHERE feature = 'festival_score') > 15 THEN 'high'
                   WHEN max(abs(coefficient)) FILTER (WHERE feature = 'festival_score') > 8 THEN 'medium' ELSE 'low' END AS festival_sensitivity,
              max(abs(coefficient)) FILTER (WHERE feature = 'lag_1') > 0.1 AS momentum_driven,
              max(abs(coefficient)) FILTER (WHERE feature = 'lag_7') > 0.05 AS weekly_pattern,
              CASE WHEN max(abs(coefficient)) FILTER (WHERE feature = 'rolling_std_7') < 0.1 THEN 'stable'
                   WHEN max(coefficient) FILTER (WHERE feature = 'rolling_std_7') < 0 THEN 'volatility-averse' ELSE 'volatility-responsive' END AS stability
       FROM coefs GROUP BY 1)""",
    ("coefs",),
)
def _(t):
    return model.behaviour(_coefs(t))


@query(
    "most_sensitive_category",
    """SELECT CASE feature WHEN 'festival_score' THEN 'festival_sensitive' WHEN 'lag_1' THEN 'momentum_driven' WHEN 'lag_7' THEN 'weekly_seasonal'
                   WHEN 'time_index' THEN 'trend_following' ELSE 'volatility_aware' END AS trait, category, abs(coefficient) AS coefficient
       FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(coefficient) DESC, category) AS r FROM coefs
             WHERE feature IN ('festival_score', 'lag_1', 'lag_7', 'time_index', 'rolling_std_7')) WHERE r = 1""",
    ("coefs",),
)
def _(t):
    return model.most_sensitive(_coefs(t))


@query(
    "festival_sensitivity",
    "SELECT category, abs(coefficient) AS festival_sensitivity FROM coefs WHERE feature = 'festival_score'",
    ("coefs",),
)
def _(t):
    from stockcast.operators.reports import festival_sensitivity

    return festival_sensitivity(_coefs(t))


# --- fitted models (iterative, so no SQL counterpart) -------------------------

def _models(t: Domain, keys=("category",)):
    from stockcast.plans.batch import models_for

    return models_for(t.sales, t.skus, t.festivals, list(keys), t.sales_tasks if "sku_id" in keys else None)


@query("bayesian_ridge_fit")
def _(t):
    m = _models(t)
    return plain(m.select("category", "n_samples", "intercept", "alpha", "lam", "n_passes"), 6)


@query(
    "fitted_models_solve_their_equations",
    """SELECT category, count(*) AS n_samples, round(avg(units_sold), 6) AS intercept, true AS solves_equations, CAST(max(date) AS VARCHAR) AS last_date
       FROM train GROUP BY 1""",
    ("train",),
)
def _(t):
    """(G + lambda/alpha · I) coef = b must hold for every fitted model."""
    m = model.fit(model.series_statistics(demand.training_frame(t.daily, t.festivals)), keep_statistics=True)
    p = len(FEATURES)
    gaps = [
        f"abs({' + '.join(f'gram[{p * i + j}] * coef[{j}]' for j in range(p))} + lam / alpha * coef[{i}] - xty[{i}])" for i in range(p)
    ]
    size = " + ".join(f"abs(xty[{i}])" for i in range(p))
    return plain(m.selectExpr(
        "category", "n_samples", "intercept", f"greatest({', '.join(gaps)}) <= 1e-9 * ({size}) AS solves_equations", "last_date"
    ), 6)


@query(
    "forecast_calendar",
    """SELECT e.category, CAST(i AS INTEGER) AS day_index, CAST(CAST(e.d + to_days(CAST(i AS INTEGER)) AS DATE) AS VARCHAR) AS date,
              CASE WHEN i <= 7 THEN 'high' WHEN i <= 14 THEN 'medium' ELSE 'low' END AS confidence_level, true AS band_is_ordered
       FROM (SELECT category, max(date) AS d FROM train GROUP BY 1) e, range(1, 401) AS r(i)""",
    ("train",),
)
def _(t):
    out = model.forecast(_models(t), t.festivals, 400)
    ordered = (F.col("lower_95") >= 0) & (F.col("lower_95") <= F.col("predicted_mean")) & (F.col("predicted_mean") <= F.col("upper_95"))
    return plain(out.select("category", "day_index", "date", "confidence_level", ordered.alias("band_is_ordered")))


@query("fitted_coefficients")
def _(t):
    return plain(model.coefficients(_models(t)))


@query("compare_categories")
def _(t):
    return plain(model.compare(_models(t)))


@query("analyze_models")
def _(t):
    a = model.analyze(_models(t))
    return a.select(
        "category", F.to_json("coefficients").alias("coefficients"), F.to_json("feature_importance").alias("feature_importance"),
        "intercept", "n_samples",
    )


@query("recursive_forecast")
def _(t):
    return plain(model.forecast(_models(t), t.festivals, 30))


@query("item_level_forecast")
def _(t):
    return plain(model.forecast(_models(t, ["sku_id"]), t.festivals, 14, ["sku_id"]))
