"""Daily demand series and the features built on them.

A series is named by ``keys``, the category by default. Raw sales are collapsed
to one row per series and day before anything else, so every window below sees
at most one row per calendar day of a series, however many raw rows it had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stockcast.functions.calendar import (
    days_to_event, distance_table, festival_score, same_day_years_ago, score_table, weekday,
)
from stockcast.functions.numbers import percent_change, py_round, signed_percent

CATEGORY = ("category",)
FEATURES = (
    "time_index", "weekday", "festival_score", "lag_1", "lag_7", "rolling_mean_7", "rolling_std_7",
)
LAG_COLUMNS = ("lag_1", "lag_7", "rolling_mean_7", "rolling_std_7")
STOCKOUT_LEVEL = 5.0
WINDOW_DAYS = 7


def daily_demand(sales: DataFrame, skus: DataFrame, keys: Sequence[str] = CATEGORY, tasks: int | None = None) -> DataFrame:
    """Units per series and day; days without sales are not filled in.

    ``sales`` holds one row per (date, sku_id), so an item contributes at most
    one row per day to the join. The item side is broadcast by Spark only when
    its size allows; otherwise both sides are hashed on sku_id. With ``tasks``
    the sales are dealt over so many partitions by item, which the join, the
    totals and later windows of series by item then share: with that many items
    the rows of a task are bounded by this number alone.
    """
    if tasks:
        sales = sales.repartition(tasks, "sku_id")
    dimension = skus.select(*dict.fromkeys(["sku_id", *keys]))
    joined = sales.join(dimension, "sku_id")
    return joined.groupBy(*keys, "date").agg(F.sum("units_sold").alias("units_sold"))


def _series(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("date")


def add_time_index(daily: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """0-based position by date within the series (not days since its start)."""
    return daily.withColumn("time_index", F.row_number().over(_series(keys)) - 1)


def add_weekday(df: DataFrame, one_hot: bool = False) -> DataFrame:
    """Weekday under both names; one-hot gives all seven columns in every case."""
    out = df.withColumn("day_of_week", weekday(F.col("date"))).withColumn("weekday", F.col("day_of_week"))
    if one_hot:
        out = out.withColumns({f"dow_{i}": (F.col("day_of_week") == i).cast("int") for i in range(7)})
    return out


def add_festival_score(
    df: DataFrame, festivals: DataFrame, category: str = "category", k: float = 0.2, with_distance: bool = False
) -> DataFrame:
    """Festival proximity per row, looked up by kind of category and day of the year."""
    columns = {"festival_score": festival_score(F.col("date"), F.col(category), score_table(festivals, k))}
    if with_distance:
        columns["days_to_event"] = days_to_event(F.col("date"), distance_table(festivals))
    return df.withColumns(columns)


def add_lag_features(
    daily: DataFrame, keys: Sequence[str] = CATEGORY, stockout_level: float = STOCKOUT_LEVEL, drop: bool = True
) -> DataFrame:
    """Lags by row and rolling statistics over the current and six earlier rows.

    The rolling features include the day to be explained, so they carry part of
    the target when a model is trained on them; at forecast time they hold
    earlier days only. That is the behaviour results are compared with, so it is
    kept. Rows without full history (the first seven of a series) are dropped.
    """
    order = _series(keys)
    frame = order.rowsBetween(-(WINDOW_DAYS - 1), 0)
    full = F.count("units_sold").over(frame) == WINDOW_DAYS
    low = F.coalesce(F.col("units_sold").cast("double"), F.lit(0.0)) <= stockout_level
    out = daily.withColumn("potential_stockout", low).withColumns(
        {
            "lag_1": F.lag("units_sold", 1).over(order),
            "lag_7": F.lag("units_sold", 7).over(order),
            "rolling_mean_7": F.when(full, F.avg("units_sold").over(frame)),
            "rolling_std_7": F.when(full, F.stddev_samp("units_sold").over(frame)),
            "stockout_suspected": full & (F.sum(F.col("potential_stockout").cast("int")).over(frame) > 2),
        }
    )
    return out.na.drop(subset=[*LAG_COLUMNS, "units_sold"]) if drop else out


def training_frame(
    daily: DataFrame,
    festivals: DataFrame,
    keys: Sequence[str] = CATEGORY,
    category: str = "category",
    one_hot: bool = False,
    k: float = 0.2,
    stockout_level: float = STOCKOUT_LEVEL,
) -> DataFrame:
    """Features and target of all series.

    Index and lags share one sort per series; the festival score is added last,
    on the rows that remain (it is never null, so no second filter follows).
    """
    indexed = add_time_index(daily, keys)
    lagged = add_lag_features(indexed, keys, stockout_level)
    return add_festival_score(add_weekday(lagged, one_hot), festivals, category, k)


def future_calendar(ends: DataFrame, festivals: DataFrame, n_days: int, category: str = "category", k: float = 0.2) -> DataFrame:
    """The next ``n_days`` per series from (last_date, last_time_index)."""
    check_horizon(n_days)
    days = F.posexplode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", n_days)))
    rows = ends.select("*", days.alias("pos", "date")).withColumn("time_index", F.col("last_time_index") + F.col("pos") + 1)
    rows = rows.withColumn("day_index", F.col("pos") + 1).drop("pos", "last_date", "last_time_index")
    return add_festival_score(rows.withColumn("weekday", weekday(F.col("date"))), festivals, category, k)


def check_horizon(n_days: int) -> None:
    if n_days <= 0:
        raise ValueError("n_days must be a positive integer")


def series_ends(train: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    return train.groupBy(*keys).agg(F.max("date").alias("last_date"), F.max("time_index").alias("last_time_index"))


def stockout_days(train: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Training summary: rows used and low-demand days among them."""
    return train.groupBy(*keys).agg(
        F.count("*").alias("training_rows"),
        F.sum(F.col("potential_stockout").cast("int")).alias("stockout_days_detected"),
    )


def yearly_mean(daily: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    return daily.groupBy(*keys, F.year("date").alias("year")).agg(F.avg("units_sold").alias("yearly_mean"))


def recent_level(daily: DataFrame, keys: Sequence[str] = CATEGORY, rows: int = 30) -> DataFrame:
    """Mean and sample deviation of the last ``rows`` days of each series."""
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("date"))
    recent = daily.withColumn("_age", F.row_number().over(newest_first)).filter(F.col("_age") <= rows)
    return recent.groupBy(*keys).agg(
        F.avg("units_sold").alias("recent_mean"),
        F.stddev_samp("units_sold").alias("recent_std"),
        F.count("*").alias("recent_rows"),
    )


def dataset_summary(sales: DataFrame, skus: DataFrame) -> DataFrame:
    """Spread of units per category over item-day rows, unknown items included."""
    joined = sales.join(skus.select("sku_id", "category"), "sku_id", "left")
    # the distinct count makes Spark aggregate per item first; moments are merged around their means, so nothing cancels
    mean, std = F.avg("units_sold"), F.stddev_samp("units_sold")
    return joined.groupBy("category").agg(
        mean.alias("mean_units"),
        F.min("units_sold").alias("min_units"), F.max("units_sold").alias("max_units"),
        std.alias("std_units"), F.sum("units_sold").alias("total_units"),
        (std / F.nullif(mean, F.lit(0.0)) * 100).alias("cv_percent"),
        F.count_distinct("sku_id").alias("n_items"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("units_sold").alias("n_rows"),
    )


def dataset_totals(sales: DataFrame, skus: DataFrame) -> DataFrame:
    """Items, categories, sales rows and date range of the whole dataset."""
    items = skus.agg(F.count_distinct("sku_id").alias("n"), F.count_distinct("category").alias("c"))
    return sales.agg(
        F.count("*").alias("sales_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ).select(
        items.select("n").scalar().alias("n_skus"),
        items.select("c").scalar().alias("n_categories"),
        "sales_rows", "first_date", "last_date",
    )


def same_day_history(daily: DataFrame, requests: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Demand on the same calendar day one and two years before each request.

    ``requests`` holds (keys, date). One row per request and year back; units
    are null without a match, also for 29 February in a common year.
    """
    wanted = requests.select(
        *keys, F.col("date").alias("request_date"), F.explode(F.array(F.lit(1), F.lit(2))).alias("years_back")
    ).withColumn(
        "target_date",
        F.when(F.col("years_back") == 1, same_day_years_ago(F.col("request_date"), 1)).otherwise(
            same_day_years_ago(F.col("request_date"), 2)
        ),
    ).withColumn("year", F.year("request_date") - F.col("years_back"))
    observed = daily.select(*keys, F.col("date").alias("target_date"), F.col("units_sold").alias("sales_volume"))
    means = yearly_mean(daily, keys)
    joined = wanted.join(observed, [*keys, "target_date"], "left").join(means, [*keys, "year"], "left")
    change = percent_change(F.col("sales_volume"), F.coalesce("yearly_mean", F.col("sales_volume").cast("double")))
    trend = F.when(change > 3, "up").when(change < -3, "down").otherwise("flat")
    seen = F.col("sales_volume").isNotNull()
    return joined.select(
        *keys, "request_date", "year",
        py_round(F.col("sales_volume").cast("double"), 2).alias("sales_volume"),
        F.when(seen, trend).alias("demand_trend"),
        F.when(seen, change).alias("change_percent"),
        F.when(seen, signed_percent(change)).alias("percent_change"),
    )

