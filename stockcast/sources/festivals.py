"""Festival dimension: the built-in 2026 calendar, roll-up and export shapes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockcast.functions.calendar import days_until
from stockcast.functions.text import comma_items
from stockcast.schemas import FESTIVALS

# Festival, day in 2026, and expected demand increase per category.
CALENDAR_2026 = {
    ("Holi", "2026-03-13"): {"Snacks": 0.55, "Staples": 0.20},
    ("Eid ul-Fitr", "2026-03-31"): {"Staples": 0.48, "Edible Oil": 0.40},
    ("Ram Navami", "2026-04-06"): {"Staples": 0.22},
    ("Akshaya Tritiya", "2026-04-29"): {"Snacks": 0.30, "Staples": 0.18},
    ("Eid ul-Adha", "2026-06-07"): {"Staples": 0.42, "Edible Oil": 0.35},
    ("Independence Day", "2026-08-15"): {"Snacks": 0.25},
    ("Raksha Bandhan", "2026-08-09"): {"Snacks": 0.40, "Staples": 0.15},
    ("Janmashtami", "2026-08-16"): {"Staples": 0.28, "Edible Oil": 0.20},
    ("Ganesh Chaturthi", "2026-08-27"): {"Snacks": 0.50, "Staples": 0.25},
    ("Navratri", "2026-09-22"): {"Staples": 0.38, "Edible Oil": 0.28},
    ("Dussehra", "2026-10-02"): {"Snacks": 0.35, "Staples": 0.22},
    ("Dhanteras", "2026-10-20"): {"Snacks": 0.45, "Staples": 0.30, "Edible Oil": 0.35},
    ("Diwali", "2026-10-21"): {"Snacks": 0.80, "Staples": 0.50, "Edible Oil": 0.60},
    ("Bhai Dooj", "2026-10-23"): {"Snacks": 0.22},
    ("Christmas", "2026-12-25"): {"Snacks": 0.30},
}


def calendar_rows() -> list[tuple[str, dt.date, str, float]]:
    return [
        (name, dt.date.fromisoformat(day), category, uplift)
        for (name, day), uplifts in CALENDAR_2026.items()
        for category, uplift in uplifts.items()
    ]


def festival_dim(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The festival table; ``row_order`` keeps the listing order of the rows."""
    listed = calendar_rows() if rows is None else rows
    numbered = [(*row, i) for i, row in enumerate(listed)]
    return spark.createDataFrame(numbered, schema=f"{FESTIVALS}, row_order int")


def seed_if_empty(existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """The stored rows, or the defaults when the table has none."""
    has_rows = existing.select(F.lit(1)).limit(1).agg(F.count("*")).scalar()
    return existing.unionByName(defaults.filter(has_rows == 0), allowMissingColumns=True)


def in_period(festivals: DataFrame, month: int | None = None, year: int | None = None) -> DataFrame:
    out = festivals
    if month is not None:
        out = out.filter(F.month("date") == month)
    if year is not None:
        out = out.filter(F.year("date") == year)
    return out


def rollup(festivals: DataFrame, as_of: Column) -> DataFrame:
    """One row per festival and day with its categories and their uplifts.

    Categories stay in first-seen order, the last uplift of a category wins.
    Duplicate rows are reduced per (festival, day, category) first, so the
    arrays hold each category once.
    """
    exploded = festivals.select(
        "festival_name", "date", "historical_uplift", "row_order", F.explode(comma_items(F.col("category"))).alias("cat")
    )
    per_category = exploded.groupBy("festival_name", "date", "cat").agg(
        F.min("row_order").alias("first_seen"),
        F.max_by("historical_uplift", "row_order").alias("uplift"),
        F.max("historical_uplift").alias("top"),
    )
    listed = F.array_sort(F.collect_list(F.struct("first_seen", "cat", "uplift")))
    merged = per_category.groupBy("festival_name", "date").agg(listed.alias("listed"), F.max("top").alias("top"))
    max_uplift = F.greatest(F.lit(0.0), F.col("top"))
    return merged.select(
        "festival_name",
        "date",
        F.array_join(F.col("listed.cat"), ",").alias("category"),
        F.col("listed.cat").alias("categories"),
        F.map_from_arrays(F.col("listed.cat"), F.col("listed.uplift")).alias("category_uplifts"),
        max_uplift.alias("historical_uplift"),
        (F.lit(1.0) + max_uplift).alias("demand_multiplier"),
        days_until(F.col("date"), as_of).alias("days_until"),
    )


def expand(merged: DataFrame) -> DataFrame:
    """Nested export form back to one row per category.

    Items without an uplift map (older form) keep their comma-joined category.
    """
    legacy = F.map_from_arrays(F.array(F.coalesce("category", F.lit(""))), F.array("historical_uplift"))
    uplifts = F.when(F.size("category_uplifts") > 0, F.col("category_uplifts")).otherwise(legacy)
    return merged.select("festival_name", "date", F.explode(uplifts).alias("category", "historical_uplift"))


def on_date(festivals: DataFrame) -> DataFrame:
    """First listed row per day, whatever its category."""
    first = F.struct("date", "row_order")
    return festivals.groupBy("date").agg(
        F.min_by("festival_name", first).alias("festival_name"),
        F.min_by("historical_uplift", first).alias("uplift"),
    )


def next_festival(festivals: DataFrame, as_of: Column, month: int, year: int) -> DataFrame:
    """The next festival from ``as_of`` on, preferring one outside the shown month."""
    in_month = (F.month("date") == month) & (F.year("date") == year)
    best = F.min_by(
        F.struct("festival_name", "date"), F.struct(in_month.alias("in_month"), F.col("date"), F.col("row_order"))
    )
    return festivals.filter(F.col("date") >= as_of).agg(best.alias("best")).filter("best is not null").select("best.*")


def upcoming(merged: DataFrame, horizon_days: int = 60) -> DataFrame:
    return merged.filter(F.col("days_until").between(0, horizon_days))
