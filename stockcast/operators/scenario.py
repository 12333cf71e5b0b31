"""Discount scenarios on forecasts: one row per series, scenario and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockcast.functions.calendar import weekday
from stockcast.functions.numbers import clip, py_round
from stockcast.operators.decide import decide, sanity_warnings

# Elasticity per mode, tuning per category, caps.
ELASTICITY = {"conservative": 0.8, "balanced": 1.2, "aggressive": 1.6}
DEFAULT_MODE = "balanced"
TUNING = {"snacks": 1.10, "staples": 0.95, "edible oil": 0.90}
UPLIFT_CAP = 1.2
WEEKEND_BOOST = 1.05
FESTIVAL_BOOST_CAP = 0.2
WIDENING_CAP = 0.35
MAX_DISCOUNT = 70
COVER_DAYS = 14
NO_DEMAND_COVER = 999.0


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def seasonal_factor() -> Column:
    weekend = F.when(weekday(F.col("date")) >= 5, WEEKEND_BOOST).otherwise(1.0)
    festive = F.lit(1.0) + F.least(F.lit(FESTIVAL_BOOST_CAP), F.coalesce("festival_score", F.lit(0.0)) * 0.2)
    return weekend * festive


def discount_ratio() -> Column:
    return F.greatest(F.lit(0.0), F.col("discount_percent")) / 100.0


def interval_scale() -> Column:
    return F.lit(1.0) + F.least(F.lit(WIDENING_CAP), discount_ratio() / 2.0)


def checked_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenarios with the reasons against them, an empty array for those that can be simulated."""
    discount, mode = F.col("discount_percent"), F.col("elasticity_mode")
    wrong = {
        f"discount_percent must lie between 0 and {MAX_DISCOUNT}": ~F.coalesce(discount.between(0, MAX_DISCOUNT), F.lit(False)),
        f"elasticity_mode must be one of {', '.join(ELASTICITY)}": ~F.coalesce(mode.isin(*ELASTICITY), F.lit(False)),
    }
    return scenarios.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(text)) for text, c in wrong.items()])))


def valid_scenarios(scenarios: DataFrame) -> DataFrame:
    return checked_scenarios(scenarios).filter(F.size("reasons") == 0).drop("reasons")


def rejected_scenarios(scenarios: DataFrame) -> DataFrame:
    """What ``valid_scenarios`` leaves out, with the reasons."""
    return checked_scenarios(scenarios).filter(F.size("reasons") > 0)


def apply_scenarios(
    forecast: DataFrame, scenarios: DataFrame, keys: Sequence[str] = ("category",), category: str = "category", cap: float = UPLIFT_CAP
) -> DataFrame:
    """Forecast rows under each scenario asked for the series.

    ``scenarios`` holds (keys, scenario_id, discount_percent, elasticity_mode):
    requests belong to a series, so this is an equi-join on the series key.
    """
    wanted = scenarios.select(*keys, "scenario_id", "discount_percent", "elasticity_mode")
    rows = forecast.join(wanted, list(keys))
    mode = _lookup(F.col("elasticity_mode"), ELASTICITY, ELASTICITY[DEFAULT_MODE])
    tuning = _lookup(F.lower(F.trim(category)), TUNING, 1.0)
    uplift = F.least(F.lit(cap), discount_ratio() * mode * tuning * seasonal_factor())
    rows = rows.withColumn("uplift", uplift).withColumn("interval_scale", interval_scale())
    mean = F.greatest(F.lit(0.0), F.col("predicted_mean") * (1.0 + F.col("uplift")))
    width = F.greatest(F.lit(0.0), F.col("upper_95") - F.col("lower_95")) * F.col("interval_scale")
    rows = rows.withColumns({"_mean": mean, "_half": width / 2.0})
    return rows.withColumns(
        {
            "lower_95": F.least(F.col("_mean"), F.greatest(F.lit(0.0), F.col("_mean") - F.col("_half"))),
            "upper_95": F.greatest(F.col("_mean"), F.col("_mean") + F.col("_half")),
            "predicted_mean": F.col("_mean"),
        }
    ).drop("_mean", "_half")


def with_simulation(baseline: DataFrame, simulated: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Baseline rows beside the simulated mean of the same date."""
    sim = simulated.select(*keys, "scenario_id", "date", F.col("predicted_mean").alias("simulated_mean"))
    return baseline.join(sim, [*keys, "date"], "left")


def stability_index(risk: Column, mean_daily: Column, stock: Column, scale: Column) -> Column:
    """0–100, higher is steadier supply; before rounding."""
    cover = F.when(mean_daily > 0, stock / mean_daily).otherwise(F.lit(NO_DEMAND_COVER))
    risk_penalty = F.least(F.lit(100.0), risk * 65.0)
    cover_penalty = F.when(cover >= COVER_DAYS, 0.0).otherwise((COVER_DAYS - F.greatest(F.lit(0.0), cover)) * 2.0)
    width_penalty = F.greatest(F.lit(0.0), (scale - 1.0) * 80.0)
    return clip(F.lit(100.0) - risk_penalty - cover_penalty - width_penalty, 0.0, 100.0)


def _totals(rows: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    value = F.coalesce("predicted_mean", F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sum(value).alias(f"{prefix}_total"), F.avg(value).alias(f"{prefix}_mean"))


def scenario_report(
    baseline: DataFrame, scenarios: DataFrame, params: DataFrame, as_of: Column, baseline_decisions: DataFrame | None = None
) -> DataFrame:
    """Baseline and scenario decisions, their deltas, stability and warnings.

    The scenario decision knows no upload date, so its stale flag stays false.
    """
    keys = ["category"]
    pair = ["category", "scenario_id"]
    plan = params.select("category", "current_inventory", "lead_time_days", "supplier_pack_size")
    simulated = apply_scenarios(baseline, scenarios)
    base = baseline_decisions if baseline_decisions is not None else decide(baseline, params, as_of)
    per_scenario = scenarios.select(*pair).join(plan, keys)
    sim = decide(simulated, per_scenario, as_of, keys=pair)
    meta = simulated.groupBy(*pair).agg(
        F.avg("uplift").alias("avg_uplift"), F.max("interval_scale").alias("interval_scale"),
        F.sum(F.coalesce("predicted_mean", F.lit(0.0))).alias("simulated_total"),
        F.avg(F.coalesce("predicted_mean", F.lit(0.0))).alias("simulated_mean"),
    )
    base_side = base.select(
        "category",
        *[F.col(c).alias(f"base_{c}") for c in ("recommended_action", "order_quantity", "reorder_point", "risk_score")],
    ).join(_totals(baseline, keys, "base"), keys).join(
        sanity_warnings(baseline, keys).select("category", F.col("warnings").alias("base_warnings")), keys
    )
    sim_warnings = sanity_warnings(simulated, pair).select(*pair, "warnings")
    joined = sim.join(meta, pair).join(sim_warnings, pair).join(base_side, keys)
    delta = lambda name: F.col(name) - F.col(f"base_{name}")
    index = stability_index(F.col("risk_score"), F.col("simulated_mean"), F.col("current_inventory"), F.col("interval_scale"))
    return joined.select(
        *pair, "base_recommended_action", "recommended_action", "order_quantity", "reorder_point", "safety_stock",
        "risk_score", "data_stale_warning", "avg_uplift", "interval_scale",
        py_round(F.col("simulated_total") - F.col("base_total"), 2).alias("forecast_total_delta"),
        py_round(delta("risk_score"), 3).alias("risk_delta"),
        delta("order_quantity").alias("order_quantity_delta"),
        py_round(delta("reorder_point"), 2).alias("reorder_point_delta"),
        py_round(index, 2).alias("supply_stability_index"),
        F.array_sort(F.array_union("base_warnings", "warnings")).alias("warnings"),
    )
