"""Portfolio, risk and festival-readiness reports, and short text summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockcast.functions.calendar import days_until, urgency
from stockcast.functions.numbers import clip, fixed, grouped, js_round, py_round, ratio
from stockcast.functions.text import action_words, prompt_safe

CATEGORY = ("category",)
SHORT_SPAN = 30
DEFAULT_STOCK_UP_DAYS = 5
DEFAULT_GAP_LEAD_DAYS = 7


def _span_total(first: int, last: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("day_index").between(first, last), F.col("predicted_mean"))), F.lit(0.0))


# --- portfolio -------------------------------------------------------------

def portfolio_rows(forecast: DataFrame, decisions: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Demand of days 1–30 and 31–60, required stock, gap and status per series."""
    spans = forecast.groupBy(*keys).agg(
        _span_total(1, SHORT_SPAN).alias("demand_first"), _span_total(SHORT_SPAN + 1, 2 * SHORT_SPAN).alias("demand_next")
    )
    required = F.greatest("reorder_point", "safety_stock")
    gap = ratio(F.greatest(F.lit(0.0), F.col("required_stock") - F.col("current_inventory")), F.col("required_stock"))
    status = (
        F.when((F.col("recommended_action") == "URGENT_ORDER") | (F.col("gap_ratio") > 0.4), "critical")
        .when((F.col("recommended_action") == "ORDER") | (F.col("gap_ratio") > 0.1), "warning")
        .otherwise("healthy")
    )
    change = ratio((F.col("demand_next") - F.col("demand_first")) * 100.0, F.col("demand_first"))
    return (
        decisions.join(spans, list(keys))
        .withColumn("required_stock", required)
        .withColumn("gap_ratio", gap)
        .select(
            *keys, "recommended_action", "risk_score", "reorder_point", "safety_stock", "current_inventory",
            "lead_time_days", "order_quantity", "required_stock", "gap_ratio", "demand_first", "demand_next",
            change.alias("change_percent"), status.alias("status"),
        )
    )


def portfolio_kpis(rows: DataFrame, key: str = "category") -> DataFrame:
    """One row of totals, counts, severity and banner text."""
    is_action = lambda name: F.col("recommended_action") == name
    first_of = lambda name: F.min(F.when(is_action(name), F.col(key)))
    gap = F.greatest(F.lit(0.0), F.col("required_stock") - F.col("current_inventory"))
    top = F.min_by(F.struct(key, "risk_score"), F.struct((-F.col("risk_score")).alias("r"), F.col(key)))
    sums = rows.agg(
        F.sum("demand_next").alias("next_total"), F.sum("demand_first").alias("first_total"),
        top.alias("top"), F.sum(gap).alias("gap"), F.count("*").alias("active_categories"),
        F.count_if(is_action("URGENT_ORDER")).alias("urgent_count"), F.count_if(is_action("ORDER")).alias("order_count"),
        F.coalesce(first_of("URGENT_ORDER"), first_of("ORDER")).alias("critical_category"),
    )
    ordering = F.col("urgent_count") + F.col("order_count")
    severity = F.when(F.col("urgent_count") > 0, "urgent").when(F.col("order_count") > 0, "order").otherwise("ok")
    urgent_text = F.format_string(
        "Warning: %d categories need ordering, %d critical - %s is critical", ordering, "urgent_count", "critical_category"
    )
    order_text = F.format_string(
        "%d categories need ordering, %d critical - prioritize %s", ordering, "urgent_count", "critical_category"
    )
    calm_text = F.lit("0 categories need ordering, 0 critical - all categories are MONITOR/MAINTAIN")
    banner = F.when(F.col("urgent_count") > 0, urgent_text).when(F.col("order_count") > 0, order_text).otherwise(calm_text)
    change = ratio((F.col("next_total") - F.col("first_total")) * 100.0, F.col("first_total"))
    return sums.select(
        js_round(F.col("next_total")).alias("forecast_30"),
        change.alias("forecast_change_percent"),
        F.coalesce(f"top.{key}", F.lit("n/a")).alias("highest_risk_category"),
        F.coalesce("top.risk_score", F.lit(0.0)).alias("highest_risk_score"),
        js_round(F.col("gap")).alias("inventory_gap"),
        "active_categories", "urgent_count", "order_count",
        ordering.alias("needs_order_count"), severity.alias("severity"), "critical_category", banner.alias("banner"),
    )


def risk_drilldown(forecast: DataFrame, rows: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Where the risk of each series comes from, with reasons in words."""
    stats = forecast.groupBy(*keys).agg(
        _span_total(1, SHORT_SPAN).alias("demand_30"),
        F.avg("predicted_mean").alias("daily_mean"),
        F.coalesce(F.stddev_samp("predicted_mean"), F.lit(0.0)).alias("daily_std"),
    )
    stock, reorder = F.col("current_inventory"), F.col("reorder_point")
    composite = js_round(F.col("risk_score") * 100)
    base = rows.select(*keys, "risk_score", "current_inventory", "reorder_point", "lead_time_days").join(stats, list(keys), "left")
    base = base.withColumns(
        {
            "composite_risk": composite,
            "inventory_risk": F.when(reorder > 0, clip((reorder - stock) / reorder, 0.0, 1.0)).otherwise(F.lit(0.0)),
            "days_to_stockout": F.when(F.col("daily_mean") > 0, js_round(stock / F.col("daily_mean"))).otherwise(
                F.lit(999).cast("bigint")
            ),
            "breached": stock < reorder,
        }
    )
    base = base.withColumn(
        "uncertainty_risk", clip((F.col("composite_risk") / 100.0 - 0.6 * F.col("inventory_risk")) / 0.4, 0.0, 1.0)
    )
    above = F.when(reorder > 0, fixed((stock - reorder) / reorder * 100, 1)).otherwise(F.lit("0"))
    below = F.when(reorder > 0, fixed((reorder - stock) / reorder * 100, 1)).otherwise(F.lit("0"))
    stock_reason = F.when(
        F.col("breached"),
        F.concat(F.lit("Current stock ("), grouped(stock), F.lit(") is "), below, F.lit("% below reorder point ("), grouped(reorder), F.lit(")")),
    ).otherwise(
        F.concat(
            F.lit("Stock is comfortably above reorder point ("), grouped(stock), F.lit(" vs "), grouped(reorder),
            F.lit(", +"), above, F.lit("%)"),
        )
    )
    level = F.when(F.col("uncertainty_risk") >= 0.5, "high").when(F.col("uncertainty_risk") >= 0.3, "medium").otherwise("low")
    reasons = F.array_compact(
        F.array(
            stock_reason,
            F.format_string(
                "Demand variability is %s - coefficient of variation is %s", level, fixed(F.col("uncertainty_risk"), 2)
            ),
            F.when(
                F.col("lead_time_days") >= 10,
                F.format_string("Long lead time (%d days) amplifies stockout risk", "lead_time_days"),
            ),
            F.when(
                F.col("days_to_stockout") <= 14,
                F.format_string("Only %d days of stock remaining at current burn rate", "days_to_stockout"),
            ),
        )
    )
    deficit = F.when(F.col("breached"), reorder - stock).otherwise(F.lit(0.0))
    advice = F.when(
        F.col("lead_time_days") > 0,
        F.format_string("Given the %d-day lead time, reorder soon to avoid stockout.", "lead_time_days"),
    ).otherwise(F.lit("Consider reordering now."))
    explanation = F.when(
        F.col("breached"),
        F.concat(F.lit("Stock is "), grouped(deficit), F.lit(" units below the reorder point. "), advice),
    ).otherwise(
        F.concat(
            F.lit("Current inventory is "), above,
            F.lit("% above the reorder point. No action required at this time."),
        )
    )
    return base.select(
        *keys, "composite_risk", "inventory_risk", "uncertainty_risk",
        js_round(F.coalesce("demand_30", F.lit(0.0))).alias("demand_30"),
        js_round(F.coalesce("daily_mean", F.lit(0.0))).alias("daily_mean"),
        js_round(F.coalesce("daily_std", F.lit(0.0))).alias("daily_std"),
        "days_to_stockout", reasons.alias("reasons"), "breached", deficit.alias("deficit"), explanation.alias("explanation"),
    )


# --- festivals -------------------------------------------------------------

def festival_readiness(upcoming: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stock needed per coming festival and affected category, and how far off it is."""
    affected = upcoming.select(
        "festival_name", "date", "historical_uplift", "category_uplifts", F.explode("categories").alias("category")
    )
    uplift = F.coalesce(F.try_element_at("category_uplifts", F.col("category")), F.col("historical_uplift"), F.lit(0.0))
    levels = decisions.select("category", "current_inventory", F.greatest("reorder_point", "safety_stock").alias("base"))
    joined = affected.withColumn("uplift", uplift).join(levels, "category", "left")
    stock = F.coalesce("current_inventory", F.lit(0))
    required = js_round(F.coalesce("base", F.lit(0.0)) * (1.0 + F.col("uplift")))
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("required_stock") - stock)
    rows = joined.withColumn("required_stock", required).withColumn("gap", gap)
    rows = rows.withColumn("gap_ratio", ratio(F.col("gap").cast("double"), F.col("required_stock")))
    status = F.when(F.col("gap_ratio") >= 0.35, "CRITICAL").when(F.col("gap_ratio") > 0.1, "AT RISK").otherwise("READY")
    return rows.select(
        "festival_name", "date", "category", stock.alias("current_stock"), "required_stock", "gap", status.alias("status")
    )


def festival_sensitivity(long: DataFrame, key: str = "category") -> DataFrame:
    """Size of the festival coefficient per series."""
    return long.filter("feature = 'festival_score'").select(key, F.abs("coefficient").alias("festival_sensitivity"))


def festival_markers(merged: DataFrame, forecast: DataFrame) -> DataFrame:
    """Festivals that fall on a forecast day and are strong enough to mark."""
    inferred = F.least(F.lit(1.0), F.col("historical_uplift") * 2)
    days = forecast.select("date").distinct()
    marked = merged.withColumn("inferred_score", inferred).filter(F.col("inferred_score") > 0.5)
    return marked.join(days, "date", "left_semi")


def calendar_cards(merged: DataFrame, params: DataFrame, as_of: Column) -> DataFrame:
    """Days to go, urgency, and the day to stock up by the shortest lead time.

    Categories without parameters count with the default lead time.
    """
    exploded = merged.select("festival_name", "date", F.explode_outer("categories").alias("category"))
    lead = F.coalesce("lead_time_days", F.lit(DEFAULT_STOCK_UP_DAYS))
    shortest = exploded.join(params.select("category", "lead_time_days"), "category", "left").groupBy("festival_name", "date").agg(
        F.min(lead).alias("min_lead_days")
    )
    days = days_until(F.col("date"), as_of)
    return shortest.select(
        "festival_name", "date", days.alias("days_until"), urgency(days).alias("urgency"), "min_lead_days",
        F.date_sub("date", F.col("min_lead_days")).alias("stock_up_date"),
    )


def demand_impact(merged: DataFrame) -> DataFrame:
    """Expected impact in percent per festival and category, with bar width."""
    rows = merged.select("festival_name", "date", "demand_multiplier", "category_uplifts", F.explode("categories").alias("category"))
    share = F.coalesce(F.try_element_at("category_uplifts", F.col("category")), F.col("demand_multiplier") - 1)
    percent = js_round(share * 100)
    return rows.select(
        "festival_name", "date", "category", percent.alias("impact_percent"),
        F.least(F.lit(100).cast("bigint"), percent * 2).alias("bar_width"),
    )


# --- single figures --------------------------------------------------------

def lead_time_gap(forecast: DataFrame, params: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Units missing to cover the demand of the lead time."""
    lead = F.when(F.col("lead_time_days") > 0, F.col("lead_time_days")).otherwise(F.lit(DEFAULT_GAP_LEAD_DAYS))
    plan = params.select(*keys, "current_inventory", lead.alias("lead"))
    joined = forecast.join(plan, list(keys)).filter(F.col("day_index") <= F.col("lead"))
    demand = F.sum("predicted_mean")
    return joined.groupBy(*keys).agg(
        demand.alias("lead_demand"),
        F.greatest(F.lit(0).cast("bigint"), js_round(demand - F.first("current_inventory"))).alias("stock_gap"),
    )


def model_health(decisions: DataFrame, stale: Column, forecast_rows: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Freshness and health per series; either stale flag counts as stale."""
    health = F.when(F.col("risk_score") >= 0.7, "degraded").when(F.col("risk_score") >= 0.4, "watch").otherwise("healthy")
    points = forecast_rows.groupBy(*keys).agg(F.count("*").alias("training_points"))
    return decisions.join(points, list(keys), "left").select(
        *keys, "last_upload", (stale | F.col("data_stale_warning")).alias("stale"),
        F.coalesce("training_points", F.lit(0)).alias("training_points"), health.alias("health"),
    )


def confidence_split(forecast: DataFrame) -> DataFrame:
    """The mean in three nullable columns by horizon band."""
    day, mean = F.col("day_index"), F.col("predicted_mean")
    return forecast.withColumns(
        {
            "high_conf": F.when(day <= 7, mean),
            "medium_conf": F.when((day > 7) & (day <= 14), mean),
            "low_conf": F.when(day > 14, mean),
        }
    )


def apply_overrides(params: DataFrame, overrides: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Stock levels replaced by valid overrides (finite, not negative), rounded.

    Invalid ones are ignored here; ``invalid_overrides`` lists them.
    """
    good = overrides.filter(_valid_stock()).select(*keys, js_round(F.col("stock")).cast("int").alias("_stock"))
    return params.join(good, list(keys), "left").withColumn(
        "current_inventory", F.coalesce("_stock", "current_inventory")
    ).drop("_stock")


def invalid_overrides(overrides: DataFrame) -> DataFrame:
    return overrides.filter(~F.coalesce(_valid_stock(), F.lit(False)))


def _valid_stock() -> Column:
    return F.col("stock").isNotNull() & ~F.isnan("stock") & (F.col("stock") < float("inf")) & (F.col("stock") >= 0)


def light_prediction(levels: DataFrame, requests: DataFrame, by_date: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """A quick estimate for (keys, date) requests from the recent level.

    The uplift is that of the first festival listed for the date, whatever its
    category. Series without data give nulls.
    """
    joined = requests.join(levels, list(keys), "left").join(by_date.select("date", "uplift"), "date", "left")
    mean = F.col("recent_mean")
    uplift = F.coalesce("uplift", F.lit(0.0))
    raw_risk = F.when(mean > 0, F.coalesce("recent_std", F.lit(0.0)) / mean).otherwise(F.lit(0.0))
    rows = joined.withColumn("risk", F.least(F.lit(1.0), py_round(raw_risk, 3)))
    seen = mean.isNotNull()
    level = F.when(F.col("risk") >= 0.8, "low").when(F.col("risk") >= 0.4, "medium").otherwise("high")
    text = (
        F.when(F.col("uplift").isNotNull() & (uplift >= 0.3), "Increase inventory before festival demand spike.")
        .when(F.col("risk") >= 0.6, "Monitor inventory closely and plan a buffer restock.")
        .otherwise("Maintain regular replenishment plan.")
    )
    return rows.select(
        *keys, "date",
        F.when(seen, py_round(F.greatest(F.lit(0.0), mean * (1.0 + uplift)), 2)).alias("predicted_demand"),
        F.when(seen, F.col("risk")).alias("risk_score"),
        F.when(seen, level).otherwise(F.lit("low")).alias("confidence_level"),
        F.when(seen, text).otherwise(F.lit("No data available for this stock/category.")).alias("suggested_action"),
    )


# --- text ------------------------------------------------------------------

def insight_text(decisions: DataFrame) -> DataFrame:
    """Rule-based advice per category from its decision."""
    todo = F.lower(action_words(F.coalesce("recommended_action", F.lit("MONITOR"))))
    risk = F.coalesce(F.col("risk_score").cast("string"), F.lit("unknown"))
    text = F.concat(
        F.col("category"),
        F.lit(" has elevated stock risk right now, especially around local demand changes and seasonal events. Please "),
        todo, F.lit(" and plan approximately "), F.coalesce("order_quantity", F.lit(0)).cast("string"),
        F.lit(" units based on current estimates. Recheck inventory and sales trend within 24 hours (risk score: "),
        risk, F.lit(")."),
    )
    return decisions.withColumn("insight", text)


def scenario_text(report: DataFrame) -> DataFrame:
    """Rule-based explanation per scenario from its deltas."""
    text = F.format_string(
        "A %.1f%% discount for %s increases projected demand and changes inventory risk. "
        "Expected order quantity shifts by %d units with risk delta %+.3f. "
        "Use this scenario to align purchase timing and supplier capacity before launching the promotion.",
        F.col("discount_percent").cast("double"), F.col("category"),
        F.col("order_quantity_delta").cast("bigint"), F.col("risk_delta").cast("double"),
    )
    return report.withColumn("explanation", text)


def context_text(record: Column, limit: int | None = None) -> Column:
    """A struct as JSON text, blocked tokens removed; cut to ``limit`` characters if a service asks for it."""
    return prompt_safe(F.to_json(record), limit)
