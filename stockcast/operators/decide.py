"""Inventory decisions per series from a forecast, and forecast sanity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockcast.functions.calendar import is_stale
from stockcast.functions.numbers import clip, py_round, ratio, std_from_band
from stockcast.operators.demand import CATEGORY

# Service factors and decision thresholds.
Z_HIGH, Z_LOW, HIGH_SERVICE = 1.65, 1.28, 0.95
FESTIVAL_SCORE, FESTIVAL_BUFFER, FESTIVAL_DAYS = 0.6, 1.3, 30
INVENTORY_WEIGHT, UNCERTAINTY_WEIGHT = 0.6, 0.4
URGENT_RISK, MONITOR_RISK = 0.7, 0.5
DEFAULT_INVENTORY, DEFAULT_LEAD_DAYS, DEFAULT_PACK = 0, 7, 1


def with_params(series: DataFrame, params: DataFrame, skus: DataFrame | None = None, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Series with their planning parameters, defaults filled in.

    With ``skus`` given, series that no item belongs to are left out.
    """
    known = series.select(*keys).distinct()
    if skus is not None:
        known = known.join(skus.select(*keys), list(keys), "left_semi")
    joined = known.join(params, list(keys), "left")
    return joined.withColumns(
        {
            "current_inventory": F.coalesce("current_inventory", F.lit(DEFAULT_INVENTORY)),
            "lead_time_days": F.coalesce("lead_time_days", F.lit(DEFAULT_LEAD_DAYS)),
            "supplier_pack_size": F.coalesce("supplier_pack_size", F.lit(DEFAULT_PACK)),
        }
    )


def horizon_totals(forecast: DataFrame, params: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """One row per series of ``params``: what the decisions need from the horizon.

    Both sides are hashed on the series key once; the totals are a partial
    aggregate on the same key, so the join is the only shuffle.
    """
    joined = params.select(*keys, "lead_time_days").join(forecast, list(keys), "left")
    day, mean = F.col("day_index"), F.col("predicted_mean")
    lead_days = F.col("lead_time_days")
    festive = (day <= FESTIVAL_DAYS) & (F.coalesce("festival_score", F.lit(0.0)) > FESTIVAL_SCORE)
    return joined.groupBy(*keys).agg(
        F.count("day_index").alias("n_days"),
        F.avg(std_from_band(F.col("upper_95"), mean)).alias("avg_std"),
        F.avg(mean).alias("mean_demand"),
        F.coalesce(F.sum(mean), F.lit(0.0)).alias("total_demand"),
        F.coalesce(F.sum(F.when(day <= lead_days, mean)), F.lit(0.0)).alias("lead_demand"),
        F.coalesce(F.bool_or(festive), F.lit(False)).alias("festive"),
    )


def safety_stock(service_level: float = HIGH_SERVICE) -> Column:
    """From avg_std, n_days and festive; never negative."""
    z = Z_HIGH if service_level >= HIGH_SERVICE else Z_LOW
    base = F.lit(z) * F.col("avg_std") * F.sqrt("n_days")
    buffered = F.when(F.col("festive"), base * FESTIVAL_BUFFER).otherwise(base)
    return F.greatest(F.lit(0.0), F.coalesce(buffered, F.lit(0.0)))


def reorder_point(safety: Column) -> Column:
    """Lead-time demand plus safety stock; only the latter without a lead time."""
    return F.when((F.col("n_days") == 0) | (F.col("lead_time_days") <= 0), safety).otherwise(
        F.greatest(F.lit(0.0), F.col("lead_demand") + safety)
    )


def order_quantity(reorder: Column, pack: Column) -> Column:
    """Horizon demand up to the reorder point, in whole packs; 0 with enough stock."""
    stock = F.col("current_inventory")
    units = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("total_demand") + reorder - stock))
    packs = F.when((pack > 1) & (units > 0), (F.ceil(units / pack) * pack).cast("bigint")).otherwise(units)
    return F.when(stock >= reorder, F.lit(0).cast("bigint")).otherwise(packs)


def inventory_risk(reorder: Column) -> Column:
    """Share of the reorder point that stock does not cover."""
    return F.when(reorder > 0, clip(F.lit(1.0) - F.col("current_inventory") / reorder, 0.0, 1.0)).otherwise(F.lit(0.0))


def risk_score(reorder: Column) -> Column:
    spread_part = F.least(F.lit(1.0), ratio(F.col("avg_std"), F.col("mean_demand")))
    return clip(INVENTORY_WEIGHT * inventory_risk(reorder) + UNCERTAINTY_WEIGHT * spread_part, 0.0, 1.0)


def action(quantity: Column, risk: Column) -> Column:
    ordering = F.when(risk >= URGENT_RISK, "URGENT_ORDER").otherwise("ORDER")
    holding = F.when(risk >= MONITOR_RISK, "MONITOR").otherwise("MAINTAIN")
    return F.when(quantity > 0, ordering).otherwise(holding)


def decide(
    forecast: DataFrame,
    params: DataFrame,
    as_of: Column,
    keys: Sequence[str] = CATEGORY,
    service_level: float = HIGH_SERVICE,
    rounded: bool = True,
) -> DataFrame:
    """The full decision row of every series in ``params``.

    Rounding comes after all derivations. A series without a forecast gets
    INSUFFICIENT_DATA and zeros.
    """
    totals = horizon_totals(forecast, params, keys)
    extra = [c for c in params.columns if c not in keys]
    base = totals.join(params, list(keys)).withColumn("_pack", F.greatest(F.lit(1), F.col("supplier_pack_size")))
    base = base.withColumn("_safety", safety_stock(service_level))
    base = base.withColumn("_reorder", reorder_point(F.col("_safety")))
    base = base.withColumns(
        {
            "_plain": order_quantity(F.col("_reorder"), F.lit(1)),
            "_quantity": order_quantity(F.col("_reorder"), F.col("_pack")),
            "_risk": risk_score(F.col("_reorder")),
        }
    )
    some = F.col("n_days") > 0
    keep = lambda value, empty: F.when(some, value).otherwise(empty)
    digits = py_round if rounded else (lambda c, n: c)
    stale = is_stale(F.col("last_upload"), as_of) if "last_upload" in extra else F.lit(False)
    return base.select(
        *keys, *extra,
        keep(action(F.col("_quantity"), F.col("_risk")), F.lit("INSUFFICIENT_DATA")).alias("recommended_action"),
        keep(F.col("_quantity"), F.lit(0).cast("bigint")).alias("order_quantity"),
        keep(digits(F.col("_reorder"), 2), F.lit(0.0)).alias("reorder_point"),
        keep(digits(F.col("_safety"), 2), F.lit(0.0)).alias("safety_stock"),
        keep(digits(F.col("_risk"), 3), F.lit(0.0)).alias("risk_score"),
        keep(F.col("festive"), F.lit(False)).alias("festival_buffer_applied"),
        keep(stale, F.lit(False)).alias("data_stale_warning"),
        keep((F.col("_pack") > 1) & (F.col("_quantity") != F.col("_plain")), F.lit(False)).alias("pack_size_applied"),
    )


# --- sanity checks ---------------------------------------------------------

def sanity_warnings(forecast: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Warning ids per series; a forecast is valid when there are none."""
    order = Window.partitionBy(*keys).orderBy("day_index")
    pred = F.coalesce(F.col("predicted_mean"), F.lit(0.0))
    earlier = F.avg("_pred").over(order.rowsBetween(-7, -1))
    around = F.avg("_pred").over(order.rowsBetween(-6, 0))
    rows = forecast.withColumn("_pred", pred).withColumns({"_earlier": earlier, "_around": around})
    baseline = F.when(F.col("_earlier") > 0, F.col("_earlier")).otherwise(F.col("_around"))
    std = F.greatest(F.lit(0.0), std_from_band(F.coalesce("upper_95", "_pred"), F.col("_pred")))
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_pred") <= 0).alias("zeros"),
        F.coalesce(F.bool_or(F.col("_pred") > 5.0 * baseline), F.lit(False)).alias("spike"),
        F.count_if(std > F.col("_pred")).alias("wide"),
        F.min_by("_pred", "day_index").alias("first"),
        F.max_by("_pred", "day_index").alias("last"),
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("zeros") / F.col("n") > 0.80, "model_collapse"),
            F.when(F.col("spike"), "spike_anomaly"),
            F.when(F.col("wide") / F.col("n") > 0.50, "high_uncertainty"),
            F.when((F.col("first") > 0) & (F.col("last") > 3.0 * F.col("first")), "runaway_trend"),
        )
    )
    return stats.select(*keys, found.alias("warnings")).withColumn("valid", F.size("warnings") == 0)
