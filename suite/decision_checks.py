"""Decisions, sanity checks, scenarios and the reports built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockcast.operators import decide as d
from stockcast.operators import reports, scenario
from stockcast.sources import festivals as fest
from suite.base import AS_OF, FESTIVAL_DAY, Domain, as_of, festival_day, query, register_cte
from suite.plain import plain


def decision_sql(forecast: str, params: str, keys: str, upload: str) -> str:
    """Decision arithmetic in plain SQL over a forecast and a parameter table."""
    return f"""
    SELECT *, CASE WHEN order_quantity > 0 THEN CASE WHEN raw_risk >= 0.7 THEN 'URGENT_ORDER' ELSE 'ORDER' END
                   WHEN n = 0 THEN 'INSUFFICIENT_DATA' WHEN raw_risk >= 0.5 THEN 'MONITOR' ELSE 'MAINTAIN' END AS recommended_action,
           pack > 1 AND order_quantity <> plain_quantity AS pack_size_applied,
           coalesce({upload} < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false) AND n > 0 AS data_stale_warning
    FROM (SELECT *,
            CASE WHEN n = 0 OR current_inventory >= raw_reorder THEN 0 ELSE plain END AS plain_quantity,
            CASE WHEN n = 0 OR current_inventory >= raw_reorder THEN 0 WHEN pack > 1 THEN CAST(ceil(plain / pack) * pack AS BIGINT) ELSE plain END AS order_quantity,
            least(1, greatest(0, 0.6 * CASE WHEN raw_reorder > 0 THEN least(1, greatest(0, 1 - current_inventory / raw_reorder)) ELSE 0 END
                 + 0.4 * CASE WHEN mean_demand > 0 THEN least(1, avg_std / mean_demand) ELSE 0 END)) AS raw_risk
      FROM (SELECT *, CAST(greatest(0, ceil(total_demand + raw_reorder - current_inventory)) AS BIGINT) AS plain
        FROM (SELECT *, CASE WHEN n = 0 OR lead_time_days <= 0 THEN raw_safety ELSE lead_demand + raw_safety END AS raw_reorder
          FROM (SELECT *, greatest(0, coalesce(1.65 * avg_std * sqrt(n) * CASE WHEN festive THEN 1.3 ELSE 1 END, 0)) AS raw_safety
            FROM (SELECT p.*, greatest(1, p.supplier_pack_size) AS pack, count(f.day_index) AS n,
                         avg((f.upper_95 - f.predicted_mean) / 1.96) AS avg_std, avg(f.predicted_mean) AS mean_demand,
                         coalesce(sum(f.predicted_mean), 0) AS total_demand,
                         coalesce(sum(f.predicted_mean) FILTER (WHERE f.day_index <= p.lead_time_days), 0) AS lead_demand,
                         coalesce(bool_or(f.day_index <= 30 AND f.festival_score > 0.6), false) AS festive
                  FROM {params} p LEFT JOIN {forecast} f USING ({keys}) GROUP BY ALL)))))"""


register_cte("decided", decision_sql("forecast", "params", "category", "last_upload"), "forecast", "params")
register_cte(
    "decisions",
    """SELECT category, current_inventory, lead_time_days, supplier_pack_size, last_upload, recommended_action, order_quantity,
              CAST(printf('%.2f', raw_reorder) AS DOUBLE) AS reorder_point, CAST(printf('%.2f', raw_safety) AS DOUBLE) AS safety_stock, CAST(printf('%.3f', raw_risk) AS DOUBLE) AS risk_score,
              festive AS festival_buffer_applied, data_stale_warning, pack_size_applied FROM decided""",
    "decided",
)
register_cte(
    "simulated",
    """
    SELECT category, scenario_id, day_index, date, discount_percent, elasticity_mode, uplift, scale, festival_score, m AS predicted_mean,
           least(m, greatest(0, m - w / 2)) AS lower_95, m + w / 2 AS upper_95
    FROM (SELECT *, predicted_mean * (1 + uplift) AS m, (upper_95 - lower_95) * scale AS w
      FROM (SELECT f.*, s.scenario_id, s.discount_percent, s.elasticity_mode, 1 + least(0.35, discount_percent / 200) AS scale,
              least(1.2, discount_percent / 100
                * CASE elasticity_mode WHEN 'conservative' THEN 0.8 WHEN 'aggressive' THEN 1.6 ELSE 1.2 END
                * CASE lower(category) WHEN 'snacks' THEN 1.10 WHEN 'staples' THEN 0.95 WHEN 'edible oil' THEN 0.90 ELSE 1 END
                * CASE WHEN isodow(date) >= 6 THEN 1.05 ELSE 1 END * (1 + least(0.2, 0.2 * festival_score))) AS uplift
            FROM forecast f JOIN scenarios s USING (category)))""",
    "forecast", "scenarios",
)


def warnings_sql(rows: str, keys: str) -> str:
    over = f"OVER (PARTITION BY {keys} ORDER BY day_index ROWS BETWEEN"
    return f"""
    SELECT {keys}, list_filter([CASE WHEN zeros > 0.8 THEN 'model_collapse' END, CASE WHEN spike THEN 'spike_anomaly' END,
              CASE WHEN wide > 0.5 THEN 'high_uncertainty' END, CASE WHEN first > 0 AND last > 3 * first THEN 'runaway_trend' END], lambda x: x IS NOT NULL) AS warnings
    FROM (SELECT {keys}, avg(CASE WHEN predicted_mean <= 0 THEN 1 ELSE 0 END) AS zeros,
                 coalesce(bool_or(predicted_mean > 5 * CASE WHEN prev > 0 THEN prev ELSE cur END), false) AS spike,
                 avg(CASE WHEN greatest(0, upper_95 - predicted_mean) / 1.96 > predicted_mean THEN 1 ELSE 0 END) AS wide,
                 arg_min(predicted_mean, day_index) AS first, arg_max(predicted_mean, day_index) AS last
          FROM (SELECT *, avg(predicted_mean) {over} 7 PRECEDING AND 1 PRECEDING) AS prev,
                       avg(predicted_mean) {over} 6 PRECEDING AND CURRENT ROW) AS cur FROM {rows}) GROUP BY ALL)"""


register_cte("base_warnings", warnings_sql("forecast", "category"), "forecast")
register_cte("sim_warnings", warnings_sql("simulated", "category, scenario_id"), "simulated")
register_cte("sim_params", "SELECT s.category, s.scenario_id, p.* EXCLUDE (category) FROM scenarios s JOIN params p USING (category)", "scenarios", "params")
register_cte("sim_decided", decision_sql("simulated", "sim_params", "category, scenario_id", "NULL::TIMESTAMP"), "simulated", "sim_params")
register_cte(
    "report",
    """
    SELECT sd.category, sd.scenario_id, sc.discount_percent, b.recommended_action AS base_recommended_action, sd.recommended_action,
           sd.order_quantity, CAST(printf('%.2f', sd.raw_reorder) AS DOUBLE) AS reorder_point, b.reorder_point AS base_reorder_point,
           CAST(printf('%.2f', sd.raw_safety) AS DOUBLE) AS safety_stock, CAST(printf('%.3f', sd.raw_risk) AS DOUBLE) AS risk_score, sd.data_stale_warning, m.avg_uplift, m.scale AS interval_scale,
           m.total - t.total AS raw_total_delta,
           CAST(printf('%.3f', CAST(printf('%.3f', sd.raw_risk) AS DOUBLE) - b.risk_score) AS DOUBLE) AS risk_delta,
           CAST(sd.order_quantity - b.order_quantity AS BIGINT) AS order_quantity_delta,
           least(100, greatest(0, 100 - least(100, 65 * CAST(printf('%.3f', sd.raw_risk) AS DOUBLE))
                 - CASE WHEN m.mean <= 0 OR sd.current_inventory / m.mean >= 14 THEN 0 ELSE 2 * (14 - sd.current_inventory / m.mean) END
                 - 80 * (m.scale - 1))) AS raw_index,
           list_sort(list_distinct(list_concat(bw.warnings, sw.warnings))) AS warnings
    FROM sim_decided sd JOIN scenarios sc USING (category, scenario_id) JOIN decisions b ON b.category = sd.category
    JOIN (SELECT category, scenario_id, avg(uplift) AS avg_uplift, max(scale) AS scale, sum(predicted_mean) AS total, avg(predicted_mean) AS mean
          FROM simulated GROUP BY 1, 2) m ON m.category = sd.category AND m.scenario_id = sd.scenario_id
    JOIN (SELECT category, sum(predicted_mean) AS total FROM forecast GROUP BY 1) t ON t.category = sd.category
    JOIN base_warnings bw ON bw.category = sd.category
    JOIN sim_warnings sw ON sw.category = sd.category AND sw.scenario_id = sd.scenario_id""",
    "sim_decided", "decisions", "base_warnings", "sim_warnings",
)
register_cte(
    "portfolio",
    """
    SELECT *, CASE WHEN recommended_action = 'URGENT_ORDER' OR gap_ratio > 0.4 THEN 'critical'
                   WHEN recommended_action = 'ORDER' OR gap_ratio > 0.1 THEN 'warning' ELSE 'healthy' END AS status
    FROM (SELECT d.*, greatest(reorder_point, safety_stock) AS required_stock,
             CASE WHEN greatest(reorder_point, safety_stock) > 0 THEN greatest(0, greatest(reorder_point, safety_stock) - current_inventory) / greatest(reorder_point, safety_stock) ELSE 0 END AS gap_ratio,
             s.demand_first, s.demand_next, CASE WHEN demand_first > 0 THEN (demand_next - demand_first) * 100 / demand_first ELSE 0 END AS change_percent
          FROM decisions d JOIN (SELECT category, coalesce(sum(predicted_mean) FILTER (WHERE day_index <= 30), 0) AS demand_first,
                                        coalesce(sum(predicted_mean) FILTER (WHERE day_index BETWEEN 31 AND 60), 0) AS demand_next FROM forecast GROUP BY 1) s USING (category))""",
    "decisions", "forecast",
)
register_cte(
    "exploded",
    """SELECT festival_name, date, historical_uplift AS u, row_order, trim(unnest(string_split(category, ','))) AS category FROM festivals""",
    "festivals",
)
register_cte(
    "per_category",
    """SELECT festival_name, date, category, min(row_order) AS first_seen, arg_max(u, row_order) AS uplift, max(u) AS top
       FROM exploded WHERE category <> '' GROUP BY 1, 2, 3""",
    "exploded",
)
register_cte(
    "merged",
    f"""SELECT festival_name, date, string_agg(category, ',' ORDER BY first_seen, category) AS category,
               greatest(0, max(top)) AS historical_uplift, 1 + greatest(0, max(top)) AS demand_multiplier,
               CAST(date_diff('day', DATE '{FESTIVAL_DAY}', date) AS INTEGER) AS days_until
        FROM per_category GROUP BY 1, 2""",
    "per_category",
)


def _decisions(t: Domain):
    return d.decide(t.forecast, t.params, as_of())


def _merged(t: Domain):
    return fest.rollup(t.festivals, festival_day())


def _portfolio(t: Domain):
    return reports.portfolio_rows(t.forecast, _decisions(t))


DECISION_COLUMNS = """category, current_inventory, lead_time_days, supplier_pack_size, strftime(last_upload, '%Y-%m-%d %H:%M:%S') AS last_upload,
    recommended_action, CAST(order_quantity AS BIGINT) AS order_quantity, round(raw_reorder, 4) AS reorder_point, round(raw_safety, 4) AS safety_stock,
    round(raw_risk, 4) AS risk_score, festive AS festival_buffer_applied, data_stale_warning, pack_size_applied"""


@query("inventory_decisions", f"SELECT {DECISION_COLUMNS} FROM decided", ("decided",))
def _(t):
    return plain(d.decide(t.forecast, t.params, as_of(), rounded=False))


@query(
    "safety_stock_low_service",
    """SELECT category, round(greatest(0, coalesce(1.28 * avg_std * sqrt(n) * CASE WHEN festive THEN 1.3 ELSE 1 END, 0)), 4) AS safety_stock FROM decided""",
    ("decided",),
)
def _(t):
    return plain(d.decide(t.forecast, t.params, as_of(), service_level=0.9, rounded=False).select("category", "safety_stock"))


@query(
    "params_with_defaults",
    """SELECT k.category, coalesce(p.current_inventory, 0) AS current_inventory, coalesce(p.lead_time_days, 7) AS lead_time_days,
              coalesce(p.supplier_pack_size, 1) AS supplier_pack_size, strftime(p.last_upload, '%Y-%m-%d %H:%M:%S') AS last_upload
       FROM (SELECT DISTINCT category FROM skus) k LEFT JOIN (SELECT * FROM params WHERE last_upload IS NOT NULL) p USING (category)""",
    ("skus", "params"),
)
def _(t):
    return plain(d.with_params(t.daily, t.params.filter("last_upload IS NOT NULL"), t.skus))


@query(
    "forecast_sanity_warnings",
    "SELECT category, array_to_string(warnings, '|') AS warnings, len(warnings) = 0 AS valid FROM base_warnings",
    ("base_warnings",),
)
def _(t):
    return plain(d.sanity_warnings(t.forecast))


@query(
    "item_level_sanity_warnings",
    "SELECT sku_id, array_to_string(warnings, '|') AS warnings, len(warnings) = 0 AS valid FROM ("
    + warnings_sql(
        """(SELECT sku_id, row_number() OVER (PARTITION BY sku_id ORDER BY date) AS day_index, CAST(units_sold - 25 AS DOUBLE) AS predicted_mean,
                   CAST(units_sold AS DOUBLE) AS upper_95 FROM sales)""",
        "sku_id",
    )
    + ")",
    ("sales",),
)
def _(t):
    rows = t.sales.selectExpr(
        "sku_id", "row_number() OVER (PARTITION BY sku_id ORDER BY date) AS day_index",
        "CAST(units_sold - 25 AS DOUBLE) AS predicted_mean", "CAST(units_sold AS DOUBLE) AS upper_95",
    )
    return plain(d.sanity_warnings(rows, ["sku_id"]))


@query(
    "horizon_ends",
    """SELECT category, arg_min(predicted_mean, day_index) AS first_prediction, arg_max(predicted_mean, day_index) AS last_prediction,
              CAST(max(day_index) AS INTEGER) AS horizon FROM forecast GROUP BY 1""",
    ("forecast",),
)
def _(t):
    return t.forecast.groupBy("category").agg(
        F.min_by("predicted_mean", "day_index").alias("first_prediction"),
        F.max_by("predicted_mean", "day_index").alias("last_prediction"), F.max("day_index").alias("horizon"),
    )


@query(
    "discounted_forecast",
    """SELECT category, scenario_id, day_index, CAST(date AS VARCHAR) AS date, round(uplift, 7) AS uplift, round(scale, 7) AS interval_scale,
              round(predicted_mean, 7) AS predicted_mean, round(lower_95, 7) AS lower_95, round(upper_95, 7) AS upper_95 FROM simulated""",
    ("simulated",),
)
def _(t):
    out = scenario.apply_scenarios(t.forecast, scenario.valid_scenarios(t.scenarios))
    return plain(out.select("category", "scenario_id", "day_index", "date", "uplift", "interval_scale", "predicted_mean", "lower_95", "upper_95"), 7)


@query(
    "rejected_scenarios",
    """SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 100 > 70 THEN 'discount_percent must lie between 0 and 70' END,
              CASE WHEN o_orderpriority <> '1-URGENT' THEN 'elasticity_mode must be one of conservative, balanced, aggressive' END) AS reasons
       FROM orders WHERE o_orderkey % 100 > 70 OR o_orderpriority <> '1-URGENT'""",
)
def _(t):
    asked = t.table("orders").selectExpr(
        "o_orderkey", "CAST(o_orderkey % 100 AS double) AS discount_percent", "IF(o_orderpriority = '1-URGENT', 'balanced', o_orderpriority) AS elasticity_mode"
    )
    return plain(scenario.rejected_scenarios(asked).select("o_orderkey", "reasons"))


@query(
    "baseline_beside_simulation",
    """SELECT f.category, s.scenario_id, CAST(f.date AS VARCHAR) AS date, f.predicted_mean, round(s.predicted_mean, 7) AS simulated_mean
       FROM forecast f LEFT JOIN simulated s ON s.category = f.category AND s.date = f.date""",
    ("forecast", "simulated"),
)
def _(t):
    out = scenario.with_simulation(t.forecast, scenario.apply_scenarios(t.forecast, t.scenarios))
    return plain(out.select("category", "scenario_id", "date", "predicted_mean", "simulated_mean"), 7)


@query(
    "scenario_report",
    """SELECT category, scenario_id, base_recommended_action, recommended_action, CAST(order_quantity AS BIGINT) AS order_quantity,
              risk_score, data_stale_warning, round(avg_uplift, 4) AS avg_uplift, round(interval_scale, 4) AS interval_scale,
              CAST(printf('%.2f', raw_total_delta) AS DOUBLE) AS forecast_total_delta, risk_delta, order_quantity_delta,
              CAST(printf('%.2f', raw_index) AS DOUBLE) AS supply_stability_index, array_to_string(warnings, '|') AS warnings,
              reorder_point, safety_stock, CAST(printf('%.2f', reorder_point - base_reorder_point) AS DOUBLE) AS reorder_point_delta FROM report""",
    ("report",),
)
def _(t):
    out = scenario.scenario_report(t.forecast, t.scenarios, t.params, as_of())
    return plain(out)


@query(
    "scenario_explanation",
    """SELECT category, scenario_id, printf('A %.1f%% discount for %s increases projected demand and changes inventory risk. Expected order quantity shifts by %d units with risk delta %+.3f. Use this scenario to align purchase timing and supplier capacity before launching the promotion.',
              discount_percent, category, order_quantity_delta, risk_delta) AS explanation FROM report""",
    ("report",),
)
def _(t):
    out = scenario.scenario_report(t.forecast, t.scenarios, t.params, as_of()).join(t.scenarios, ["category", "scenario_id"])
    return reports.scenario_text(out).select("category", "scenario_id", "explanation")


@query(
    "portfolio_rows",
    """SELECT category, recommended_action, round(risk_score, 4) AS risk_score, round(required_stock, 4) AS required_stock, round(gap_ratio, 4) AS gap_ratio,
              demand_first, demand_next, round(change_percent, 4) AS change_percent, status FROM portfolio""",
    ("portfolio",),
)
def _(t):
    return plain(_portfolio(t).select(
        "category", "recommended_action", "risk_score", "required_stock", "gap_ratio", "demand_first", "demand_next", "change_percent", "status"
    ))


@query(
    "portfolio_kpis",
    """SELECT *, CASE WHEN urgent_count > 0 THEN printf('Warning: %d categories need ordering, %d critical - %s is critical', needs_order_count, urgent_count, critical_category)
                     WHEN order_count > 0 THEN printf('%d categories need ordering, %d critical - prioritize %s', needs_order_count, urgent_count, critical_category)
                     ELSE '0 categories need ordering, 0 critical - all categories are MONITOR/MAINTAIN' END AS banner
       FROM (SELECT CAST(floor(sum(demand_next) + 0.5) AS BIGINT) AS forecast_30,
              round((sum(demand_next) - sum(demand_first)) * 100 / sum(demand_first), 4) AS forecast_change_percent,
              first(category ORDER BY risk_score DESC, category) AS highest_risk_category, max(risk_score) AS highest_risk_score,
              CAST(floor(sum(greatest(0, required_stock - current_inventory)) + 0.5) AS BIGINT) AS inventory_gap, count(*) AS active_categories,
              count(*) FILTER (WHERE recommended_action = 'URGENT_ORDER') AS urgent_count, count(*) FILTER (WHERE recommended_action = 'ORDER') AS order_count,
              count(*) FILTER (WHERE recommended_action IN ('URGENT_ORDER', 'ORDER')) AS needs_order_count,
              CASE WHEN bool_or(recommended_action = 'URGENT_ORDER') THEN 'urgent' WHEN bool_or(recommended_action = 'ORDER') THEN 'order' ELSE 'ok' END AS severity,
              coalesce(min(category) FILTER (WHERE recommended_action = 'URGENT_ORDER'), min(category) FILTER (WHERE recommended_action = 'ORDER')) AS critical_category
       FROM portfolio)""",
    ("portfolio",),
)
def _(t):
    return plain(reports.portfolio_kpis(_portfolio(t)))


def _grouped_sql(x: str) -> str:
    """Thousands separators and up to two decimals of a value rounded to cents."""
    cents = f"CAST(round(({x}) * 100) AS BIGINT)"
    return f"""(format('{{:,}}', {cents} // 100) || CASE WHEN {cents} % 100 = 0 THEN '' WHEN {cents} % 10 = 0 THEN '.' || ({cents} % 100 // 10)
               ELSE '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') END)"""


@query(
    "risk_drilldown",
    f"""SELECT category, composite_risk, round(inventory_risk, 4) AS inventory_risk, round(uncertainty, 4) AS uncertainty_risk, demand_30, daily_mean, daily_std,
               days_to_stockout, breached, round(CASE WHEN breached THEN reorder_point - current_inventory ELSE 0 END, 4) AS deficit,
               CASE WHEN breached THEN 'Current stock (' || format('{{:,}}', current_inventory) || ') is ' || printf('%.1f', floor((reorder_point - current_inventory) / reorder_point * 1000 + 0.5) / 10)
                         || '% below reorder point (' || {_grouped_sql('reorder_point')} || ')'
                    ELSE 'Stock is comfortably above reorder point (' || format('{{:,}}', current_inventory) || ' vs ' || {_grouped_sql('reorder_point')} || ', +'
                         || printf('%.1f', floor((current_inventory - reorder_point) / reorder_point * 1000 + 0.5) / 10) || '%)' END
               || '|' || printf('Demand variability is %s - coefficient of variation is %.2f', CASE WHEN uncertainty >= 0.5 THEN 'high' WHEN uncertainty >= 0.3 THEN 'medium' ELSE 'low' END, floor(uncertainty * 100 + 0.5) / 100)
               || CASE WHEN lead_time_days >= 10 THEN '|' || printf('Long lead time (%d days) amplifies stockout risk', lead_time_days) ELSE '' END
               || CASE WHEN days_to_stockout <= 14 THEN '|' || printf('Only %d days of stock remaining at current burn rate', days_to_stockout) ELSE '' END AS reasons,
               CASE WHEN breached THEN 'Stock is ' || {_grouped_sql('reorder_point - current_inventory')} || ' units below the reorder point. '
                         || printf('Given the %d-day lead time, reorder soon to avoid stockout.', lead_time_days)
                    ELSE 'Current inventory is ' || printf('%.1f', floor((current_inventory - reorder_point) / reorder_point * 1000 + 0.5) / 10) || '% above the reorder point. No action required at this time.' END AS explanation
        FROM (SELECT *, least(1, greatest(0, (composite_risk / 100 - 0.6 * inventory_risk) / 0.4)) AS uncertainty
          FROM (SELECT p.*, CAST(floor(risk_score * 100 + 0.5) AS BIGINT) AS composite_risk, least(1, greatest(0, (reorder_point - current_inventory) / reorder_point)) AS inventory_risk,
                  current_inventory < reorder_point AS breached, CAST(floor(f.d30 + 0.5) AS BIGINT) AS demand_30, CAST(floor(f.m + 0.5) AS BIGINT) AS daily_mean,
                  CAST(floor(f.s + 0.5) AS BIGINT) AS daily_std, CAST(floor(current_inventory / f.m + 0.5) AS BIGINT) AS days_to_stockout
                FROM portfolio p JOIN (SELECT category, sum(predicted_mean) FILTER (WHERE day_index <= 30) AS d30, avg(predicted_mean) AS m, stddev_samp(predicted_mean) AS s
                                       FROM forecast GROUP BY 1) f USING (category)))""",
    ("portfolio", "forecast"),
)
def _(t):
    return plain(reports.risk_drilldown(t.forecast, _portfolio(t)))


@query(
    "lead_time_stock_gap",
    """SELECT f.category, round(sum(predicted_mean), 4) AS lead_demand, CAST(greatest(0, floor(sum(predicted_mean) - any_value(current_inventory) + 0.5)) AS BIGINT) AS stock_gap
       FROM forecast f JOIN params p USING (category) WHERE day_index <= lead_time_days GROUP BY 1""",
    ("forecast", "params"),
)
def _(t):
    return plain(reports.lead_time_gap(t.forecast, t.params))


@query(
    "model_health",
    f"""SELECT category, strftime(last_upload, '%Y-%m-%d %H:%M:%S') AS last_upload, coalesce(last_upload < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false) AS stale,
               CAST(n AS BIGINT) AS training_points,
               CASE WHEN CAST(printf('%.3f', raw_risk) AS DOUBLE) >= 0.7 THEN 'degraded' WHEN CAST(printf('%.3f', raw_risk) AS DOUBLE) >= 0.4 THEN 'watch' ELSE 'healthy' END AS health FROM decided""",
    ("decided",),
)
def _(t):
    from stockcast.functions.calendar import is_stale

    return plain(reports.model_health(_decisions(t), is_stale(F.col("last_upload"), as_of()), t.forecast))


@query(
    "confidence_bands",
    """SELECT category, CAST(day_index AS INTEGER) AS day_index, CASE WHEN day_index <= 7 THEN 'high' WHEN day_index <= 14 THEN 'medium' ELSE 'low' END AS confidence_level,
              CASE WHEN day_index <= 7 THEN predicted_mean END AS high_conf, CASE WHEN day_index BETWEEN 8 AND 14 THEN predicted_mean END AS medium_conf,
              CASE WHEN day_index > 14 THEN predicted_mean END AS low_conf FROM forecast""",
    ("forecast",),
)
def _(t):
    from stockcast.functions.calendar import confidence

    out = reports.confidence_split(t.forecast).withColumn("confidence_level", confidence(F.col("day_index")))
    return out.select("category", "day_index", "confidence_level", "high_conf", "medium_conf", "low_conf")


@query(
    "inventory_overrides",
    """SELECT category, CAST(CASE WHEN stock >= 0 THEN floor(stock + 0.5) ELSE current_inventory END AS INTEGER) AS current_inventory, lead_time_days
       FROM params JOIN (SELECT category, (avg(mrp) - 950) * count(*) / 7.0 AS stock FROM skus GROUP BY 1) USING (category)""",
    ("params", "skus"),
)
def _(t):
    overrides = t.skus.groupBy("category").agg(((F.avg("mrp") - 950) * F.count("*") / 7.0).alias("stock"))
    return reports.apply_overrides(t.params, overrides).select("category", "current_inventory", "lead_time_days")


@query(
    "decision_insight_text",
    """SELECT category, category || ' has elevated stock risk right now, especially around local demand changes and seasonal events. Please '
              || lower(replace(recommended_action, '_', ' ')) || ' and plan approximately ' || order_quantity
              || ' units based on current estimates. Recheck inventory and sales trend within 24 hours.' AS insight FROM decisions""",
    ("decisions",),
)
def _(t):
    out = reports.insight_text(_decisions(t))
    return out.select("category", F.regexp_replace("insight", r" \(risk score: [0-9.]+\)", "").alias("insight"))


# --- festivals ---------------------------------------------------------------

@query(
    "festival_rollup",
    """SELECT festival_name, CAST(date AS VARCHAR) AS date, category, round(historical_uplift, 4) AS historical_uplift,
              round(demand_multiplier, 4) AS demand_multiplier, days_until FROM merged""",
    ("merged",),
)
def _(t):
    return plain(_merged(t).drop("categories", "category_uplifts"))


@query(
    "festival_export_expanded",
    "SELECT festival_name, CAST(date AS VARCHAR) AS date, category, round(uplift, 4) AS historical_uplift FROM per_category",
    ("per_category",),
)
def _(t):
    return plain(fest.expand(_merged(t)))


@query(
    "festivals_in_month",
    "SELECT festival_name, CAST(date AS VARCHAR) AS date, category, round(historical_uplift, 4) AS historical_uplift FROM festivals WHERE month(date) = 10 AND year(date) = 2000",
    ("festivals",),
)
def _(t):
    return plain(fest.in_period(t.festivals, 10, 2000).drop("row_order"))


@query(
    "festival_on_date",
    """SELECT CAST(date AS VARCHAR) AS date, arg_min(festival_name, row_order) AS festival_name, round(arg_min(historical_uplift, row_order), 4) AS uplift
       FROM festivals GROUP BY date""",
    ("festivals",),
)
def _(t):
    return plain(fest.on_date(t.festivals))


@query(
    "next_festival",
    """SELECT festival_name, CAST(date AS VARCHAR) AS date FROM festivals WHERE date >= DATE '1999-05-10'
       ORDER BY month(date) = 5 AND year(date) = 1999, date, row_order LIMIT 1""",
    ("festivals",),
)
def _(t):
    return plain(fest.next_festival(t.festivals, F.lit("1999-05-10").cast("date"), 5, 1999))


@query(
    "upcoming_festivals",
    "SELECT festival_name, CAST(date AS VARCHAR) AS date, category, days_until FROM merged WHERE days_until BETWEEN 0 AND 60",
    ("merged",),
)
def _(t):
    return plain(fest.upcoming(_merged(t)).select("festival_name", "date", "category", "days_until"))


@query(
    "festival_readiness",
    """SELECT festival_name, CAST(date AS VARCHAR) AS date, category, stock AS current_stock, required_stock, gap,
              CASE WHEN required_stock > 0 AND gap / required_stock >= 0.35 THEN 'CRITICAL' WHEN required_stock > 0 AND gap / required_stock > 0.1 THEN 'AT RISK' ELSE 'READY' END AS status
       FROM (SELECT *, greatest(0, required_stock - stock) AS gap FROM
             (SELECT m.festival_name, m.date, c.category, coalesce(d.current_inventory, 0) AS stock,
                     CAST(floor(coalesce(greatest(d.reorder_point, d.safety_stock), 0) * (1 + c.uplift) + 0.5) AS BIGINT) AS required_stock
              FROM merged m JOIN per_category c ON c.festival_name = m.festival_name AND c.date = m.date LEFT JOIN decisions d ON d.category = c.category
              WHERE m.days_until BETWEEN 0 AND 60))""",
    ("merged", "per_category", "decisions"),
)
def _(t):
    return plain(reports.festival_readiness(fest.upcoming(_merged(t)), _decisions(t)))


@query(
    "festival_markers",
    """SELECT festival_name, CAST(date AS VARCHAR) AS date, round(least(1, historical_uplift * 2), 4) AS inferred_score FROM merged
       WHERE least(1, historical_uplift * 2) > 0.5 AND date IN (SELECT date FROM forecast)""",
    ("merged", "forecast"),
)
def _(t):
    return plain(reports.festival_markers(_merged(t), t.forecast).select("festival_name", "date", "inferred_score"))


@query(
    "festival_calendar_cards",
    """SELECT festival_name, CAST(date AS VARCHAR) AS date, days_until, CASE WHEN days_until < 0 THEN 'passed' WHEN days_until <= 7 THEN 'urgent' WHEN days_until <= 14 THEN 'soon' ELSE 'later' END AS urgency,
              lead AS min_lead_days, CAST(CAST(date - to_days(CAST(lead AS INTEGER)) AS DATE) AS VARCHAR) AS stock_up_date
       FROM merged JOIN (SELECT c.festival_name, c.date, CAST(min(coalesce(p.lead_time_days, 5)) AS INTEGER) AS lead FROM per_category c LEFT JOIN params p ON p.category = c.category GROUP BY 1, 2) l
       USING (festival_name, date)""",
    ("merged", "per_category", "params"),
)
def _(t):
    return plain(reports.calendar_cards(_merged(t), t.params, festival_day()))


@query(
    "festival_demand_impact",
    """SELECT festival_name, CAST(date AS VARCHAR) AS date, category, CAST(floor(uplift * 100 + 0.5) AS BIGINT) AS impact_percent,
              least(100, CAST(floor(uplift * 100 + 0.5) AS BIGINT) * 2) AS bar_width FROM per_category""",
    ("per_category",),
)
def _(t):
    return plain(reports.demand_impact(_merged(t)))


@query(
    "light_prediction",
    """SELECT r.category, CAST(r.date AS VARCHAR) AS date, CAST(printf('%.2f', greatest(0, m * (1 + coalesce(u, 0)))) AS DOUBLE) AS predicted_demand,
              least(1, CAST(printf('%.3f', s / m) AS DOUBLE)) AS risk_score,
              CASE WHEN least(1, CAST(printf('%.3f', s / m) AS DOUBLE)) >= 0.8 THEN 'low' WHEN least(1, CAST(printf('%.3f', s / m) AS DOUBLE)) >= 0.4 THEN 'medium' ELSE 'high' END AS confidence_level,
              CASE WHEN u >= 0.3 THEN 'Increase inventory before festival demand spike.' WHEN least(1, CAST(printf('%.3f', s / m) AS DOUBLE)) >= 0.6 THEN 'Monitor inventory closely and plan a buffer restock.'
                   ELSE 'Maintain regular replenishment plan.' END AS suggested_action
       FROM daily r JOIN (SELECT category, avg(units_sold) AS m, stddev_samp(units_sold) AS s FROM recent WHERE age <= 30 GROUP BY 1) l USING (category)
       LEFT JOIN (SELECT date, arg_min(historical_uplift, row_order) AS u FROM festivals GROUP BY 1) f ON f.date = r.date""",
    ("daily", "recent", "festivals"),
)
def _(t):
    from stockcast.operators.demand import recent_level

    return plain(reports.light_prediction(recent_level(t.daily), t.daily.select("category", "date"), fest.on_date(t.festivals)))


# --- whole path ---------------------------------------------------------------

@query("batch_forecast_decisions")
def _(t):
    from stockcast.plans.batch import forecast_decisions

    return plain(forecast_decisions(t.sales, t.skus, t.festivals, t.params, as_of(), 60))
