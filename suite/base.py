"""Registry of check queries and the domain tables derived from the given ones.

Each domain table exists twice: as a DataFrame for the library and as a SQL
common table expression for the comparison engine.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ensure_scratch(spark: SparkSession) -> None:
    """For checks on one machine: a folder of their own where the session names none. A cluster has to name one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checks-"))


AS_OF = "2024-01-31 00:00:00"
FESTIVAL_DAY = "2001-09-15"

CTES = {
    "sales": """
        SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS sku_id,
               CAST(sum(l_quantity) AS BIGINT) AS units_sold
        FROM lineitem GROUP BY 1, 2""",
    "skus": """
        SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS product_name,
               CASE p_type WHEN 'STANDARD' THEN 'Snacks' WHEN 'SMALL' THEN 'Staples' WHEN 'MEDIUM' THEN 'Edible Oil'
                           WHEN 'PROMO' THEN 'Promo' WHEN 'LARGE' THEN 'Large' ELSE 'Economy' END AS category,
               p_retailprice AS mrp, 0.7 * p_retailprice AS cost, CAST(p_size * 20 AS INTEGER) AS current_inventory
        FROM part""",
    "festivals": """
        SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Diwali' WHEN '2-HIGH' THEN 'Navratri'
                    WHEN '3-MEDIUM' THEN 'Eid ul-Fitr' WHEN '4-NOT SPECIFIED' THEN 'Ram Navami'
                    ELSE ' Holi' END AS festival_name,
               CAST(o_orderdate AS DATE) + 100 AS date,
               CASE o_orderstatus WHEN 'F' THEN 'Snacks, Staples' WHEN 'O' THEN 'Edible Oil' ELSE 'Staples' END AS category,
               floor(o_totalprice / 5000 + 0.5) / 100 AS historical_uplift,
               o_orderkey AS row_order
        FROM orders""",
    "upload_events": """
        SELECT CASE event_type WHEN 'click' THEN 'Snacks' WHEN 'view' THEN 'Staples' WHEN 'purchase' THEN 'Edible Oil'
                    WHEN 'signup' THEN 'Promo' ELSE 'Large' END AS category,
               CASE WHEN event_type = 'view' THEN ts - INTERVAL 20 DAY ELSE ts END AS uploaded_at
        FROM events""",
    "audit_log": """
        SELECT CASE event_type WHEN 'click' THEN 'Snacks' WHEN 'view' THEN 'Staples' WHEN 'purchase' THEN 'Edible Oil'
                    WHEN 'signup' THEN 'Promo' ELSE 'Large' END AS category,
               ts AS timestamp, floor(value / 4 + 0.5) / 1000 AS risk_score,
               CASE user_id % 5
                    WHEN 0 THEN '{"type":"forecast_decision","decision":{"recommended_action":"ORDER","order_quantity":' || CAST(event_id AS VARCHAR) || '}}'
                    WHEN 1 THEN 'Order soon, event ' || CAST(event_id AS VARCHAR)
                    WHEN 2 THEN '  '
                    WHEN 3 THEN '{"decision":{"recommended_action":"MONITOR"},"n":' || props || '}'
                    ELSE '{broken ' || props END AS insight,
               event_id
        FROM events""",
    "params": """
        SELECT category,
               CAST(CASE category WHEN 'Snacks' THEN floor(sum(current_inventory) / 400)
                                  WHEN 'Staples' THEN floor(sum(current_inventory) / 90)
                                  ELSE floor(sum(current_inventory) / 20) END AS INTEGER) AS current_inventory,
               CAST(CASE category WHEN 'Snacks' THEN 5 WHEN 'Staples' THEN 7 WHEN 'Edible Oil' THEN 10 ELSE 12 END AS INTEGER) AS lead_time_days,
               CAST(CASE WHEN category IN ('Snacks', 'Large') THEN 12 ELSE 1 END AS INTEGER) AS supplier_pack_size,
               max(last_upload) AS last_upload
        FROM skus LEFT JOIN (SELECT category AS c, max(uploaded_at) AS last_upload FROM upload_events GROUP BY 1) u
             ON u.c = skus.category
        GROUP BY category""",
    "daily": """
        SELECT category, date, CAST(sum(units_sold) AS BIGINT) AS units_sold
        FROM sales JOIN skus USING (sku_id) GROUP BY 1, 2""",
    "recent": """
        SELECT category, date, units_sold,
               row_number() OVER (PARTITION BY category ORDER BY date DESC) AS age,
               stddev_samp(units_sold) OVER (PARTITION BY category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s
        FROM daily""",
    "forecast": """
        SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY date) AS INTEGER) AS day_index, date,
               CAST(units_sold AS DOUBLE) AS predicted_mean,
               greatest(0.0, units_sold - 1.96 * coalesce(s, 0)) AS lower_95,
               greatest(0.0, units_sold + 1.96 * coalesce(s, 0)) AS upper_95,
               CASE WHEN category IN ('Snacks', 'Promo') THEN (day(date) % 8) / 10.0 ELSE (day(date) % 8) / 20.0 END AS festival_score
        FROM recent""",
    "scenarios": """
        SELECT category, s.scenario_id, s.discount_percent, s.elasticity_mode
        FROM (SELECT DISTINCT category FROM skus) k,
             (VALUES ('mild', 5.0::DOUBLE, 'conservative'), ('mid', 20.0::DOUBLE, 'balanced'), ('deep', 70.0::DOUBLE, 'aggressive'))
             AS s(scenario_id, discount_percent, elasticity_mode)""",
}
NEEDS = {
    "params": ("skus", "upload_events"),
    "daily": ("sales", "skus"),
    "recent": ("daily",),
    "forecast": ("recent",),
    "scenarios": ("skus",),
}


def register_cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = text
    NEEDS[name] = needs


def with_tables(body: str, *tables: str) -> str:
    """``body`` behind the common table expressions it needs, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for table in tables:
        add(table)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH {parts}\n{body}"


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register a check query; ``sql`` is its plain-SQL counterpart."""
    def wrap(fn: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables)
        return fn

    return wrap


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def festival_day():
    return F.lit(FESTIVAL_DAY).cast("date")


class Domain:
    """Domain tables as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ensure_scratch(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sales_tasks(self) -> int:
        """Partitions for shuffles of rows as many as the sales; the count comes from the file's footers."""
        from stockcast.session import tasks_of

        return tasks_of(self.table("lineitem").count(), self.spark)

    @cached_property
    def sales(self) -> DataFrame:
        rows = self.table("lineitem").select(
            F.col("l_shipdate").cast("date").alias("date"), F.col("l_partkey").cast("string").alias("sku_id"), "l_quantity"
        )
        return rows.repartition(self.sales_tasks, "date", "sku_id").groupBy("date", "sku_id").agg(F.sum("l_quantity").cast("bigint").alias("units_sold"))

    @cached_property
    def skus(self) -> DataFrame:
        category = F.expr(
            """CASE p_type WHEN 'STANDARD' THEN 'Snacks' WHEN 'SMALL' THEN 'Staples' WHEN 'MEDIUM' THEN 'Edible Oil'
               WHEN 'PROMO' THEN 'Promo' WHEN 'LARGE' THEN 'Large' ELSE 'Economy' END"""
        )
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("sku_id"), F.col("p_name").alias("product_name"),
            category.alias("category"), F.col("p_retailprice").alias("mrp"),
            (F.lit(0.7) * F.col("p_retailprice")).alias("cost"), (F.col("p_size") * 20).cast("int").alias("current_inventory"),
        )

    @cached_property
    def festivals(self) -> DataFrame:
        return self.table("orders").select(
            F.expr(
                """CASE o_orderpriority WHEN '1-URGENT' THEN 'Diwali' WHEN '2-HIGH' THEN 'Navratri'
                   WHEN '3-MEDIUM' THEN 'Eid ul-Fitr' WHEN '4-NOT SPECIFIED' THEN 'Ram Navami' ELSE ' Holi' END"""
            ).alias("festival_name"),
            F.date_add(F.col("o_orderdate").cast("date"), 100).alias("date"),
            F.expr(
                "CASE o_orderstatus WHEN 'F' THEN 'Snacks, Staples' WHEN 'O' THEN 'Edible Oil' ELSE 'Staples' END"
            ).alias("category"),
            (F.floor(F.col("o_totalprice") / 5000 + 0.5) / 100).alias("historical_uplift"),
            F.col("o_orderkey").alias("row_order"),
        )

    @property
    def _event_category(self):
        return F.expr(
            """CASE event_type WHEN 'click' THEN 'Snacks' WHEN 'view' THEN 'Staples' WHEN 'purchase' THEN 'Edible Oil'
               WHEN 'signup' THEN 'Promo' ELSE 'Large' END"""
        )

    @cached_property
    def upload_events(self) -> DataFrame:
        shifted = F.expr("CASE WHEN event_type = 'view' THEN ts - INTERVAL 20 DAYS ELSE ts END")
        return self.table("events").select(
            self._event_category.alias("category"), shifted.cast("timestamp").alias("uploaded_at")
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        insight = F.expr(
            """CASE user_id % 5
                WHEN 0 THEN concat('{"type":"forecast_decision","decision":{"recommended_action":"ORDER","order_quantity":', event_id, '}}')
                WHEN 1 THEN concat('Order soon, event ', event_id)
                WHEN 2 THEN '  '
                WHEN 3 THEN concat('{"decision":{"recommended_action":"MONITOR"},"n":', props, '}')
                ELSE concat('{broken ', props) END"""
        )
        return self.table("events").select(
            self._event_category.alias("category"), F.col("ts").cast("timestamp").alias("timestamp"),
            (F.floor(F.col("value") / 4 + 0.5) / 1000).alias("risk_score"), insight.alias("insight"), "event_id",
        )

    @cached_property
    def params(self) -> DataFrame:
        from stockcast.sources.store import last_uploads

        stock = F.expr(
            """CAST(CASE category WHEN 'Snacks' THEN floor(sum(current_inventory) / 400)
               WHEN 'Staples' THEN floor(sum(current_inventory) / 90)
               ELSE floor(sum(current_inventory) / 20) END AS INT)"""
        )
        lead = F.expr("CASE category WHEN 'Snacks' THEN 5 WHEN 'Staples' THEN 7 WHEN 'Edible Oil' THEN 10 ELSE 12 END")
        pack = F.expr("CASE WHEN category IN ('Snacks', 'Large') THEN 12 ELSE 1 END")
        base = self.skus.groupBy("category").agg(stock.alias("current_inventory"))
        return base.select("category", "current_inventory", lead.alias("lead_time_days"), pack.alias("supplier_pack_size")).join(
            last_uploads(self.upload_events), "category", "left"
        )

    @cached_property
    def daily(self) -> DataFrame:
        from stockcast.operators.demand import daily_demand

        return daily_demand(self.sales, self.skus)

    @cached_property
    def forecast(self) -> DataFrame:
        """Stand-in forecast: the whole history of each series as if predicted."""
        score = F.expr(
            "CASE WHEN category IN ('Snacks', 'Promo') THEN (day(date) % 8) / 10.0D ELSE (day(date) % 8) / 20.0D END"
        )
        rows = self.daily.selectExpr(
            "category", "date", "units_sold",
            "CAST(row_number() OVER (PARTITION BY category ORDER BY date) AS INT) AS day_index",
            "coalesce(stddev_samp(units_sold) OVER (PARTITION BY category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0D) AS s",
        )
        return rows.select(
            "category", "day_index", "date",
            F.col("units_sold").cast("double").alias("predicted_mean"),
            F.expr("greatest(0D, units_sold - 1.96D * s)").alias("lower_95"),
            F.expr("greatest(0D, units_sold + 1.96D * s)").alias("upper_95"),
            score.alias("festival_score"),
        )

    @cached_property
    def scenarios(self) -> DataFrame:
        grid = F.expr(
            """explode(array(
                named_struct('scenario_id', 'mild', 'discount_percent', 5D, 'elasticity_mode', 'conservative'),
                named_struct('scenario_id', 'mid', 'discount_percent', 20D, 'elasticity_mode', 'balanced'),
                named_struct('scenario_id', 'deep', 'discount_percent', 70D, 'elasticity_mode', 'aggressive')))"""
        )
        known = self.skus.select("category").distinct()
        return known.select("category", grid.alias("s")).select("category", "s.*")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison with another engine's arithmetic."""
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def round_sql(body: str, columns: str, digits: int = 4) -> str:
    """``body`` with the named columns rounded."""
    replaced = ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))
    return f"SELECT * REPLACE ({replaced}) FROM ({body}) AS r"
