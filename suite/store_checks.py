"""Upserts, scans, caches, logs, and files through batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockcast.functions import text as tx
from stockcast.functions.calendar import is_stale
from stockcast.operators import reuse
from stockcast.plans.ingest import Tables, ingest
from stockcast.schemas import SALES, SKUS
from stockcast.session import ROWS_A_TASK, scratch_path
from stockcast.sources import changes, store, upload
from suite.base import AS_OF, Domain, as_of, query, register_cte
from suite.ingest_checks import known, raw_sales_in_order
from suite.plain import plain

ROWS_A_FILE = 250_000
TTL = 86_400 * 20  # the test log spans thirty days

register_cte(
    "sku_changes",
    """SELECT CASE WHEN p_size > 40 THEN 'NEW' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS sku_id, upper(p_name) AS product_name, p_brand AS category,
              p_retailprice + 1 AS mrp, 1.5::DOUBLE AS cost, CAST(p_size AS INTEGER) AS current_inventory FROM part WHERE p_size % 2 = 0""",
)
register_cte(
    "sales_changes",
    """SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS sku_id, CAST(max(floor(o_totalprice)) AS BIGINT) AS units_sold FROM orders GROUP BY 1, 2""",
)
register_cte(
    "cache",
    """
    SELECT CASE event_type WHEN 'click' THEN 'Snacks' WHEN 'view' THEN 'Staples' WHEN 'purchase' THEN 'Edible Oil' WHEN 'signup' THEN 'Promo' ELSE 'Large' END AS category,
           ts AS generated_at, event_id,
           CASE user_id % 3 WHEN 0 THEN sha256(concat(30, '|', stock, '|', lead)) ELSE sha256(concat(30, '|', stock, '|', lead, '|', pack)) END AS params_hash,
           CASE WHEN user_id % 7 = 0 THEN '{broken' ELSE '{"event":' || event_id || ',"decision":{"recommended_action":"ORDER"}}' END AS payload_json
    FROM (SELECT *, event_id % 6 AS stock, event_id % 2 + 5 AS lead, event_id % 3 AS pack FROM events)""",
)
register_cte(
    "requests",
    """SELECT DISTINCT category || '-' || stock || '-' || lead || '-' || pack AS request_id, category, CAST(30 AS INTEGER) AS n_days, CAST(stock AS INTEGER) AS current_inventory,
              CAST(lead AS INTEGER) AS lead_time_days, CAST(pack AS INTEGER) AS supplier_pack_size
       FROM (SELECT *, event_id % 6 AS stock, event_id % 2 + 5 AS lead, event_id % 3 AS pack FROM cache)""",
    "cache",
)
register_cte(
    "reusable",
    """SELECT *, trim(insight) <> '' AND NOT (starts_with(trim(insight), '{') AND json_valid(insight)
              AND (coalesce(CASE WHEN json_valid(insight) THEN json_extract_string(insight, '$.type') END, '') = 'forecast_decision'
                   OR contains(coalesce(CASE WHEN json_valid(insight) THEN CAST(json_extract(insight, '$.decision') AS VARCHAR) END, ''), 'recommended_action'))) AS ok
       FROM audit_log""",
    "audit_log",
)


def _sku_changes(t: Domain):
    return t.table("part").filter("p_size % 2 = 0").selectExpr(
        "CASE WHEN p_size > 40 THEN concat('NEW', p_partkey) ELSE CAST(p_partkey AS STRING) END AS sku_id", "upper(p_name) AS product_name",
        "p_brand AS category", "p_retailprice + 1 AS mrp", "1.5D AS cost", "CAST(p_size AS INT) AS current_inventory",
    )


def _sales_changes(t: Domain):
    return t.table("orders").groupBy(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_custkey").cast("string").alias("sku_id")
    ).agg(F.max(F.floor("o_totalprice")).alias("units_sold"))


def _cache(t: Domain):
    hashed = """CASE user_id % 3 WHEN 0 THEN sha2(concat(30, '|', event_id % 6, '|', event_id % 2 + 5), 256)
                ELSE sha2(concat(30, '|', event_id % 6, '|', event_id % 2 + 5, '|', event_id % 3), 256) END AS params_hash"""
    payload = """CASE WHEN user_id % 7 = 0 THEN '{broken' ELSE concat('{"event":', event_id, ',"decision":{"recommended_action":"ORDER"}}') END AS payload_json"""
    return t.table("events").select(t._event_category.alias("category"), F.col("ts").cast("timestamp").alias("generated_at"), "event_id",
                                    F.expr(hashed), F.expr(payload))


def _requests(t: Domain):
    rows = _cache(t).selectExpr("category", "event_id % 6 AS stock", "event_id % 2 + 5 AS lead", "event_id % 3 AS pack").distinct()
    return rows.selectExpr(
        "concat(category, '-', stock, '-', lead, '-', pack) AS request_id", "category", "30 AS n_days", "CAST(stock AS INT) AS current_inventory",
        "CAST(lead AS INT) AS lead_time_days", "CAST(pack AS INT) AS supplier_pack_size",
    )


@query(
    "sku_upsert",
    "SELECT * FROM skus WHERE sku_id NOT IN (SELECT sku_id FROM sku_changes) UNION ALL SELECT * FROM sku_changes",
    ("skus", "sku_changes"),
)
def _(t):
    return store.upsert(t.skus, _sku_changes(t), ["sku_id"])


@query(
    "sales_upsert",
    """SELECT CAST(date AS VARCHAR) AS date, sku_id, units_sold FROM
       (SELECT * FROM sales WHERE (date, sku_id) NOT IN (SELECT (date, sku_id) FROM sales_changes) UNION ALL SELECT * FROM sales_changes)""",
    ("sales", "sales_changes"),
)
def _(t):
    return plain(store.upsert(t.sales, _sales_changes(t), ["date", "sku_id"]))


@query(
    "upload_log_of_sales",
    f"SELECT DISTINCT category, '{AS_OF}' AS uploaded_at FROM skus WHERE sku_id IN (SELECT sku_id FROM sales_changes)",
    ("skus", "sales_changes"),
)
def _(t):
    return plain(store.touched_categories(_sales_changes(t), t.skus, as_of()))


@query(
    "upload_log_of_items",
    f"SELECT DISTINCT category, '{AS_OF}' AS uploaded_at FROM sku_changes",
    ("sku_changes",),
)
def _(t):
    return plain(store.touched_categories(_sku_changes(t), t.skus, as_of()))


@query(
    "items_stamped_by_upload",
    f"SELECT sku_id, category, '{AS_OF}' AS last_upload_timestamp FROM skus WHERE sku_id IN (SELECT sku_id FROM sales_changes)",
    ("skus", "sales_changes"),
)
def _(t):
    return plain(store.stamp_items(t.skus, _sales_changes(t), as_of()).select("sku_id", "category", "last_upload_timestamp"))


@query("items_of_category", "SELECT * FROM skus WHERE category = 'Edible Oil'", ("skus",))
def _(t):
    return store.by_category(t.skus, "Edible Oil")


@query(
    "item_page",
    "SELECT *, (SELECT count(*) FROM skus) AS total FROM skus ORDER BY sku_id LIMIT 25 OFFSET 50",
    ("skus",),
)
def _(t):
    return store.page(t.skus, 25, 50)


@query("item_page_after", "SELECT * FROM skus WHERE sku_id > '17' ORDER BY sku_id LIMIT 25", ("skus",))
def _(t):
    return store.page_after(t.skus, "17", 25)


@query(
    "table_counts",
    "SELECT 'sales' AS table_name, count(*) AS n FROM sales UNION ALL SELECT 'festivals', count(*) FROM festivals UNION ALL SELECT 'skus', count(*) FROM skus",
    ("sales", "festivals", "skus"),
)
def _(t):
    return store.counts(t.sales, t.festivals, t.skus)


@query("category_list", "SELECT DISTINCT trim(category) AS category FROM skus WHERE trim(category) <> ''", ("skus",))
def _(t):
    return store.categories(t.skus)


@query(
    "last_upload_per_category",
    "SELECT category, strftime(max(uploaded_at), '%Y-%m-%d %H:%M:%S') AS last_upload FROM upload_events GROUP BY 1",
    ("upload_events",),
)
def _(t):
    return plain(store.last_uploads(t.upload_events))


@query(
    "data_freshness",
    f"""SELECT k.category, coalesce(max(uploaded_at) < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false) AS data_stale
        FROM (SELECT DISTINCT category FROM skus) k LEFT JOIN upload_events e ON e.category = k.category GROUP BY 1""",
    ("skus", "upload_events"),
)
def _(t):
    joined = t.skus.select("category").distinct().join(store.last_uploads(t.upload_events), "category", "left")
    return joined.select("category", is_stale(F.col("last_upload"), as_of()).alias("data_stale"))


@query(
    "log_entries_within_age",
    f"SELECT category, count(*) AS n FROM audit_log WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {TTL} SECOND GROUP BY 1",
    ("audit_log",),
)
def _(t):
    return t.audit_log.filter(store.within_age("timestamp", as_of(), TTL)).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "recent_recommendations",
    """SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, category,
              coalesce(CASE WHEN json_valid(insight) THEN json_extract_string(insight, '$.decision.recommended_action') END, 'n/a') AS action,
              coalesce(TRY_CAST(CASE WHEN json_valid(insight) THEN json_extract_string(insight, '$.decision.order_quantity') END AS INTEGER), 0) AS order_quantity, risk_score
       FROM audit_log ORDER BY audit_log.timestamp DESC, category LIMIT 40""",
    ("audit_log",),
)
def _(t):
    return plain(store.recent_recommendations(t.audit_log, 40))


@query(
    "reusable_insights",
    "SELECT event_id, ok AS reusable FROM reusable",
    ("reusable",),
)
def _(t):
    return t.audit_log.select("event_id", tx.is_reusable_insight(F.col("insight")).alias("reusable"))


@query(
    "request_hashes",
    """SELECT l_orderkey, l_linenumber, l_partkey, sha256(concat(l_linenumber, '|', l_partkey, '|', l_suppkey, '|', CAST(l_quantity AS INTEGER))) AS params_hash,
              sha256(concat(l_linenumber, '|', l_partkey, '|', l_suppkey)) AS older_hash FROM lineitem""",
)
def _(t):
    n, stock, lead = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tx.params_hash(n, stock, lead, F.col("l_quantity").cast("int")).alias("params_hash"),
        tx.params_hash(n, stock, lead).alias("older_hash"),
    )


@query(
    "cached_forecast_lookup",
    f"""SELECT r.request_id, CASE WHEN fresh THEN strftime(h.g, '%Y-%m-%d %H:%M:%S') END AS generated_at, CASE WHEN fresh THEN h.p END AS payload_json, coalesce(fresh, false) AS cache_hit
        FROM requests r LEFT JOIN (
            SELECT request_id, max(generated_at) AS g, arg_max(payload_json, generated_at) AS p, any_value(u) IS NULL OR max(generated_at) >= any_value(u) AS fresh
            FROM requests r JOIN cache c ON c.category = r.category AND c.generated_at >= TIMESTAMP '{AS_OF}' - INTERVAL {TTL} SECOND AND json_valid(c.payload_json)
                 AND (c.params_hash = sha256(concat(n_days, '|', current_inventory, '|', lead_time_days, '|', greatest(1, supplier_pack_size)))
                      OR (greatest(1, supplier_pack_size) = 1 AND c.params_hash = sha256(concat(n_days, '|', current_inventory, '|', lead_time_days))))
            LEFT JOIN (SELECT category, max(uploaded_at) AS u FROM upload_events WHERE uploaded_at < TIMESTAMP '2024-01-25' GROUP BY 1) l ON l.category = r.category
            GROUP BY 1) h USING (request_id)""",
    ("requests", "cache", "upload_events"),
)
def _(t):
    events = t.upload_events.filter("uploaded_at < TIMESTAMP '2024-01-25'")
    out = reuse.cached_forecasts(_requests(t), _cache(t), events, as_of(), TTL)
    return plain(out.select("request_id", "generated_at", "payload_json", "cache_hit"))


@query(
    "cached_insight_lookup",
    f"""SELECT d.category, d.risk_score, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS logged_at, l.insight AS cached_insight
        FROM (SELECT DISTINCT category, risk_score FROM audit_log) d
        LEFT JOIN (SELECT category, risk_score, max(timestamp) AS ts, arg_max(insight, timestamp) AS insight FROM audit_log
                   WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {TTL} SECOND GROUP BY 1, 2) l ON l.category = d.category AND l.risk_score = d.risk_score""",
    ("audit_log",),
)
def _(t):
    wanted = t.audit_log.select("category", "risk_score").distinct()
    return plain(reuse.cached_recommendations(wanted, t.audit_log, as_of(), TTL))


@query(
    "resolved_insights",
    f"""SELECT d.category, d.risk_score, coalesce(l.ok, false) AS reused, CASE WHEN l.ok THEN l.insight ELSE 'text' END AS insight,
               CASE WHEN l.ok THEN strftime(l.ts, '%Y-%m-%d %H:%M:%S') ELSE '{AS_OF}' END AS generated_at
        FROM (SELECT DISTINCT category, risk_score FROM audit_log) d
        LEFT JOIN (SELECT category, risk_score, max(timestamp) AS ts, arg_max(insight, timestamp) AS insight, arg_max(ok, timestamp) AS ok FROM reusable
                   WHERE timestamp >= TIMESTAMP '2024-01-30 10:00:00' - INTERVAL 3600 SECOND GROUP BY 1, 2) l ON l.category = d.category AND l.risk_score = d.risk_score""",
    ("reusable",),
)
def _(t):
    wanted = t.audit_log.select("category", "risk_score").distinct().selectExpr(
        "category", "risk_score", "'ORDER' AS recommended_action", "12 AS order_quantity"
    )
    clock = F.lit("2024-01-30 10:00:00").cast("timestamp")
    out = reuse.resolve_insights(wanted, t.audit_log, clock)
    return plain(out.select(
        "category", "risk_score", (~F.col("is_new")).alias("reused"),
        F.when(F.col("is_new"), F.lit("text")).otherwise(F.col("insight")).alias("insight"),
        F.when(F.col("is_new"), as_of()).otherwise(F.col("generated_at")).alias("generated_at"),
    ))


@query(
    "forecast_cache_rows",
    """SELECT p.category, 60 AS n_days, p.current_inventory, p.lead_time_days, p.supplier_pack_size,
              sha256(concat(60, '|', p.current_inventory, '|', p.lead_time_days, '|', p.supplier_pack_size)) AS params_hash,
              d.recommended_action AS action, CAST(d.order_quantity AS BIGINT) AS order_quantity, CAST(f.n AS INTEGER) AS n_points, 'high' AS first_confidence
       FROM params p JOIN decisions d USING (category) JOIN (SELECT category, count(*) AS n FROM forecast GROUP BY 1) f USING (category)""",
    ("params", "decisions", "forecast"),
)
def _(t):
    from stockcast.functions.calendar import confidence
    from stockcast.operators.decide import decide, sanity_warnings

    points = t.forecast.withColumn("confidence_level", confidence(F.col("day_index")))
    plan = t.params.drop("last_upload")
    payload = store.payloads(points, decide(t.forecast, t.params, as_of()), plan, sanity_warnings(t.forecast), 60)
    rows = store.cache_rows(payload, as_of())
    read = F.get_json_object
    return rows.select(
        "category", "n_days", "current_inventory", "lead_time_days", "supplier_pack_size", "params_hash",
        read("payload_json", "$.decision.recommended_action").alias("action"),
        read("payload_json", "$.decision.order_quantity").cast("bigint").alias("order_quantity"),
        F.json_array_length(read("payload_json", "$.forecast")).alias("n_points"),
        read("payload_json", "$.forecast[0].confidence_level").alias("first_confidence"),
    )


@query(
    "decision_log_rows",
    f"""SELECT category, '{AS_OF}' AS timestamp, risk_score, 'forecast_decision' AS type, recommended_action AS action, false AS reusable FROM decisions""",
    ("decisions",),
)
def _(t):
    from stockcast.functions.calendar import confidence
    from stockcast.operators.decide import decide, sanity_warnings

    points = t.forecast.withColumn("confidence_level", confidence(F.col("day_index")))
    payload = store.payloads(points, decide(t.forecast, t.params, as_of()), t.params.drop("last_upload"), sanity_warnings(t.forecast), 60)
    rows = store.decision_log(payload, as_of())
    return plain(rows.select(
        "category", "timestamp", "risk_score", F.get_json_object("insight", "$.type").alias("type"),
        F.get_json_object("insight", "$.decision.recommended_action").alias("action"),
        tx.is_reusable_insight(F.col("insight")).alias("reusable"),
    ))


@query(
    "latest_models",
    "SELECT category, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS trained_at, CAST(arg_max(user_id, ts) AS BIGINT) AS n_samples FROM (SELECT * REPLACE (event_type AS event_type), event_type AS category FROM events) GROUP BY 1",
)
def _(t):
    models = t.table("events").selectExpr("event_type AS category", "CAST(ts AS TIMESTAMP) AS trained_at", "user_id AS n_samples")
    return plain(store.latest_models(models, ["category"]))


# --- through files -------------------------------------------------------------

@query(
    "csv_upload_to_tables",
    "SELECT CAST(date AS VARCHAR) AS date, sku_id, units_sold FROM clean_sales",
    ("clean_sales",),
)
def _(t):
    """Write the dirty rows as CSV, ingest them twice, read the sales table."""
    spark = t.spark
    folder = scratch_path(spark, "upload")
    files = max(4, -(-t.table("lineitem").count() // ROWS_A_FILE))
    raw_sales_in_order(t, files).write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder + "/sales")
    tables = Tables(folder + "/tables")
    items = known(t).selectExpr("sku_id", "'x' AS product_name", "category", "2D AS mrp", "1D AS cost", "1 AS current_inventory")
    store.write_snapshot(spark, tables.skus, items)
    for _ in range(2):  # the same file again must change nothing
        raw = upload.read_upload(spark, folder + "/sales").drop("schema_version")
        ingest(spark, tables, raw, as_of(), "sales.csv", archive=False)
    return plain(tables.read_sales(spark))


@query(
    "sku_snapshots",
    "SELECT * FROM skus WHERE sku_id NOT IN (SELECT sku_id FROM sku_changes) UNION ALL SELECT * FROM sku_changes",
    ("skus", "sku_changes"),
)
def _(t):
    path = scratch_path(t.spark, "skus")
    store.upsert_skus(t.spark, path, t.skus, SKUS)
    store.upsert_skus(t.spark, path, _sku_changes(t), SKUS)
    return store.read_snapshot(t.spark, path, SKUS)


@query(
    "sales_months_upserted",
    """SELECT CAST(date AS VARCHAR) AS date, sku_id, units_sold FROM
       (SELECT * FROM sales WHERE (date, sku_id) NOT IN (SELECT (date, sku_id) FROM sales_changes) UNION ALL SELECT * FROM sales_changes)""",
    ("sales", "sales_changes"),
)
def _(t):
    path = scratch_path(t.spark, "sales")
    store.upsert_sales(t.spark, path, t.sales, SALES)
    store.upsert_sales(t.spark, path, _sales_changes(t), SALES)
    return plain(store.read_or_empty(t.spark, path, SALES).select("date", "sku_id", "units_sold"))


@query(
    "sales_changes_merged",
    """SELECT CAST(date AS VARCHAR) AS date, sku_id, units_sold FROM
       (SELECT * FROM sales WHERE (date, sku_id) NOT IN (SELECT (date, sku_id) FROM sales_changes) UNION ALL SELECT * FROM sales_changes)""",
    ("sales", "sales_changes"),
)
def _(t):
    """Rows, other values for the changed keys, a compaction in between, and the changes."""
    path, keys = scratch_path(t.spark, "changes"), ["date", "sku_id"]
    wrong = _sales_changes(t).withColumn("units_sold", F.lit(-1).cast("bigint"))
    changes.upsert(t.spark, path, t.sales, keys, SALES)
    changes.upsert(t.spark, path, wrong, keys, SALES)
    changes.upsert(t.spark, path, wrong.withColumn("units_sold", F.lit(-2).cast("bigint")), keys, SALES)
    changes.compact(t.spark, path, keys, SALES)
    changes.upsert(t.spark, path, _sales_changes(t), keys, SALES)
    return plain(changes.read(t.spark, path, keys, SALES))


@query(
    "streamed_uploads_daily_totals",
    """SELECT p_type AS category, CAST(date AS VARCHAR) AS date, CAST(sum(q) AS BIGINT) AS units_sold
       FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
       JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def _(t):
    """Files arrive as a stream, each with its own days; then daily totals."""
    from stockcast.streaming import uploads

    spark = t.spark
    folder = scratch_path(spark, "stream")
    rows = t.sales.select("date", F.concat(F.lit("SKU"), "sku_id").alias("sku_id"), "units_sold")
    # a reading task takes a file as a whole, so the files grow in number with the sales
    rows.repartition(max(3, -(-t.table("lineitem").count() // ROWS_A_TASK)), "date").write.option("header", True).csv(folder + "/in")
    tables = Tables(folder + "/tables")
    items = t.table("part").selectExpr(
        "concat('SKU', p_partkey) AS sku_id", "p_name AS product_name", "p_type AS category", "2D AS mrp", "1D AS cost", "1 AS current_inventory"
    )
    store.write_snapshot(spark, tables.skus, items)
    uploads.start(spark, folder + "/in", tables, folder + "/checkpoint").awaitTermination()
    return plain(tables.read_daily(spark))


@query(
    "streamed_mixed_files",
    """WITH s AS (SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
            ok AS (SELECT p_partkey AS k, upper(p_type[1]) || lower(p_type[2:]) AS category FROM part WHERE p_partkey % 7 <> 0)
       SELECT 'daily' AS what, category || '|' || CAST(date AS VARCHAR) AS key, CAST(sum(q) AS BIGINT) AS n FROM s JOIN ok USING (k) WHERE day(date) <> 13 GROUP BY 1, 2
       UNION ALL SELECT 'files', 'sku|accepted|', count(*) FROM part
       UNION ALL SELECT 'files', 'sales|accepted|', count(*) FROM s
       UNION ALL SELECT 'files', 'sku|rejected|Expected schema_version ''1.0''', count(*) FROM supplier
       UNION ALL SELECT 'files', '|rejected|Missing required columns for sales: [''date'', ''units_sold'']; for sku: [''category'', ''cost'', ''current_inventory'', ''mrp'', ''product_name'']', count(*) FROM nation
       UNION ALL SELECT 'rejects', 'cost_not_below_mrp', count(*) FROM part WHERE p_partkey % 7 = 0
       UNION ALL SELECT 'rejects', 'bad_units', count(*) FROM s WHERE day(date) = 13
       UNION ALL SELECT 'rejects', 'unknown_sku', count(*) FROM s WHERE day(date) <> 13 AND k % 7 = 0
       UNION ALL SELECT 'archive', 'sku', count(*) FROM part
       UNION ALL SELECT 'archive', 'sales', count(*) FROM s""",
)
def _(t):
    """Items, sales, files of an old version and files of neither kind arrive in one folder; what came of them."""
    from stockcast.streaming import mixed

    spark = t.spark
    folder = scratch_path(spark, "mixed")

    def put(rows):
        rows.write.mode("append").options(header=True, **upload.DIALECT).csv(folder + "/in")

    units = F.when(F.dayofmonth("date") == 13, F.lit("many")).otherwise(F.col("units_sold").cast("string"))
    cost = F.when(F.col("p_partkey") % 7 == 0, F.lit(3)).otherwise(F.lit(1))
    put(t.sales.select(units.alias("units_sold"), "date", F.concat(F.lit("SKU"), "sku_id").alias("SKU_ID")))
    put(t.table("part").select(
        F.concat(F.lit("sku"), "p_partkey").alias("sku_id"), F.concat("p_name", F.lit(',\n"new"')).alias("product_name"), "p_brand",
        F.col("p_type").alias("Category"), F.lit(2).alias("mrp"), cost.alias("cost"), F.col("p_size").cast("int").alias("current_inventory")))
    put(t.table("supplier").select(
        F.col("s_suppkey").alias("sku_id"), F.col("s_name").alias("product_name"), F.lit("x").alias("category"), F.lit(2).alias("mrp"), F.lit(1).alias("cost"),
        F.lit(1).alias("current_inventory"), F.lit("2.0").alias("schema_version")))
    put(t.table("nation").select(F.col("n_name").alias("sku_id"), "n_nationkey"))
    tables = Tables(folder + "/tables")
    mixed.start(spark, folder + "/in", tables, folder + "/checkpoint").awaitTermination()

    files = spark.read.parquet(tables.files).withColumn("key", F.concat_ws("|", F.coalesce("kind", F.lit("")), "status", F.coalesce("reason", F.lit(""))))
    rejects = spark.read.parquet(tables.rejects).select(F.explode("failed_rules").alias("key"))
    heads = spark.read.parquet(tables.archived_lines).groupBy("path", "kind").agg((F.count("*") - 1).alias("n"))
    parts = [
        ("daily", tables.read_daily(spark).select(F.concat_ws("|", "category", F.col("date").cast("string")).alias("key"), F.col("units_sold").alias("n"))),
        ("files", files.groupBy("key").agg(F.sum("n_rows").alias("n"))),
        ("rejects", rejects.groupBy("key").agg(F.count("*").alias("n"))),
        ("archive", heads.groupBy(F.col("kind").alias("key")).agg(F.sum("n").alias("n"))),
    ]
    out = [df.select(F.lit(name).alias("what"), "key", "n") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
