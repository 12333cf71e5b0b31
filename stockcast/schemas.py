"""Table schemas, declared once as DDL text (readable by every Spark reader)."""

SKUS = (
    "sku_id string, product_name string, category string, mrp double, cost double, current_inventory int"
)
SALES = "date date, sku_id string, units_sold bigint"
DAILY = "category string, date date, units_sold bigint"
FESTIVALS = "festival_name string, date date, category string, historical_uplift double"
UPLOAD_EVENTS = "category string, uploaded_at timestamp"
RECOMMENDATIONS = "category string, timestamp timestamp, risk_score double, insight string"
FORECAST_CACHE = (
    "category string, generated_at timestamp, params_hash string, n_days int, current_inventory int, "
    "lead_time_days int, supplier_pack_size int, payload_json string"
)
PARAMS = (
    "category string, current_inventory int, lead_time_days int, supplier_pack_size int, last_upload timestamp"
)
PAYLOAD = (
    "category string, "
    "forecast array<struct<date: string, predicted_mean: double, lower_95: double, upper_95: double, "
    "festival_score: double, confidence_level: string>>, "
    "decision struct<recommended_action: string, order_quantity: bigint, reorder_point: double, "
    "safety_stock: double, risk_score: double, festival_buffer_applied: boolean, "
    "data_stale_warning: boolean, pack_size_applied: boolean>, "
    "warnings array<string>, n_days int, current_inventory int, lead_time_days int, supplier_pack_size int"
)

SKU_COLUMNS = ("sku_id", "product_name", "category", "mrp", "cost", "current_inventory")
SALES_COLUMNS = ("date", "sku_id", "units_sold")
SCHEMA_VERSION = "1.0"
