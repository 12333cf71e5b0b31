"""Answers from the forecast cache, and batches that only work out what it lacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockcast.operators import reuse
from stockcast.plans.batch import models_for
from stockcast.plans.cached import batch_with_cache
from stockcast.sources import store
from suite.base import AS_OF, as_of, query, register_cte
from suite.plain import plain
from suite.store_checks import TTL, _cache, _requests

POINTS = '[{"date":"2024-02-01","predicted_mean":1.5,"lower_95":1.0,"upper_95":2.0},{"date":"never","predicted_mean":1.5,"lower_95":1.0,"upper_95":2.0}]'
KINDS = (
    "WHEN e % 7 = 0 THEN '{broken' WHEN e % 7 = 1 THEN concat('{\"event\":', e, ',\"decision\":{},\"forecast\":" + POINTS + "}')"
    " WHEN e % 7 = 2 THEN concat('{\"event\":', e, ',\"decision\":{\"recommended_action\":\"ORDER\"},\"forecast\":[]}')"
    " WHEN e % 7 = 3 THEN concat('{\"event\":', e, ',\"decision\":{\"recommended_action\":\"ORDER\"},\"forecast\":[{\"date\":\"2024-02-01\"}]}')"
    " ELSE concat('{\"event\":', e, ',\"decision\":{\"recommended_action\":\"ORDER\"},\"forecast\":" + POINTS + "}')"
)

register_cte(
    "baselines",
    f"""SELECT category, CASE WHEN event_id % 2 = 0 THEN generated_at + INTERVAL 2 DAY ELSE generated_at END AS generated_at, params_hash,
               CASE {KINDS.replace('e %', 'event_id %').replace(' e,', ' event_id,')} END AS payload_json, event_id FROM cache""",
    "cache",
)


@query(
    "baseline_reuse",
    f"""SELECT r.request_id, coalesce(fresh, false) AS cache_hit,
               coalesce(fresh, false) AND coalesce(json_extract_string(h.p, '$.decision.recommended_action') IS NOT NULL
                   AND json_extract_string(h.p, '$.forecast[0].predicted_mean') IS NOT NULL, false) AS reusable
        FROM requests r LEFT JOIN (
            SELECT request_id, arg_max(payload_json, (generated_at, payload_json)) AS p, any_value(u) IS NULL OR max(generated_at) >= any_value(u) AS fresh
            FROM requests r JOIN baselines c ON c.category = r.category AND c.generated_at >= TIMESTAMP '{AS_OF}' - INTERVAL {TTL} SECOND AND json_valid(c.payload_json)
                 AND (c.params_hash = sha256(concat(n_days, '|', current_inventory, '|', lead_time_days, '|', greatest(1, supplier_pack_size)))
                      OR (greatest(1, supplier_pack_size) = 1 AND c.params_hash = sha256(concat(n_days, '|', current_inventory, '|', lead_time_days))))
            LEFT JOIN (SELECT category, max(uploaded_at) AS u FROM upload_events GROUP BY 1) l ON l.category = r.category
            GROUP BY 1) h USING (request_id)""",
    ("requests", "baselines", "upload_events"),
)
def _(t):
    """Which requests can use the cached forecast as their baseline: all uploads count."""
    later = F.expr("CASE WHEN event_id % 2 = 0 THEN generated_at + INTERVAL 2 DAYS ELSE generated_at END")
    kinds = F.expr(f"CASE {KINDS.replace('e %', 'event_id %').replace(' e,', ' event_id,')} END")
    cache = _cache(t).withColumns({"generated_at": later, "payload_json": kinds}).drop("event_id")
    hits = reuse.cached_forecasts(_requests(t), cache, t.upload_events, as_of(), TTL)
    return reuse.baseline_reusable(hits).select("request_id", "cache_hit", "reusable")


#: what the cache holds for a category, by its place among all categories
STATES = "CASE category WHEN 'Snacks' THEN 'fresh' WHEN 'Staples' THEN 'older than upload' WHEN 'Edible Oil' THEN 'broken' WHEN 'Promo' THEN 'other parameters' WHEN 'Large' THEN 'no points' ELSE 'nothing' END"


@query(
    "batch_with_cache",
    f"""SELECT k.category, CASE WHEN {STATES} = 'fresh' THEN 'cache' WHEN category = 'Promo' THEN 'stored model' ELSE 'new model' END AS origin,
               strftime(CASE WHEN {STATES} = 'fresh' THEN u ELSE TIMESTAMP '{AS_OF}' END, '%Y-%m-%d %H:%M:%S') AS generated_at,
               CAST(CASE WHEN {STATES} = 'fresh' THEN 2 ELSE 30 END AS INTEGER) AS n_points,
               CAST(CASE WHEN {STATES} = 'fresh' THEN 0 ELSE 30 END AS BIGINT) AS forecast_rows, {STATES} <> 'fresh' AND category <> 'Promo' AS fitted,
               sha256(concat(30, '|', current_inventory, '|7|1')) AS params_hash, coalesce(u < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false) AS data_stale,
               CAST(1 AS BIGINT) AS logged
        FROM (SELECT category, CAST(sum(current_inventory) AS INTEGER) AS current_inventory FROM skus GROUP BY 1) k
        LEFT JOIN (SELECT category AS c, max(uploaded_at) AS u FROM upload_events GROUP BY 1) l ON c = k.category""",
    ("skus", "upload_events"),
)
def _(t):
    """One batch over all categories: a hit, four kinds of misses, a category the cache knows nothing of; one model is reused."""
    asked = t.skus.groupBy("category").agg(F.sum("current_inventory").cast("int").alias("current_inventory")).withColumns(
        {"lead_time_days": F.lit(7), "supplier_pack_size": F.lit(1)})
    uploads = store.last_uploads(t.upload_events)
    kept = asked.join(uploads, "category").withColumn("state", F.expr(STATES))
    stock = F.when(F.col("state") == "other parameters", F.col("current_inventory") + 1).otherwise(F.col("current_inventory"))
    decided = f'"decision":{{"recommended_action":"ORDER","risk_score":0.5}},"n_days":30,"warnings":[]'
    payload = F.expr(
        f"""CASE state WHEN 'broken' THEN '{{' WHEN 'no points' THEN concat('{{"category":"', category, '",{decided},"forecast":[]}}')
            ELSE concat('{{"category":"', category, '",{decided},"forecast":{POINTS}}}') END""")
    cache = kept.select(
        "category", F.expr("CASE WHEN state = 'older than upload' THEN last_upload - INTERVAL 1 SECOND ELSE last_upload END").alias("generated_at"),
        F.sha2(F.concat_ws("|", F.lit(30), stock, F.lit(7), F.lit(1)), 256).alias("params_hash"), payload.alias("payload_json"))
    stored = models_for(t.sales, t.skus.filter("category IN ('Promo', 'Large')"), t.festivals).join(uploads, "category")
    trained = F.expr("CASE WHEN category = 'Promo' THEN last_upload + INTERVAL 1 MINUTE ELSE last_upload - INTERVAL 1 MINUTE END")
    models = stored.withColumn("trained_at", trained).drop("last_upload")
    served = batch_with_cache(asked, t.sales, t.skus, t.festivals, cache, t.upload_events, models, as_of(), 30, max_age=86_400 * 90)
    rows = served.points.groupBy("category").agg(F.count("*").alias("forecast_rows"))
    fitted = served.models.select("category", F.lit(True).alias("fitted"))
    logged = served.log.groupBy("category").agg(F.count("*").alias("logged"))
    joined = served.answers.join(rows, "category", "left").join(fitted, "category", "left").join(logged, "category", "left")
    numbers = [F.col(c).cast("string") for c in ("n_days", "current_inventory", "lead_time_days", "supplier_pack_size")]
    return plain(joined.select(
        "category", "origin", "generated_at", F.json_array_length(F.get_json_object("payload_json", "$.forecast")).alias("n_points"),
        F.coalesce("forecast_rows", F.lit(0)).cast("bigint").alias("forecast_rows"), F.coalesce("fitted", F.lit(False)).alias("fitted"),
        F.sha2(F.concat_ws("|", *numbers), 256).alias("params_hash"), "data_stale", "logged"))
