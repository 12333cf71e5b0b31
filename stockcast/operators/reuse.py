"""Looking up earlier results: cached forecasts and logged insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockcast.functions.numbers import py_round
from stockcast.functions.text import is_reusable_insight, params_hash
from stockcast.schemas import PAYLOAD
from stockcast.sources.store import last_uploads, within_age

CACHE_SECONDS = 3600


def acceptable_hashes() -> Column:
    """The request's hash, and the older form without pack size when the pack is 1."""
    n, stock, lead = F.col("n_days"), F.col("current_inventory"), F.col("lead_time_days")
    pack = F.greatest(F.lit(1), F.col("supplier_pack_size"))
    return F.array_compact(F.array(params_hash(n, stock, lead, pack), F.when(pack == 1, params_hash(n, stock, lead))))


def cached_forecasts(requests: DataFrame, cache: DataFrame, events: DataFrame, as_of: Column, max_age: int = CACHE_SECONDS) -> DataFrame:
    """Newest usable cached payload per request, null where there is none.

    ``requests`` has one row per request_id. A payload is usable when its hash
    fits, its text is JSON, it is young enough and not older than the last
    upload of the category. The cache is reduced to the newest entry per
    category and hash before the join, so many requests that share a hash never
    meet more than one entry each.
    """
    young = cache.filter(within_age("generated_at", as_of, max_age)).filter(
        F.get_json_object("payload_json", "$").isNotNull()
    )
    wanted = requests.select("request_id", "category", F.explode(acceptable_hashes()).alias("params_hash"))
    entry = F.struct("generated_at", "payload_json")
    newest_per_hash = young.groupBy("category", "params_hash").agg(F.max(entry).alias("hit"))
    newest = wanted.join(newest_per_hash, ["category", "params_hash"]).groupBy("request_id").agg(F.max("hit").alias("hit"))
    joined = requests.join(newest, "request_id", "left").join(last_uploads(events), "category", "left")
    fresh = F.col("last_upload").isNull() | (F.col("hit.generated_at") >= F.col("last_upload"))
    usable = F.col("hit").isNotNull() & fresh
    return joined.select(
        *requests.columns,
        F.when(usable, F.col("hit.generated_at")).alias("generated_at"),
        F.when(usable, F.col("hit.payload_json")).alias("payload_json"),
        usable.alias("cache_hit"),
    )


def payload_points(hits: DataFrame) -> DataFrame:
    """Forecast rows of cached payloads; unusable points are left out.

    Points of older payloads without a confidence level get one by position.
    """
    from stockcast.functions.calendar import confidence

    parsed = hits.filter("cache_hit").select("request_id", F.from_json("payload_json", PAYLOAD).alias("p"))
    points = parsed.select("request_id", F.posexplode("p.forecast").alias("pos", "f"))
    day = F.col("pos") + 1
    return points.select(
        "request_id", day.alias("day_index"), F.try_to_date("f.date").alias("date"), "f.predicted_mean", "f.lower_95",
        "f.upper_95", F.coalesce("f.festival_score", F.lit(0.0)).alias("festival_score"),
        F.coalesce("f.confidence_level", confidence(day)).alias("confidence_level"),
    ).na.drop(subset=["date", "predicted_mean", "lower_95", "upper_95"])


def baseline_reusable(hits: DataFrame) -> DataFrame:
    """Requests whose cached payload has a decision and at least one valid point."""
    with_points = payload_points(hits).select("request_id").distinct().withColumn("has_points", F.lit(True))
    decision = F.get_json_object("payload_json", "$.decision.recommended_action").isNotNull()
    return hits.join(with_points, "request_id", "left").withColumn(
        "reusable", F.col("cache_hit") & decision & F.coalesce("has_points", F.lit(False))
    ).drop("has_points")


def cached_recommendations(requests: DataFrame, log: DataFrame, as_of: Column, max_age: int = CACHE_SECONDS) -> DataFrame:
    """Newest log entry per (category, rounded risk) request within its age limit."""
    young = log.filter(within_age("timestamp", as_of, max_age)).select(
        "category", py_round(F.col("risk_score"), 3).alias("risk_score"), "timestamp", "insight"
    )
    newest = young.groupBy("category", "risk_score").agg(F.max(F.struct("timestamp", "insight")).alias("hit"))
    wanted = requests.withColumn("risk_score", py_round(F.coalesce(F.col("risk_score").try_cast("double"), F.lit(0.0)), 3))
    return wanted.join(newest, ["category", "risk_score"], "left").select(
        *requests.columns, F.col("hit.timestamp").alias("logged_at"), F.col("hit.insight").alias("cached_insight")
    )


def resolve_insights(requests: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """Reusable logged text, else the rule-based text; ``is_new`` rows are to be logged."""
    from stockcast.operators.reports import insight_text

    found = insight_text(cached_recommendations(requests, log, as_of))
    reuse = is_reusable_insight(F.col("cached_insight"))
    return found.select(
        "category", "risk_score",
        F.when(reuse, F.col("cached_insight")).otherwise(F.col("insight")).alias("insight"),
        F.when(reuse, F.col("logged_at")).otherwise(as_of).alias("generated_at"),
        (~reuse).alias("is_new"),
    )
