"""Batch forecasts read through the cache: only what is missing is worked out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockcast.functions.calendar import is_stale
from stockcast.operators import decide as d
from stockcast.operators import model, reuse
from stockcast.plans.batch import models_for
from stockcast.plans.ingest import Tables
from stockcast.schemas import FORECAST_CACHE, PAYLOAD, RECOMMENDATIONS, UPLOAD_EVENTS
from stockcast.session import cut, scratch
from stockcast.sources import store

CATEGORY = ["category"]
ANSWER = ["category", "n_days", "current_inventory", "lead_time_days", "supplier_pack_size"]


@dataclass(frozen=True)
class Served:
    """Answers of one batch and the rows that are to be kept of it."""

    #: one row per answered request: its parameters, ``origin`` (cache, stored model, new model), generated_at, payload_json, data_stale
    answers: DataFrame
    #: forecast points of the requests that the cache did not answer
    points: DataFrame
    cache: DataFrame
    log: DataFrame
    models: DataFrame
    #: known categories without an answer, for want of history
    skipped: DataFrame


def batch_with_cache(
    requests: DataFrame, sales: DataFrame, skus: DataFrame, festivals: DataFrame, cache: DataFrame, events: DataFrame,
    models: DataFrame | None, as_of: Column, n_days: int = 30, max_age: int = reuse.CACHE_SECONDS,
) -> Served:
    """Answer ``requests`` (category and planning parameters, one row per category).

    A cached payload answers when it is young enough, fits the parameters, is no
    older than the category's last upload and holds a decision and points. Of the
    other categories, those whose stored model is no older than their last upload
    are forecast with it; only the rest are fitted, from their own sales alone.
    Requests for categories without items are left out.

    What several results need is cut to the shared folder: the answers found in
    the cache, the new models and the points, so that each series is fitted and
    forecast once.
    """
    uploads = store.last_uploads(events)
    asked = d.with_params(requests.drop("last_upload"), requests.drop("last_upload"), skus)
    asked = asked.withColumns({"n_days": F.lit(n_days), "request_id": F.col("category")})
    found = cut(reuse.baseline_reusable(reuse.cached_forecasts(asked, cache, events, as_of, max_age)))
    missing = found.filter(~F.col("reusable")).select(*asked.columns)
    stored = None if models is None else store.fresh_models(models, uploads, CATEGORY).join(missing.select("category"), "category", "left_semi")
    unfitted = missing if stored is None else missing.join(stored.select("category"), "category", "left_anti")
    fitted = cut(models_for(sales, skus.join(unfitted.select("category"), "category", "left_semi"), festivals))
    usable = fitted.withColumn("origin", F.lit("new model"))
    if stored is not None:
        usable = usable.unionByName(stored.select(*fitted.columns).withColumn("origin", F.lit("stored model")))
    points = cut(model.forecast(usable.drop("origin"), festivals, n_days))
    planned = missing.drop("request_id", "n_days").join(uploads, "category", "left")
    payload = store.payloads(points, d.decide(points, planned, as_of), planned.drop("last_upload"), d.sanity_warnings(points), n_days)
    new_cache = cut(store.cache_rows(payload, as_of))
    origin = usable.select("category", "origin")
    answers = found.filter("reusable").select(*ANSWER, F.lit("cache").alias("origin"), "generated_at", "payload_json").unionByName(
        new_cache.join(origin, "category").select(*ANSWER, "origin", "generated_at", "payload_json")
    )
    stale = is_stale(F.col("last_upload"), as_of).alias("data_stale")
    answers = answers.join(uploads, "category", "left").select(*answers.columns, stale)
    parsed = answers.select(F.from_json("payload_json", PAYLOAD).alias("p")).select("p.*")
    return Served(
        answers=answers, points=points, cache=new_cache, log=store.decision_log(parsed, as_of), models=fitted,
        skipped=missing.select("category").join(new_cache.select("category"), "category", "left_anti"),
    )


def serve(spark: SparkSession, tables: Tables, requests: DataFrame, festivals: DataFrame, as_of: Column, n_days: int = 30) -> DataFrame:
    """The same over tables: new models, cache rows and the log of all answers are appended. Returns the answers."""
    models = store.read_or_none(spark, tables.models)
    with scratch(spark):
        served = batch_with_cache(
            requests, tables.read_sales(spark), tables.read_skus(spark), festivals,
            store.read_or_empty(spark, tables.cache, FORECAST_CACHE), store.read_or_empty(spark, tables.events, UPLOAD_EVENTS), models, as_of, n_days,
        )
        answers = served.answers.collect()  # one row per request of the batch
        store.save_models(served.models, tables.models, as_of)
        store.append(served.log, tables.log)
        # last, so that a failure before it leaves the requests unanswered by the cache
        store.append(served.cache, tables.cache)
        return spark.createDataFrame(answers, served.answers.schema)


def read_log(spark: SparkSession, tables: Tables) -> DataFrame:
    return store.read_or_empty(spark, tables.log, RECOMMENDATIONS)
