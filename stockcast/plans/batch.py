"""Whole paths: batch forecasts with decisions, diagnostics, upload to tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from stockcast.operators import decide as d
from stockcast.operators import demand, model
from stockcast.operators.reports import insight_text
from stockcast.session import cut


@dataclass(frozen=True)
class BatchResult:
    """Results of one batch; each is a DataFrame over all series."""

    models: DataFrame
    forecast: DataFrame
    decisions: DataFrame
    warnings: DataFrame
    skipped: DataFrame


def models_for(
    sales: DataFrame, skus: DataFrame, festivals: DataFrame, keys: Sequence[str] = ("category",), tasks: int | None = None
) -> DataFrame:
    """Trained models of all series. The category rides along with finer keys; ``tasks`` as in ``daily_demand``."""
    carry = [] if "category" in keys else ["category"]
    daily = demand.daily_demand(sales, skus, [*keys, *carry], tasks)
    return model.train_models(demand.training_frame(daily, festivals, keys), keys, carry)


def batch_forecast(
    sales: DataFrame, skus: DataFrame, festivals: DataFrame, params: DataFrame, as_of: Column,
    n_days: int = 30, keys: Sequence[str] = ("category",), reuse: bool = True,
) -> BatchResult:
    """Forecast, decision and warnings of all series in one pass.

    Points and decisions of thousands of series come from the same forecast, so
    with ``reuse`` it is cut to the shared folder once. Series unknown to the
    item table or without enough history are in ``skipped`` only.
    """
    models = models_for(sales, skus, festivals, keys)
    points = model.forecast(models, festivals, n_days, keys)
    points = cut(points) if reuse else points
    planned = d.with_params(points, params, skus, keys)
    carry = [] if "category" in keys else ["category"]
    train = demand.add_lag_features(
        demand.add_time_index(demand.daily_demand(sales, skus, [*keys, *carry]), keys), keys
    )
    return BatchResult(
        models=models,
        forecast=points,
        decisions=d.decide(points, planned, as_of, keys),
        warnings=d.sanity_warnings(points, keys),
        skipped=model.skipped_series(skus, train, keys),
    )


def forecast_decisions(
    sales: DataFrame, skus: DataFrame, festivals: DataFrame, params: DataFrame, as_of: Column,
    n_days: int = 30, keys: Sequence[str] = ("category",),
) -> DataFrame:
    """The decision table alone, as one lazy plan."""
    points = model.forecast(models_for(sales, skus, festivals, keys), festivals, n_days, keys)
    return d.decide(points, d.with_params(skus, params, None, keys), as_of, keys)


def insights(decisions: DataFrame) -> DataFrame:
    return insight_text(decisions).select("category", "risk_score", "insight")
