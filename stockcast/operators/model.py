"""One Bayesian ridge model per series, and recursive forecasts from it.

Spark reduces each series to its Gram statistics; Python sees one small row per
series, many series per Arrow batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stockcast.functions import ridge
from stockcast.functions.ridge import BAND, LAST_DAYS, fit_batch, recurse_batch
from stockcast.functions.calendar import confidence, festival_scores_ahead, score_table
from stockcast.operators.demand import CATEGORY, FEATURES, check_horizon
from stockcast.operators.keep import global_rank

MIN_ROWS = 7
P = len(FEATURES)
SENSITIVITY = {
    "festival_sensitive": "festival_score",
    "momentum_driven": "lag_1",
    "weekly_seasonal": "lag_7",
    "trend_following": "time_index",
    "volatility_aware": "rolling_std_7",
}


# The kernels travel inside the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(ridge)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- statistics ------------------------------------------------------------

def _scale(variance: Column, mean: Column, n: Column) -> Column:
    """Population deviation; 1 where the feature is constant up to rounding noise."""
    eps = float(np.finfo(float).eps)
    noise = n * eps * variance + F.pow(n * mean * eps, F.lit(2.0))
    return F.when(variance <= noise, F.lit(1.0)).otherwise(F.sqrt(variance))


def fit_scaler(train: DataFrame, keys: Sequence[str] = CATEGORY, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and scale of each feature per series, in long form."""
    out = train.groupBy(*keys).agg(
        *[F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("var"), F.count(c).alias("n")).alias(c) for c in columns]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns])
    long = out.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.feature", "p.s.*")
    return long.select(*keys, "feature", "mean", _scale(F.col("var"), F.col("mean"), F.col("n")).alias("scale"))


def series_statistics(train: DataFrame, keys: Sequence[str] = CATEGORY, carry: Sequence[str] = ()) -> DataFrame:
    """One row per series: scaling, Gram sums of the scaled data, last days.

    Means and deviations are window aggregates over the partitioning the lag
    features already have, so the second pass over the data needs no second
    shuffle. The Gram sums are a plain partial aggregate.
    """
    whole = f"OVER (PARTITION BY {', '.join(keys)})"
    passed = [*dict.fromkeys([*keys, *carry]), "date", "time_index", "units_sold", "potential_stockout"]
    moments = train.selectExpr(
        *passed,
        f"count(*) {whole} AS _n",
        f"avg(units_sold) {whole} AS _y_mean",
        f"max(time_index) {whole} AS _last_index",
        *[f"CAST({c} AS DOUBLE) AS _x{i}" for i, c in enumerate(FEATURES)],
        *[f"avg(CAST({c} AS DOUBLE)) {whole} AS _m{i}" for i, c in enumerate(FEATURES)],
        *[f"var_pop(CAST({c} AS DOUBLE)) {whole} AS _v{i}" for i, c in enumerate(FEATURES)],
    )
    kept = [*passed, "_last_index", "_y_mean", *[f"_m{i}" for i in range(P)]]
    scales = moments.select(
        *kept, *[f"_x{i}" for i in range(P)],
        *[_scale(F.col(f"_v{i}"), F.col(f"_m{i}"), F.col("_n")).alias(f"_s{i}") for i in range(P)],
    )
    scaled = scales.selectExpr(
        *kept, *[f"_s{i}" for i in range(P)],
        "units_sold - _y_mean AS _y",
        *[f"(_x{i} - _m{i}) / _s{i} AS _z{i}" for i in range(P)],
    )
    gram = ", ".join(f"sum(_z{min(i, j)} * _z{max(i, j)})" for i in range(P) for j in range(P))
    firsts = lambda letter: ", ".join(f"first(_{letter}{i})" for i in range(P))
    recent = f"_last_index - time_index < {LAST_DAYS}"
    return scaled.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.first("_y_mean").alias("intercept"),
        F.expr(f"array({firsts('m')})").alias("means"),
        F.expr(f"array({firsts('s')})").alias("scales"),
        F.expr(f"array({gram})").alias("gram"),
        F.expr("array(" + ", ".join(f"sum(_z{i} * _y)" for i in range(P)) + ")").alias("xty"),
        F.expr("sum(_y * _y)").alias("yy"),
        F.expr(
            f"""transform(array_sort(collect_list(IF({recent},
                named_struct('i', time_index, 'units', CAST(units_sold AS DOUBLE)), NULL))), t -> t.units)"""
        ).alias("tail"),
        F.max("date").alias("last_date"),
        F.max("time_index").alias("last_time_index"),
        F.expr("sum(CAST(potential_stockout AS INT))").alias("stockout_days_detected"),
        *[F.first(c).alias(c) for c in carry],
    )


def gram_matrix(train: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """The Gram statistics in long form: (row feature, column feature, value)."""
    return gram_cells(series_statistics(train, keys), keys)


def gram_cells(stats: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    names = F.array(*map(F.lit, FEATURES))
    cells = stats.select(*keys, "n_samples", "yy", F.posexplode("gram").alias("pos", "value"))
    return cells.select(
        *keys, "n_samples", "yy",
        F.element_at(names, (F.floor(F.col("pos") / P) + 1).cast("int")).alias("row_feature"),
        F.element_at(names, (F.col("pos") % P + 1).cast("int")).alias("column_feature"),
        "value",
    )


def eligible(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("n_samples") >= MIN_ROWS)


def skipped_series(series: DataFrame, train: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Series with too little history, and the rows they have."""
    rows = train.groupBy(*keys).agg(F.count("*").alias("training_rows"))
    joined = series.select(*keys).distinct().join(rows, list(keys), "left")
    counted = joined.withColumn("training_rows", F.coalesce("training_rows", F.lit(0)))
    return counted.filter(F.col("training_rows") < MIN_ROWS).withColumn(
        "reason", F.lit("Insufficient historical data to train forecasting model")
    )


# --- Arrow helpers ---------------------------------------------------------

def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)


def _vector(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def _lists(values: np.ndarray) -> pa.ListArray:
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [*batch.columns, *columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *columns])


def _extended(df: DataFrame, **types: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in types.items()]])


# --- fit and forecast ------------------------------------------------------

def fit(stats: DataFrame, keep_statistics: bool = False) -> DataFrame:
    """Adds coef, sigma, alpha, lambda and n_passes to each row of statistics.

    The Gram sums are dropped from the result unless they are to be kept.
    """
    rows = eligible(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fit_batch(
                _vector(batch, "n_samples"),
                _matrix(batch, "gram", P * P).reshape(-1, P, P),
                _matrix(batch, "xty", P),
                _vector(batch, "yy"),
            )
            yield _with(
                batch,
                coef=_lists(out["coef"]), sigma=_lists(out["sigma"]), alpha=pa.array(out["alpha"]),
                lam=pa.array(out["lam"]), n_passes=pa.array(out["passes"]),
            )

    kinds = {
        "coef": T.ArrayType(T.DoubleType()), "sigma": T.ArrayType(T.DoubleType()),
        "alpha": T.DoubleType(), "lam": T.DoubleType(), "n_passes": T.IntegerType(),
    }
    fitted = rows.mapInArrow(run, _extended(rows, **kinds))
    return fitted if keep_statistics else fitted.drop("gram", "xty", "yy")


def train_models(train: DataFrame, keys: Sequence[str] = CATEGORY, carry: Sequence[str] = ()) -> DataFrame:
    return fit(series_statistics(train, keys, carry))


def forecast(
    models: DataFrame, festivals: DataFrame, n_days: int = 30, keys: Sequence[str] = CATEGORY,
    category: str = "category", k: float = 0.2,
) -> DataFrame:
    """Recursive forecast of all series: one row per series and future day.

    A model row carries everything the recursion needs (coefficients, last
    seven days, position in time), so there is no join and no shuffle here.
    """
    check_horizon(n_days)
    scores = festival_scores_ahead(F.col("last_date"), n_days, F.col(category), score_table(festivals, k))
    rows = models.select(
        *dict.fromkeys([*keys, category]), "coef", "sigma", "alpha", "intercept", "means", "scales", "tail",
        "last_time_index", "last_date", F.weekday("last_date").alias("last_weekday"), scores.alias("scores"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mean, low, high = recurse_batch(
                _matrix(batch, "coef", P),
                _matrix(batch, "sigma", P * P).reshape(-1, P, P),
                _vector(batch, "alpha"), _vector(batch, "intercept"),
                _matrix(batch, "means", P), _matrix(batch, "scales", P),
                _matrix(batch, "tail", LAST_DAYS),
                _vector(batch, "last_time_index"),
                (_vector(batch, "last_weekday")[:, None] + np.arange(1, n_days + 1)) % 7, _matrix(batch, "scores", n_days),
            )
            yield _with(batch, mean=_lists(mean), low=_lists(low), high=_lists(high))

    arrays = {name: T.ArrayType(T.DoubleType()) for name in ("mean", "low", "high")}
    done = rows.mapInArrow(run, _extended(rows, **arrays))
    points = F.posexplode(F.arrays_zip("mean", "low", "high", "scores")).alias("pos", "p")
    return done.select(*dict.fromkeys([*keys, category]), "last_date", points).select(
        *dict.fromkeys([*keys, category]),
        (F.col("pos") + 1).alias("day_index"),
        F.date_add("last_date", F.col("pos") + 1).alias("date"),
        F.col("p.mean").alias("predicted_mean"),
        F.col("p.low").alias("lower_95"),
        F.col("p.high").alias("upper_95"),
        F.col("p.scores").alias("festival_score"),
        confidence(F.col("pos") + 1).alias("confidence_level"),
    )


def score(features: DataFrame, models: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Mean and band for given feature rows: column arithmetic, no Python."""
    joined = features.join(models.select(*keys, "coef", "sigma", "alpha", "intercept", "means", "scales"), list(keys))
    z = {
        f"_z{i}": (F.col(c).cast("double") - F.col("means")[i]) / F.col("scales")[i] for i, c in enumerate(FEATURES)
    }
    scaled = joined.withColumns(z)
    centre = F.col("intercept")
    spread = F.lit(1.0) / F.col("alpha")
    for i in range(P):
        centre = centre + F.col(f"_z{i}") * F.col("coef")[i]
        for j in range(P):
            spread = spread + F.col(f"_z{i}") * F.col("sigma")[P * i + j] * F.col(f"_z{j}")
    ready = scaled.withColumns({"_centre": centre, "_band": BAND * F.sqrt(spread)})
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return ready.withColumns(
        {
            "predicted_mean": floor(F.col("_centre")),
            "lower_95": floor(F.col("_centre") - F.col("_band")),
            "upper_95": floor(F.col("_centre") + F.col("_band")),
        }
    ).select(*features.columns, "predicted_mean", "lower_95", "upper_95")


# --- diagnostics -----------------------------------------------------------

def coefficients(models: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Long form: one row per series and feature."""
    named = F.arrays_zip(F.array(*map(F.lit, FEATURES)).alias("feature"), F.col("coef"))
    return models.select(*keys, "n_samples", "intercept", F.explode(named).alias("p")).select(
        *keys, F.col("p.feature").alias("feature"), F.col("p.coef").alias("coefficient"), "intercept", "n_samples"
    )


def analyze(models: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Coefficient map, importance map, intercept and sample count per series."""
    names = F.array(*map(F.lit, FEATURES))
    return models.select(
        *keys,
        F.map_from_arrays(names, F.col("coef")).alias("coefficients"),
        F.map_from_arrays(names, F.transform("coef", lambda c: F.abs(c))).alias("feature_importance"),
        "intercept", "n_samples",
    )


def compare(models: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """One row per series, one column per feature, and the intercept."""
    return models.select(*keys, *[F.col("coef")[i].alias(c) for i, c in enumerate(FEATURES)], "intercept")


def rank_by_feature(long: DataFrame, feature: str, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Series ranked by the size of one coefficient; an unknown feature counts as 0."""
    value = F.coalesce(F.max(F.when(F.col("feature") == feature, F.col("coefficient"))), F.lit(0.0))
    per_series = long.groupBy(*keys).agg(value.alias("coefficient"))
    sized = per_series.withColumn("abs_coefficient", F.abs("coefficient"))
    return global_rank(sized, [F.desc("abs_coefficient"), *[F.asc(c) for c in keys]])


def behaviour(long: DataFrame, key: str = "category") -> DataFrame:
    """Sensitivity classes and a sentence per series from its coefficients."""
    def coef(feature: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("feature") == feature, F.col("coefficient"))), F.lit(0.0))

    position = F.array_position(F.array(*map(F.lit, FEATURES)), F.col("feature"))
    dominant = F.max_by("feature", F.struct(F.abs("coefficient").alias("size"), (-position).alias("first")))
    base = long.groupBy(key).agg(
        dominant.alias("dominant_feature"),
        F.abs(coef("festival_score")).alias("fest"), F.abs(coef("lag_1")).alias("lag1"),
        F.abs(coef("lag_7")).alias("lag7"), coef("rolling_std_7").alias("std"),
    )
    level = F.when(F.col("fest") > 15, "high").when(F.col("fest") > 8, "medium").otherwise("low")
    stability = (
        F.when(F.abs("std") < 0.1, "stable").when(F.col("std") < 0, "volatility-averse").otherwise("volatility-responsive")
    )
    momentum, weekly = F.col("lag1") > 0.1, F.col("lag7") > 0.05
    festival_part = (
        F.when(level == "high", "highly festival-sensitive")
        .when(level == "medium", "moderately festival-sensitive")
        .otherwise("festival-independent")
    )
    pattern_part = (
        F.when(momentum, "with strong momentum effects")
        .when(weekly, "with weekly seasonality")
        .otherwise("with stable demand patterns")
    )
    return base.select(
        key, "dominant_feature",
        level.alias("festival_sensitivity"), momentum.alias("momentum_driven"), weekly.alias("weekly_pattern"),
        stability.alias("stability"),
        F.concat_ws(" ", F.concat(F.col(key), F.lit(" is")), festival_part, pattern_part).alias("summary"),
    )


def most_sensitive(long: DataFrame, key: str = "category") -> DataFrame:
    """The series with the largest coefficient for each of five traits."""
    traits = F.array(*[F.struct(F.lit(t).alias("trait"), F.lit(f).alias("feature")) for t, f in SENSITIVITY.items()])
    wanted = F.filter(traits, lambda t: t["feature"] == F.col("feature"))
    rows = long.select(key, F.abs("coefficient").alias("size"), F.explode(wanted).alias("t"))
    # ties go to the smallest key: compare on the negated order by taking min_by
    best = F.min_by(F.struct(key, "size"), F.struct((-F.col("size")).alias("neg"), F.col(key)))
    return rows.groupBy(F.col("t.trait").alias("trait")).agg(best.alias("b")).select(
        "trait", F.col(f"b.{key}").alias(key), F.col("b.size").alias("coefficient")
    )
