"""Models kept up to date from stored sums: new days are added, old ones are not read again.

A series is stored as the count, means and centred products of its features and
target, with its last days. Two such rows merge into the row of both sets of days,
so an upload of later days costs the days themselves and the seven before them,
however long the history is. Products are centred at their own means and shifted
when merged, which loses no digits where raw sums of squares would.

Scaling is applied at the fit: the scaled sums that a full pass would have summed
follow from the stored ones.

A series is read whole instead where its stored row cannot be extended: a changed
day on or before its last one (positions and lags after it move), fewer rows than
a window, or another festival table. So taking a batch again gives the same rows.

Defined cases: a series whose days are all gone keeps no row; one that is to be
refreshed without a changed day keeps its row; series with a null key are not kept;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockcast.operators import demand
from stockcast.operators.demand import CATEGORY, FEATURES, WINDOW_DAYS
from stockcast.operators.model import P, _scale
from stockcast.functions.ridge import LAST_DAYS

COLUMNS = (*FEATURES, "units_sold")
N = len(COLUMNS)
TARGET = N - 1
STORED = (
    "n_samples bigint, mean array<double>, products array<double>, recent array<struct<time_index: int, date: date, units: double>>, "
    "stockout_days_detected bigint, calendar bigint"
)
#: a change of all days of a series, so that it is read whole
FROM_THE_START = "0001-01-01"


def schema(daily: DataFrame, keys: Sequence[str] = CATEGORY) -> str:
    """Columns of the stored table for series of a table of daily totals."""
    kinds = dict(daily.dtypes)
    return ", ".join([*[f"{k} {kinds[k]}" for k in keys], STORED])


def calendar_mark(festivals: DataFrame) -> int:
    """One number for the days and uplifts the stored scores were worked out from."""
    row = festivals.select(F.xxhash64(*sorted(festivals.columns)).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    return row.agg(F.bit_xor(F.xxhash64("h", "c"))).first()[0] or 0


def of_rows(train: DataFrame, calendar: int, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """One stored row per series of training rows: means over the partitioning the lags already have, then plain sums of centred products."""
    whole = Window.partitionBy(*keys)
    x = [f"_x{i}" for i in range(N)]
    rows = train.select(
        *keys, "time_index", "date", "potential_stockout", F.max("time_index").over(whole).alias("_last"),
        *[F.col(c).cast("double").alias(name) for c, name in zip(COLUMNS, x)], *[F.avg(F.col(c).cast("double")).over(whole).alias(f"_m{i}") for i, c in enumerate(COLUMNS)],
    )
    centred = rows.withColumns({f"_c{i}": F.col(x[i]) - F.col(f"_m{i}") for i in range(N)})
    latest = F.struct(F.col("time_index").cast("int").alias("time_index"), "date", F.col(x[TARGET]).alias("units"))
    summed = centred.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(N)],
        *[F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")).alias(f"_p{i}_{j}") for i in range(N) for j in range(i, N)],
        F.array_sort(F.collect_list(F.when(F.col("_last") - F.col("time_index") < LAST_DAYS, latest))).alias("recent"),
        F.sum(F.col("potential_stockout").cast("bigint")).alias("stockout_days_detected"),
    )
    return summed.select(
        *keys, "n_samples", F.array(*[f"_m{i}" for i in range(N)]).alias("mean"),
        F.array(*[f"_p{min(i, j)}_{max(i, j)}" for i in range(N) for j in range(N)]).alias("products"),
        "recent", "stockout_days_detected", F.lit(calendar).cast("bigint").alias("calendar"),
    )


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Stored rows of both: ``new`` holds later days of series in ``old``, or series of its own."""
    both = old.alias("a").join(new.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    n1, n2 = F.col("a.n_samples"), F.col("b.n_samples")
    gap = F.zip_with("a.mean", "b.mean", lambda u, v: v - u)
    apart = both.withColumns({"_gap": gap, "_share": n2 / (n1 + n2), "_weight": n1 * n2 / (n1 + n2)})

    def chosen(together: Column, name: str) -> Column:
        return F.when(n1.isNull(), F.col(f"b.{name}")).when(n2.isNull(), F.col(f"a.{name}")).otherwise(together).alias(name)

    mean = F.zip_with("a.mean", "_gap", lambda u, d: u + d * F.col("_share"))
    outer = F.flatten(F.transform("_gap", lambda d: F.transform("_gap", lambda e: d * e * F.col("_weight"))))
    summed = F.zip_with("a.products", "b.products", lambda u, v: u + v)
    recent = F.concat("a.recent", "b.recent")
    return apart.select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        chosen(n1 + n2, "n_samples"), chosen(mean, "mean"), chosen(F.zip_with(summed, outer, lambda u, v: u + v), "products"),
        chosen(F.slice(recent, F.greatest(F.size(recent) - LAST_DAYS + 1, F.lit(1)), F.lit(LAST_DAYS)), "recent"),
        chosen(F.col("a.stockout_days_detected") + F.col("b.stockout_days_detected"), "stockout_days_detected"),
        F.coalesce("b.calendar", "a.calendar").alias("calendar"),
    )


def later_rows(daily: DataFrame, stored: DataFrame, festivals: DataFrame, keys: Sequence[str] = CATEGORY, category: str = "category", k: float = 0.2) -> DataFrame:
    """Training rows of the days after each stored row's last one; the seven days before them are all the history read."""
    first = F.col("recent")[0]
    starts = stored.select(*keys, first["date"].alias("_from"), first["time_index"].alias("_before"))
    rows = daily.join(starts, list(keys)).filter("date >= _from").drop("_from")
    # the stored days come first and lack lags, so only later ones are left
    return demand.training_frame(rows, festivals, keys, category, k=k).withColumn("time_index", F.col("time_index") + F.col("_before"))


def updated(
    stored: DataFrame, daily: DataFrame, changed: DataFrame, festivals: DataFrame, keys: Sequence[str] = CATEGORY,
    category: str = "category", k: float = 0.2, recent: DataFrame | None = None,
) -> DataFrame:
    """New stored rows of the series in ``changed`` (keys, first_change), which is null where no day changed.

    ``recent`` may be the part of ``daily`` from the earliest stored last days on,
    where the caller can leave the files before them out.
    """
    calendar = calendar_mark(festivals)
    state = changed.join(stored, list(keys), "left")
    last = F.element_at("recent", -1)["date"]
    usable = F.coalesce((F.col("n_samples") >= WINDOW_DAYS) & (F.col("calendar") == calendar), F.lit(False))
    later = F.col("first_change").isNull() | (F.col("first_change") > last)
    extended = state.filter(usable & later).drop("first_change")
    whole = state.filter(~(usable & later)).select(*keys)
    added = of_rows(later_rows(daily if recent is None else recent, extended, festivals, keys, category, k), calendar, keys)
    full = demand.training_frame(daily.join(whole, list(keys), "left_semi"), festivals, keys, category, k=k)
    return merged(extended, added, keys).unionByName(of_rows(full, calendar, keys))


def statistics(stored: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """What ``model.fit`` takes, as ``model.series_statistics`` sums it from all days."""
    n = F.col("n_samples")

    def product(i: int, j: int) -> Column:
        return F.col("products")[i * N + j]

    scales = F.array(*[_scale(product(i, i) / n, F.col("mean")[i], n) for i in range(P)])
    rows = stored.withColumn("scales", scales)
    gram = [product(i, j) / F.col("scales")[i] / F.col("scales")[j] for i in range(P) for j in range(P)]
    last = F.element_at("recent", -1)
    return rows.select(
        *keys, "n_samples", F.col("mean")[TARGET].alias("intercept"), F.slice("mean", 1, P).alias("means"), "scales",
        F.array(*gram).alias("gram"), F.array(*[product(i, TARGET) / F.col("scales")[i] for i in range(P)]).alias("xty"),
        product(TARGET, TARGET).alias("yy"), F.transform("recent", lambda day: day["units"]).alias("tail"),
        last["date"].alias("last_date"), last["time_index"].alias("last_time_index"), "stockout_days_detected",
    )
