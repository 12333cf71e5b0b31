"""Upload cleaning: rules per row, duplicates, unknown items, metrics, outliers.

Order of the steps, as the metrics depend on it: exact duplicates on the raw
rows, normalising, rules, logical duplicates, unknown items, outliers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockcast.functions.text import norm_category, norm_sku, norm_text, to_day, to_number
from stockcast.schemas import SALES_COLUMNS, SKU_COLUMNS
from stockcast.session import cut
from stockcast.sources.upload import DAY_FIRST, ROW_ORDER, UploadError

OUTLIER_SPREAD = 3.0
OUTLIER_MIN_ROWS = 4
CELLS = 4096
DEALT = 8
TAKEN = "good > 0 AND known"


def drop_exact_duplicates(raw: DataFrame, order: str = ROW_ORDER) -> DataFrame:
    """One row per distinct raw row, the last copy of each kept.

    Which copy survives matters: of ``4, 9, 4`` for one key the last ``4`` is
    kept and wins later. ``copies`` says how many rows each one stands for.
    """
    data = [c for c in raw.columns if c != order]
    return raw.groupBy(*data).agg(F.max(order).alias(order), F.count("*").alias("copies"))


def _failed_names(rules: dict[str, Column]) -> Column:
    """Names of the failed rules of a row, an empty array for a valid row."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def _passes(rules: dict[str, Column]) -> Column:
    """The same as one flag, for rows whose reasons nobody asks for."""
    return ~reduce(or_, [F.coalesce(cond, F.lit(False)) for cond in rules.values()])


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def _not_whole(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) % 1 != 0)


def _sku_types() -> dict[str, Column]:
    return {
        "sku_id": norm_sku(F.col("sku_id")),
        "product_name": norm_text(F.col("product_name")),
        "category": norm_category(F.col("category")),
        "mrp": to_number(F.col("mrp")),
        "cost": to_number(F.col("cost")),
        "current_inventory": to_number(F.col("current_inventory")),
    }


def _sales_types(columns: Sequence[str]) -> dict[str, Column]:
    """Dates are read in the order of their file where the rows carry it."""
    order = F.coalesce(F.col(DAY_FIRST), F.lit(False)) if DAY_FIRST in columns else None
    return {
        "sku_id": norm_sku(F.col("sku_id")),
        "date": to_day(F.col("date"), order=order),
        "units_sold": to_number(F.col("units_sold")),
    }


def type_skus(raw: DataFrame) -> DataFrame:
    return raw.withColumns(_sku_types())


def type_sales(raw: DataFrame) -> DataFrame:
    return raw.withColumns(_sales_types(raw.columns))


def _typed_once(raw: DataFrame, kind: str, *others: str) -> DataFrame:
    """Typed columns and some others, each worked out once a row.

    Rules, keys and values read the same cleaned columns. A projection would be
    merged into all of them and clean the row again for each; an array of one
    struct, taken apart again, is not.
    """
    types = _sku_types() if kind == "sku" else _sales_types(raw.columns)
    cleaned = F.struct(*[value.alias(name) for name, value in types.items()], *[F.col(c) for c in others])
    return raw.select(F.inline(F.array(cleaned)))


def sku_rules() -> dict[str, Column]:
    """Rules on typed item rows; true means the row breaks the rule."""
    return {
        "blank_sku": _blank("sku_id"),
        "blank_name": _blank("product_name"),
        "blank_category": _blank("category"),
        "bad_mrp": F.col("mrp").isNull(),
        "bad_cost": F.col("cost").isNull(),
        "bad_inventory": F.col("current_inventory").isNull(),
        "fractional_inventory": _not_whole("current_inventory"),
        "negative_inventory": F.col("current_inventory") < 0,
        "cost_not_below_mrp": F.col("cost") >= F.col("mrp"),
    }


def sales_rules() -> dict[str, Column]:
    """Rules on typed sales rows. Dates in the future are allowed."""
    return {
        "blank_sku": _blank("sku_id"),
        "bad_date": F.col("date").isNull(),
        "bad_units": F.col("units_sold").isNull(),
        "fractional_units": _not_whole("units_sold"),
        "negative_units": F.col("units_sold") < 0,
    }


def check_skus(typed: DataFrame) -> DataFrame:
    return typed.withColumn("failed_rules", _failed_names(sku_rules()))


def check_sales(typed: DataFrame) -> DataFrame:
    return typed.withColumn("failed_rules", _failed_names(sales_rules()))


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("failed_rules") == 0)


def rejected(rows: DataFrame) -> DataFrame:
    """The quarantine table: rows with the rules they broke."""
    return rows.filter(F.size("failed_rules") > 0)


def known_items(sales: DataFrame, skus: DataFrame) -> DataFrame:
    return sales.join(skus.select("sku_id"), "sku_id", "left_semi")


def unknown_items(sales: DataFrame, skus: DataFrame) -> DataFrame:
    return sales.join(skus.select("sku_id"), "sku_id", "left_anti")


def checked(raw: DataFrame, kind: str) -> DataFrame:
    """Distinct raw rows, typed, with the rules each one breaks."""
    distinct = drop_exact_duplicates(raw)
    return check_skus(type_skus(distinct)) if kind == "sku" else check_sales(type_sales(distinct))


def with_failures(raw: DataFrame, kind: str, *others: str) -> DataFrame:
    """Typed columns of all rows, the rules each one breaks and some others, such as the file they are from."""
    return (check_skus if kind == "sku" else check_sales)(_typed_once(raw, kind, *others))


def quarantine(raw: DataFrame, kind: str, *others: str) -> DataFrame:
    """Those of them that break rules."""
    return rejected(with_failures(raw, kind, *others))


def valid_unknown(raw: DataFrame, skus: DataFrame, *others: str) -> DataFrame:
    """Sales rows that break no rule, but whose item is not known."""
    return unknown_items(_typed_once(raw, "sales", *others).filter(_passes(sales_rules())), skus)


def _last_valid(raw: DataFrame, kind: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last valid row per key, from one aggregation over the raw rows.

    The last row of a key is the same whether exact duplicates are dropped
    first (last copy kept) or not, so they need no step of their own here.
    """
    return _last(_typed_once(raw, kind, ROW_ORDER).filter(_passes(sku_rules() if kind == "sku" else sales_rules())), keys, columns)


def _last(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    rest = [c for c in columns if c not in keys]
    if len(rest) == 1:  # one number by a number: a hash aggregate
        return rows.groupBy(*keys).agg(F.max_by(rest[0], ROW_ORDER).alias(rest[0]))
    best = rows.groupBy(*keys).agg(F.max(F.struct(ROW_ORDER, *rest)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def clean_skus(raw: DataFrame) -> DataFrame:
    """Valid item rows, one per sku_id, the last row of the upload winning."""
    last = _last_valid(raw, "sku", ["sku_id"], SKU_COLUMNS)
    return last.withColumn("current_inventory", F.col("current_inventory").cast("int")).select(*SKU_COLUMNS)


def clean_sales(raw: DataFrame, skus: DataFrame) -> DataFrame:
    """Valid sales rows of known items, one per (date, sku_id)."""
    return last_sales(_typed_once(raw, "sales", ROW_ORDER).filter(_passes(sales_rules())), skus)


def last_sales(rows: DataFrame, skus: DataFrame) -> DataFrame:
    """The same from typed rows that break no rule."""
    last = _last(rows, ["date", "sku_id"], SALES_COLUMNS)
    typed = last.withColumn("units_sold", F.col("units_sold").cast("bigint"))
    return known_items(typed, skus).select(*SALES_COLUMNS)


def require_valid(cleaned: DataFrame, message: str) -> DataFrame:
    if cleaned.isEmpty():
        raise UploadError(message)
    return cleaned


def ingestion_metrics(raw: DataFrame, kind: str, skus: DataFrame | None = None) -> DataFrame:
    """rows_received, rows_cleaned, duplicates_removed, invalid_rows_dropped, outliers_detected.

    The raw rows are read once: they are counted per distinct row, then per key
    with the value of its last valid row, then per value. That last table, of
    distinct values, is cut to the shared folder, and all metrics come from it.
    """
    counted = rows_per_key(raw, kind)
    return metrics_of(counted.withColumn("known", F.lit(True)) if skus is None or kind == "sku" else with_items(counted, skus), kind)


def rows_per_key(raw: DataFrame, kind: str) -> DataFrame:
    """Per key the rows received, the distinct ones, those of them that break no rule, and the value of the last of these."""
    keys = ["sku_id"] if kind == "sku" else ["date", "sku_id"]
    data = [c for c in raw.columns if c != ROW_ORDER]
    copies = raw.groupBy(*data).agg(F.max(ROW_ORDER).alias(ROW_ORDER), F.count("*").alias("copies"))
    ok = _passes(sku_rules() if kind == "sku" else sales_rules())
    value = F.col("units_sold") if kind == "sales" else F.lit(None).cast("double")
    rows = _typed_once(copies, kind, ROW_ORDER, "copies").select(*keys, ROW_ORDER, "copies", ok.alias("ok"), value.alias("value"))
    return rows.groupBy(*keys).agg(
        F.sum("copies").alias("received"), F.count("*").alias("rows"), F.count_if("ok").alias("good"),
        F.max_by("value", F.when(F.col("ok"), F.col(ROW_ORDER))).alias("value"),
    )


def with_items(per_key: DataFrame, skus: DataFrame) -> DataFrame:
    """Counted sales keys, whether their item is known, and its category."""
    marks = skus.select("sku_id", "category", F.lit(True).alias("known")) if "category" in skus.columns else skus.select("sku_id", F.lit(True).alias("known"))
    # the items of a partition are few beside its keys: hashed, neither side is sorted
    return per_key.join(marks.hint("shuffle_hash"), "sku_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def sales_of(per_key: DataFrame) -> DataFrame:
    """The rows of ``clean_sales`` with the category of their item, from counted keys with their items."""
    return per_key.filter(TAKEN).select("date", "sku_id", F.col("value").cast("bigint").alias("units_sold"), "category")


def metrics_of(per_key: DataFrame, kind: str) -> DataFrame:
    """``ingestion_metrics`` from counted keys."""
    taken = F.expr(TAKEN)
    per_value = cut(per_key.groupBy(F.when(taken, F.col("value")).alias("v")).agg(
        F.sum("received").alias("received"), F.sum("rows").alias("rows"), F.sum("good").alias("good"),
        F.count_if(taken).alias("n"), F.count_if(F.col("good") > 0).alias("keys"),
    ))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    summed = per_value.agg(
        total(F.col("received")).alias("rows_received"),
        total(F.col("n")).alias("rows_cleaned"),
        total(F.col("received") - F.col("rows") + F.col("good") - F.col("keys")).alias("duplicates_removed"),
        total(F.col("rows") - F.col("good") + F.col("keys") - F.col("n")).alias("invalid_rows_dropped"),
    )
    found = _count_above(per_value.filter("v IS NOT NULL").select("v", "n")) if kind == "sales" else None
    return summed.withColumn("outliers_detected", F.lit(0).cast("bigint") if found is None else found.scalar())


# --- outliers --------------------------------------------------------------

def _coarse(value: Column) -> Column:
    """Log-scaled slot about 1 % wide: at most some 130 000 slots for all doubles."""
    size = F.floor(F.log2(F.abs(value) + 1.0) * 64).cast("int")
    return F.when(value < 0, -size - 1).otherwise(size)


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles ``p0, p1, …`` and the row count ``n``.

    Equal values are counted first. The count of smaller values is found in two
    steps: over the bounded table of coarse slots, then inside each slot. No
    task sees all values, and the result is exact.
    """
    return _quantiles_of(_histogram(df, column), probabilities)


def _histogram(df: DataFrame, column: str) -> DataFrame:
    value = F.col(column).cast("double")
    return df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))


def _quantiles_of(counts: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    histogram = counts.withColumn("slot", _coarse(F.col("v")))
    before_slot = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = histogram.groupBy("slot").agg(F.sum("n").alias("slot_n"))
    starts = slots.select("slot", F.coalesce(F.sum("slot_n").over(before_slot), F.lit(0)).alias("slot_start"))
    total = slots.agg(F.sum("slot_n")).scalar()
    in_slot = Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = histogram.join(F.broadcast(starts), "slot").select(
        "v", "n", (F.col("slot_start") + F.coalesce(F.sum("n").over(in_slot), F.lit(0))).alias("first_rank"),
        total.alias("total"),
    )

    def at(rank: Column) -> Column:
        inside = (F.col("first_rank") <= rank) & (rank < F.col("first_rank") + F.col("n"))
        return F.max(F.when(inside, F.col("v")))

    columns = []
    for i, p in enumerate(probabilities):
        position = (F.col("total") - 1) * F.lit(float(p))
        low, high = at(F.floor(position)), at(F.ceil(position))
        share = F.max(position - F.floor(position))
        columns.append((low + (high - low) * share).alias(f"p{i}"))
    return ranked.agg(*columns, F.coalesce(F.max("total"), F.lit(0)).alias("n"))


def outlier_bound(sales: DataFrame, column: str = "units_sold") -> DataFrame:
    """q1, q3 and the bound ``q3 + 3·(q3 - q1)``; no bound below four rows."""
    return _bound_of(_histogram(sales, column))


def _bound_of(counts: DataFrame) -> DataFrame:
    q = _quantiles_of(counts, [0.25, 0.75])
    bound = F.when(F.col("n") >= OUTLIER_MIN_ROWS, F.col("p1") + OUTLIER_SPREAD * (F.col("p1") - F.col("p0")))
    return q.select(F.col("p0").alias("q1"), F.col("p1").alias("q3"), bound.alias("upper_bound"), "n")


def outliers(sales: DataFrame, column: str = "units_sold") -> DataFrame:
    """Rows above the bound of the whole upload; they are reported, not removed."""
    bound = outlier_bound(sales, column).select("upper_bound").scalar()
    return sales.filter(F.col(column) > bound)


def count_outliers(sales: DataFrame, column: str = "units_sold") -> DataFrame:
    """Their number alone, from the value counts: the rows are read once."""
    return _count_above(_histogram(sales, column))


def _count_above(counts: DataFrame) -> DataFrame:
    bound = _bound_of(counts).select("upper_bound").scalar()
    return counts.filter(F.col("v") > bound).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("outliers"))


def quantiles_per_series(df: DataFrame, keys: Sequence[str], column: str, probabilities: Sequence[float]) -> DataFrame:
    """``exact_quantiles`` of every series: the keys, ``p0, p1, …`` and ``n``; rows without value or with a null key do not count.

    Equal values are counted first, and cut to the shared folder. A series of
    at most ``CELLS`` different values is put in order by itself. In longer ones
    the values at the wanted ranks are narrowed down: over the coarse slots of a series, over ``CELLS`` equal parts
    of the slot that holds the rank, over as many parts of that part, and by
    order inside the last one. So a step holds a bounded number of rows per
    series and rank, whatever the number of values, and only the values of
    parts that hold a rank are looked at again. These are dealt over ``DEALT``
    tasks a part, as one part may hold most of a series.
    """
    value = F.col(column).cast("double")
    counts = df.dropna(subset=list(keys)).filter(value.isNotNull()).groupBy(*keys, value.alias("v")).agg(F.count("*").alias("n"))
    counts = cut(counts)
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("values"))
    long = cut(sizes.filter(F.col("values") > CELLS).select(*keys))
    short = counts.join(sizes.filter(F.col("values") <= CELLS).select(*keys), list(keys), "left_semi")
    ordered = _quantiles_in_order(short, keys, probabilities)
    if long.isEmpty():
        return ordered
    return ordered.unionByName(_quantiles_by_cells(counts.join(long, list(keys), "left_semi"), keys, probabilities))


def _quantiles_in_order(counts: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """The quantiles of series of at most ``CELLS`` different values (keys, v, n), from their running counts."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumns({"start": before, "total": F.sum("n").over(Window.partitionBy(*keys))})

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("start") + F.col("n")), F.col("v")))

    columns = []
    for i, p in enumerate(probabilities):
        position = (F.col("total") - 1) * F.lit(float(p))
        low, high = at(F.floor(position)), at(F.ceil(position))
        columns.append((low + (high - low) * F.max(position - F.floor(position))).alias(f"p{i}"))
    return ranked.groupBy(*keys).agg(*columns, F.max("total").alias("n"))


def _quantiles_by_cells(counts: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """The quantiles of series of any number of values, narrowed down step by step."""
    cells = counts.withColumn("slot", _coarse(F.col("v"))).groupBy(*keys, "slot").agg(F.sum("n").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
    total = F.sum("m").over(Window.partitionBy(*keys))
    before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"total": total, "start": F.coalesce(F.sum("m").over(before), F.lit(0))})
    position = [(F.col("total") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = F.array(*[end(x).cast("bigint") for x in position for end in (F.floor, F.ceil)])
    wanted = _holding(cells.withColumn("ranks", F.transform(ranks, lambda r, i: F.struct(i.alias("which"), r.alias("rank")))), [*keys, "slot", "total"])
    inside = [*keys, "slot"]
    for level in ("part", "piece"):
        spread = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS)).otherwise(0).cast("int")
        counts = _in_cells(counts if level == "piece" else counts.withColumn("slot", _coarse(F.col("v"))), wanted, inside).withColumn(level, spread).drop("low", "high")
        cells = counts.groupBy(*inside, level).agg(F.sum("n").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = Window.partitionBy(*inside).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0)))
        asked = wanted.groupBy(*inside, "total").agg(F.collect_list(F.struct("which", "rank")).alias("ranks"))  # two a probability at most
        inside = [*inside, level]
        wanted = _holding(cells.join(asked, inside[:-1]), [*inside, "total"])
    last = _in_cells(counts, wanted, inside)
    before = Window.partitionBy(*inside).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*inside, F.col("n").alias("m"), F.col("v").alias("low"), F.col("v").alias("high"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    asked = wanted.groupBy(*inside, "total").agg(F.collect_list(F.struct("which", "rank")).alias("ranks"))
    found = _holding(last.join(asked, inside), [*keys, "total"])
    at = lambda i: F.max(F.when(F.col("which") == i, F.col("low")))
    ends = found.groupBy(*keys, "total").agg(*[at(i).alias(f"at{i}") for i in range(2 * len(probabilities))])
    share = [x - F.floor(x) for x in position]
    return ends.select(
        *keys, *[(F.col(f"at{2 * i}") + (F.col(f"at{2 * i + 1}") - F.col(f"at{2 * i}")) * share[i]).alias(f"p{i}") for i in range(len(share))], F.col("total").alias("n"))


def _holding(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row for each rank of ``ranks`` that a cell holds, with the rank inside it and the cell's ends."""
    held = F.filter("ranks", lambda r: (r["rank"] >= F.col("start")) & (r["rank"] < F.col("start") + F.col("m")))
    rows = cells.select(*names, "start", "low", "high", F.explode(held).alias("r"))
    return rows.select(*names, "low", "high", F.col("r.which").alias("which"), (F.col("r.rank") - F.col("start")).alias("rank"))


def _in_cells(counts: DataFrame, wanted: DataFrame, inside: Sequence[str]) -> DataFrame:
    """The values of the wanted cells with the cells' ends."""
    cells = wanted.select(*inside, "low", "high").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("dealt"))
    rows = counts.withColumn("dealt", F.pmod(F.xxhash64("v"), F.lit(DEALT)).cast("int"))
    return rows.join(cells, [*inside, "dealt"]).select(*counts.columns, "low", "high")


def outliers_per_series(sales: DataFrame, keys: Sequence[str], column: str = "units_sold") -> DataFrame:
    """The same test with one bound per series; rows with a null key are not tested. The rows, needed twice, are cut first."""
    sales = cut(sales)
    q = quantiles_per_series(sales, keys, column, [0.25, 0.75])
    bound = F.when(F.col("n") >= OUTLIER_MIN_ROWS, F.col("p1") + OUTLIER_SPREAD * (F.col("p1") - F.col("p0")))
    bounds = q.select(*keys, bound.alias("upper_bound"))
    return sales.join(bounds, list(keys)).filter(F.col(column) > F.col("upper_bound"))


# --- quality summary of a raw upload ---------------------------------------

def quality_summary(raw: DataFrame) -> DataFrame:
    """Rows, accepted and rejected rows, reason, date range and categories seen.

    The preview reads a blank unit field as zero and takes categories as they
    are written. The category list holds distinct values only.
    """
    have = set(raw.columns)
    missing = [c for c in ("date", "units_sold") if c not in have]
    day_text = F.trim("date") if "date" in have else F.lit("")
    units_text = F.trim("units_sold") if "units_sold" in have else F.lit("")
    numeric = (F.coalesce(units_text, F.lit("")) == "") | to_number(units_text).isNotNull()
    accepted = (F.coalesce(day_text, F.lit("")) != "") & numeric
    category = F.trim("category") if "category" in have else F.lit(None).cast("string")
    day = to_day(day_text)
    rows = raw.select(accepted.alias("ok"), F.when(accepted, day).alias("day"), F.when(accepted & (category != ""), category).alias("seen"))
    reason = f"Missing required columns: {', '.join(missing)}" if missing else "Invalid date or units_sold value"
    first, last = F.min("day"), F.max("day")
    ok_rows = F.count_if("ok")
    total = F.count("*")
    return rows.agg(
        total.alias("total_rows"),
        ok_rows.alias("accepted_rows"),
        (total - ok_rows).alias("rejected_rows"),
        F.when(total == 0, F.lit("Empty CSV")).otherwise(F.lit(reason)).alias("rejected_reason"),
        F.coalesce(F.concat(first.cast("string"), F.lit(" to "), last.cast("string")), F.lit("n/a")).alias("date_range"),
        F.array_sort(F.collect_set("seen")).alias("categories_detected"),
        (ok_rows > 0).alias("models_will_retrain"),
    )
