"""Calendar and festival-proximity column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

HORIZON_BANDS = ((7, "high"), (14, "medium"))


@dataclass(frozen=True)
class Tier:
    weight: float
    decay_scale: float
    window_days: int


# Tiers, anchors and category weights of the festival model.
TIERS = {
    "major": Tier(1.0, 0.70, 32),
    "medium": Tier(0.6, 0.90, 26),
    "minor": Tier(0.3, 1.00, 22),
}
# name: (tier, month, day); list order breaks ties between equally near festivals
ANCHORS = {
    "pongal": ("major", 1, 15),
    "holi": ("minor", 3, 25),
    "eid": ("medium", 4, 10),
    "independence day": ("minor", 8, 15),
    "navratri": ("medium", 10, 3),
    "diwali": ("major", 11, 1),
    "christmas": ("medium", 12, 25),
    "new year": ("minor", 12, 31),
}
CATEGORY_WEIGHTS = {
    "edible oil": {
        "diwali": 1.00, "pongal": 0.95, "eid": 0.85, "navratri": 0.50,
        "christmas": 0.45, "holi": 0.40, "independence day": 0.35, "new year": 0.40,
    },
    "staples": {
        "diwali": 0.95, "pongal": 0.90, "eid": 0.85, "navratri": 0.55,
        "christmas": 0.45, "holi": 0.40, "independence day": 0.35, "new year": 0.40,
    },
    "snacks": {
        "diwali": 1.00, "pongal": 0.55, "eid": 0.50, "navratri": 0.75,
        "christmas": 0.85, "holi": 0.45, "independence day": 0.40, "new year": 0.50,
    },
}
OTHER_CATEGORY_WEIGHT = 0.40
MIN_DECAY = 0.05
MIN_WINDOW_DAYS = 12
FAR_AWAY = 999


def weekday(d: Column) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(d)


def confidence(day_index: Column) -> Column:
    """Horizon confidence: first week high, second medium, then low."""
    out = F.lit("low")
    for last_day, label in reversed(HORIZON_BANDS):
        out = F.when(day_index <= last_day, F.lit(label)).otherwise(out)
    return out


def days_until(d: Column, as_of: Column) -> Column:
    return F.datediff(d, as_of)


def urgency(days: Column) -> Column:
    return (
        F.when(days < 0, "passed").when(days <= 7, "urgent").when(days <= 14, "soon").otherwise("later")
    )


def day_in_year(year: Column, month: Column, day: Column) -> Column:
    """That calendar day, null where the year lacks it (29 February)."""
    shifted = F.date_add(F.make_date(year, month, F.lit(1)), (day - 1).cast("int"))
    return F.when(F.month(shifted) == month, shifted)


def same_day_years_ago(d: Column, years: int) -> Column:
    return day_in_year(F.year(d) - years, F.month(d), F.dayofmonth(d))


def is_stale(last_upload: Column, as_of: Column, days: int = 7) -> Column:
    """True when the last upload is older than ``days``; false when unknown."""
    return F.coalesce(last_upload < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


# Category weights are stored per anchor in this order; any other category is last.
CATEGORY_ORDER = (*CATEGORY_WEIGHTS, None)
NEVER = 100_000  # distance of an anchor that exists in none of the three years


def festival_anchors(festivals: DataFrame) -> Column:
    """The eight modelled festivals as one array of structs.

    A table row overrides the built-in day when its trimmed lower-case name
    equals the anchor name exactly; the latest date wins. The result is an
    uncorrelated scalar subquery: Spark runs it once per query and every task
    gets eight small structs, however long the festival table is.

    ``offset`` is the day of the year in a common year, ``leap_shift`` what a
    leap year adds to it.
    """
    items = []
    for position, (anchor, (tier_name, month, day)) in enumerate(ANCHORS.items()):
        tier = TIERS[tier_name]
        listed = f"max(date) FILTER (WHERE lower(trim(festival_name)) = '{anchor}')"
        m, d = f"coalesce(month({listed}), {month})", f"coalesce(day({listed}), {day})"
        weights = [CATEGORY_WEIGHTS.get(c, {}).get(anchor, OTHER_CATEGORY_WEIGHT) for c in CATEGORY_ORDER]
        reach = ", ".join(f"{tier.weight * w!r}D" for w in weights)
        items.append(
            f"""named_struct(
                'position', {position},
                'offset', datediff(make_date(2001, {m}, 1), DATE'2001-01-01') + {d} - 1,
                'leap_shift', IF({m} > 2, 1, 0),
                'leap_only', {m} = 2 AND {d} = 29,
                'decay_scale', {tier.decay_scale}D,
                'window', {max(MIN_WINDOW_DAYS, tier.window_days)},
                'reach', array({reach}))"""
        )
    return festivals.agg(F.expr(f"array({', '.join(items)})").alias("anchors")).scalar()


def _years_sql(d: str) -> str:
    """Days from ``d`` to 1 January of the year before, this and the next year,
    each with a flag for leap years."""
    start = [f"datediff(make_date(year({d}) + {shift}, 1, 1), {d})" for shift in (-1, 0, 1, 2)]
    items = [
        f"named_struct('i', {i}, 'start', {start[i]}, 'leap', {start[i + 1]} - {start[i]} = 366)" for i in range(3)
    ]
    return f"array({', '.join(items)})"


# Yearly occurrences of anchor a; the smallest struct is the nearest one, and a
# tie goes to the earlier year.
_NEAREST_SQL = f"""array_min(transform(years, y -> named_struct(
    'size', IF(NOT a.leap_only OR y.leap, abs(y.start + a.offset + IF(y.leap, a.leap_shift, 0)), {NEVER}),
    'i', y.i,
    'delta', y.start + a.offset + IF(y.leap, a.leap_shift, 0))))"""


def _score_sql(kind: int, k: float) -> str:
    """``1 - exp(-sum)`` of the contributions of all festivals within their window."""
    contribution = f"""IF(n.size <= a.window,
        a.reach[{kind}] * exp(-greatest({MIN_DECAY}D, {float(k)!r}D * a.decay_scale) * n.size), 0D)"""
    parts = f"zip_with(anchors, nearest, (a, n) -> {contribution})"
    return f"1D - exp(-aggregate({parts}, 0D, (total, x) -> total + x))"


# Signed distance to the nearest festival; between equally near ones the first
# in the anchor list counts.
_DISTANCE_SQL = """array_min(zip_with(anchors, nearest,
    (a, n) -> named_struct('size', n.size, 'position', a.position, 'delta', n.delta))).delta"""


# Scores depend on a date only through its day of the year and on which of the
# year before, the year itself and the year after is a leap year (at most one
# is). One sample year stands for each of the four cases, in this order:
# none, the year before, the year itself, the year after.
SAMPLE_YEARS = (2002, 2001, 2004, 2003)
YEAR_SLOTS = 366
BLOCK = len(SAMPLE_YEARS) * YEAR_SLOTS


def _sample_days(festivals: DataFrame) -> DataFrame:
    """One row per slot of the tables below (1464 rows, whatever the data) with
    the nearest occurrence of every anchor."""
    years = ", ".join(map(str, SAMPLE_YEARS))
    slots = festivals.sparkSession.range(BLOCK)
    dated = slots.selectExpr(
        "id", f"date_add(make_date(array({years})[CAST(id DIV {YEAR_SLOTS} AS INT)], 1, 1), CAST(id % {YEAR_SLOTS} AS INT)) AS d"
    )
    return (
        dated.withColumn("anchors", festival_anchors(festivals))
        .withColumn("years", F.expr(_years_sql("d")))
        .withColumn("nearest", F.expr(f"transform(anchors, a -> {_NEAREST_SQL})"))
    )


def score_table(festivals: DataFrame, k: float = 0.2) -> Column:
    """All festival scores as one flat array: a block of slots per category kind.

    An uncorrelated scalar subquery of fixed size (under 50 KB), worked out
    once per query. Rows then look their score up by position, which is exact
    for every date and costs neither a join nor the sums over festivals.
    """
    scores = ", ".join(_score_sql(kind, k) for kind in range(len(CATEGORY_ORDER)))
    rows = _sample_days(festivals).selectExpr("id", f"array({scores}) AS s")
    ordered = "array_sort(collect_list(named_struct('id', id, 's', s)))"
    blocks = ", ".join(f"transform(slots, x -> x.s[{kind}])" for kind in range(len(CATEGORY_ORDER)))
    return rows.agg(F.expr(ordered).alias("slots")).selectExpr(f"concat({blocks}) AS score_table").scalar()


def distance_table(festivals: DataFrame) -> Column:
    """Signed distances to the nearest festival, one block of slots."""
    rows = _sample_days(festivals).selectExpr("id", f"{_DISTANCE_SQL} AS s")
    ordered = "array_sort(collect_list(named_struct('id', id, 's', s)))"
    return rows.agg(F.expr(ordered).alias("slots")).selectExpr("slots.s AS distance_table").scalar()


def _leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _year_start(year: Column) -> Column:
    """First slot of the sample year that stands for ``year``."""
    sample = F.when(_leap(year), 2).when(_leap(year - 1), 1).when(_leap(year + 1), 3).otherwise(0)
    return sample * YEAR_SLOTS


def _kind_start(category: Column) -> Column:
    normalized = F.lower(F.trim(category))
    kind = F.lit(len(CATEGORY_ORDER) - 1)
    for i, name in enumerate(CATEGORY_ORDER[:-1]):
        kind = F.when(normalized == name, F.lit(i)).otherwise(kind)
    return kind * BLOCK


def festival_score(d: Column, category: Column, table: Column) -> Column:
    slot = _kind_start(category) + _year_start(F.year(d)) + F.dayofyear(d) - 1
    return F.coalesce(F.get(table, slot), F.lit(0.0))


def days_to_event(d: Column, table: Column) -> Column:
    """Signed distance to the nearest modelled festival; 999 without a date."""
    return F.coalesce(F.get(table, _year_start(F.year(d)) + F.dayofyear(d) - 1), F.lit(FAR_AWAY))


def festival_scores_ahead(last: Column, n_days: int, category: Column, table: Column) -> Column:
    """Scores of the ``n_days`` after ``last`` as an array: one slice per year touched."""
    first, end = F.date_add(last, 1), F.date_add(last, n_days)
    parts = []
    for ahead in range(n_days // 365 + 2):
        year = F.year(first) + ahead
        start = F.greatest(first, F.make_date(year, F.lit(1), F.lit(1)))
        stop = F.least(end, F.make_date(year, F.lit(12), F.lit(31)))
        length = F.greatest(F.lit(0), F.datediff(stop, start) + 1)
        slot = _kind_start(category) + _year_start(year) + F.dayofyear(start)
        parts.append(F.slice(table, slot, length))
    return F.concat(*parts)
