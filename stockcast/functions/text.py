"""Text and number cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and token lists the results depend on.
HIDDEN_CHARS = r"[\x00-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{feff}]"
WHITESPACE = r"[\s\p{Z}]+"
# every character that counts as white space in Unicode text
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TIME_OF_DAY = r"([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?"
ISO_DAY = rf"^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}{TIME_OF_DAY}$"
YEAR_FIRST = rf"^([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}}){TIME_OF_DAY}$"
YEAR_LAST = rf"^([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{4}}){TIME_OF_DAY}$"
RUN_TOGETHER = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
# day, month name, year; and month name, day, year: which group holds what
NAMED_FORMS = (
    (r"^([0-9]{1,2})[ -]([A-Za-z]{3})[a-z]*\.?,?[ -]([0-9]{4})$", (3, 2, 1)),
    (r"^([A-Za-z]{3})[a-z]*\.? ([0-9]{1,2}),? ([0-9]{4})$", (3, 1, 2)),
)
# the commonest forms, told without trimming
QUICK_SKU = r"^[!-~]*+\z"
QUICK_NUMBER = r"^[0-9]{1,15}\z"
QUICK_YEAR_FIRST = r"^[0-9]{4}/[0-9]{2}/[0-9]{2}\z"
QUICK_YEAR_LAST = r"^[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}\z"
QUICK_TIMED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\z"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
BLOCKED_TOKENS = ("<system>", "</system>", "<|", "|>", "\\n\\nHuman:", "\\n\\nAssistant:")
CATEGORY_PREFIXES = {
    "snacks": "Snacks",
    "staples": "Staples",
    "edible_oil": "Edible Oil",
    "edibleoil": "Edible Oil",
    "edible-oil": "Edible Oil",
}


def strip(c: Column) -> Column:
    """Trim every kind of Unicode space, not only the ASCII blank."""
    return F.trim(c, F.lit(SPACES))


def norm_sku(c: Column) -> Column:
    """Item id without control or zero-width characters, trimmed, upper case. Visible ASCII alone needs no such care."""
    return F.when(c.rlike(QUICK_SKU), F.upper(c)).otherwise(F.upper(strip(F.regexp_replace(c, HIDDEN_CHARS, ""))))


def norm_text(c: Column) -> Column:
    """Hidden characters removed first (so tabs vanish), then runs of space made one."""
    visible = F.regexp_replace(c, HIDDEN_CHARS, "")
    return strip(F.regexp_replace(visible, WHITESPACE, " "))


def title_case(c: Column) -> Column:
    """Capital after every non-letter; ``initcap`` alone only looks at blanks."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def norm_category(c: Column) -> Column:
    return title_case(norm_text(c))


def to_number(c: Column) -> Column:
    """Text to double; anything that is no finite decimal number becomes null.

    The remainder by infinity leaves finite numbers as they are and turns
    infinities into NaN, so the value is worked out once. A few digits alone
    are cast as they are.
    """
    raw = c.cast("string")
    text = strip(raw)
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(raw.rlike(QUICK_NUMBER), raw.try_cast("double")).otherwise(F.nanvl(value % F.lit(float("inf")), F.lit(None).cast("double")))


def to_day(c: Column, day_first: bool = False, order: Column | None = None) -> Column:
    """Text to date; a time of day is dropped, unreadable text becomes null.

    ``01/02/2024`` is 2 January, or 1 February with ``day_first``; the other
    reading is tried where the first gives no day. With ``order``, true for day
    first, only that reading counts: a file has one order
    (``sources.upload.with_date_order``).

    The text is matched and cast: format parsers signal a misfit by an
    exception per row, which costs far more than the parsing itself. The common
    forms are told by their length and marks, before any other pattern is tried.
    """
    raw = c.cast("string")
    ten = F.length(raw) == 10
    quick = (
        F.when(ten & (F.substring(raw, 5, 1) == "-") & (F.substring(raw, 8, 1) == "-"), raw.try_cast("date"))
        .when(ten & raw.rlike(QUICK_YEAR_FIRST), F.translate(raw, "/", "-").try_cast("date"))
        .when((F.length(raw) == 19) & raw.rlike(QUICK_TIMED), F.substring(raw, 1, 10).try_cast("date"))
    )
    if order is not None:
        first, second = F.substring(raw, 1, 2), F.substring(raw, 4, 2)
        iso = F.concat(F.substring(raw, 7, 4), F.lit("-"), F.when(order, second).otherwise(first), F.lit("-"), F.when(order, first).otherwise(second))
        quick = quick.when(ten & raw.rlike(QUICK_YEAR_LAST), iso.try_cast("date"))
    text = strip(raw)

    def made(pattern: str, iso: str) -> Column:
        return F.regexp_replace(text, pattern, iso).try_cast("date")

    month_first, day_before = made(YEAR_LAST, "$3-$1-$2"), made(YEAR_LAST, "$3-$2-$1")
    if order is None:
        year_last = F.coalesce(day_before, month_first) if day_first else F.coalesce(month_first, day_before)
    else:
        year_last = F.when(order, day_before).otherwise(month_first)
    found = (
        F.when(text.rlike(ISO_DAY), text.try_cast("date"))
        .when(text.rlike(YEAR_LAST), year_last)
        .when(text.rlike(YEAR_FIRST), made(YEAR_FIRST, "$1-$2-$3"))
        .when(text.rlike(RUN_TOGETHER), made(RUN_TOGETHER, "$1-$2-$3"))
    )
    for pattern, (year, month, day) in NAMED_FORMS:
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, pattern, month)))
        iso = F.concat_ws("-", F.regexp_extract(text, pattern, year), number.cast("string"), F.regexp_extract(text, pattern, day))
        found = found.when(text.rlike(pattern), iso.try_cast("date"))
    return F.coalesce(quick, found)


def comma_items(c: Column) -> Column:
    """``"a, b,,c"`` to ``["a", "b", "c"]``."""
    return F.filter(F.transform(F.split(c, ","), lambda item: strip(item)), lambda item: item != "")


def slug(c: Column) -> Column:
    """Path-safe lower-case name, ``unknown`` when nothing is left."""
    dashed = F.regexp_replace(F.lower(strip(c)), "[^a-zA-Z0-9_-]+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(bare == "", "unknown").otherwise(F.coalesce(bare, F.lit("unknown")))


def prompt_safe(c: Column, limit: int | None = None) -> Column:
    """The text without the blocked tokens; cut to ``limit`` characters before, if one is given."""
    safe = c if limit is None else F.substring(c, 1, limit)
    for token in BLOCKED_TOKENS:
        safe = F.replace(safe, F.lit(token), F.lit(""))
    return safe


def action_words(c: Column) -> Column:
    """``URGENT_ORDER`` to ``Urgent Order``."""
    return title_case(F.replace(c, F.lit("_"), F.lit(" ")))


def file_stem(path: Column) -> Column:
    """File name in lower case, without folders and ``.csv``."""
    return F.replace(F.lower(F.substring_index(path, "/", -1)), F.lit(".csv"), F.lit(""))


def category_from_file(path: Column) -> Column:
    """Category named by the start of a file name; the longest of the fixed prefixes wins."""
    base = file_stem(path)
    longest_first = sorted(CATEGORY_PREFIXES, key=len, reverse=True)
    hits = [F.when(F.startswith(base, F.lit(p)), F.lit(CATEGORY_PREFIXES[p])) for p in longest_first]
    return F.coalesce(*hits)


def params_hash(n_days: Column, inventory: Column, lead: Column, pack: Column | None = None) -> Column:
    """Request fingerprint; without ``pack`` the form older entries carry."""
    parts = [n_days, inventory, lead] + ([pack] if pack is not None else [])
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def is_reusable_insight(c: Column) -> Column:
    """True for plain text; false for blanks and for logged decision records.

    Text that only looks like JSON but cannot be parsed counts as plain text.
    """
    text = strip(F.coalesce(c, F.lit("")))
    record = F.get_json_object(text, "$")
    decision = F.coalesce(F.get_json_object(text, "$.decision"), F.lit(""))
    is_decision = (F.coalesce(F.get_json_object(text, "$.type"), F.lit("")) == "forecast_decision") | F.contains(
        decision, F.lit("recommended_action")
    )
    return (text != "") & ~(F.startswith(text, F.lit("{")) & record.isNotNull() & is_decision)
