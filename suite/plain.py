"""Results in types both engines print alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, dates, times and arrays as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, digits)
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        out.append(c.alias(name))
    return df.select(*out)
