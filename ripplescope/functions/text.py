"""Numbers and texts of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 2) -> Column:
    """Round half up in binary doubles, as floor(v * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def pad(text: Column, width: int) -> Column:
    """Left-aligned; a text of the width or more is cut to width - 2 and one space."""
    return F.when(F.length(text) >= width, F.concat(F.substring(text, 1, width - 2), F.lit(" "))).otherwise(F.rpad(text, width, " "))


def percent(value: Column) -> Column:
    return F.coalesce(F.concat(F.floor(value * 100.0 + 0.5).cast("string"), F.lit("%")), F.lit("unknown"))


def signed(value: Column) -> Column:
    return F.when(value.isNull(), "  ?").when(value > 0, F.concat(F.lit("+"), value.cast("string"))).otherwise(value.cast("string"))


def yes_no(value: Column) -> Column:
    return F.when(value, "yes").otherwise("no")


def one_line(text: Column, width: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, width)


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"`]|['\"`]$", "")


def confidence(stop_fraction: Column, js_fraction: Column, stop_weight: float = 0.5, js_weight: float = 0.2) -> Column:
    """1 less the weighted fractions, within 0 and 1, rounded half up to two digits."""
    raw = F.lit(1.0) - F.lit(stop_weight) * stop_fraction - F.lit(js_weight) * js_fraction
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def locale_order(c: Column) -> Column:
    """A key that sorts names as readers do: letters before case, accents in between, by the root collation of Unicode."""
    return F.collate(c, "UNICODE")
