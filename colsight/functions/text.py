"""Rounding and number texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round4(value: Column) -> Column:
    return F.round(value, 4)


def undefined_to_zero(value: Column) -> Column:
    """0.0 in place of NULL or NaN."""
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def thousands(value: Column) -> Column:
    """1234567 -> 1,234,567."""
    return F.format_number(value, 0)


def decimal_text(value: Column, places: int = 4) -> Column:
    """Shortest plain decimal text with at least one decimal: 20.0, 0.95, 10000000.0."""
    fixed = F.format_string(f"%.{places}f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")


def code_text(name: Column) -> Column:
    """A name as Markdown code inside a table cell."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("|"), F.lit("\\|")), F.lit("`"))
