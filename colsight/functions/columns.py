"""Column references and the numeric / non-numeric kind of a column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colsight.errors import DatasetError

Item = TypeVar("Item")

# Aggregates over more columns than this are split into several scans of disjoint columns: a column
# store reads the same bytes in total, and every aggregate stays small enough to be compiled.
COLUMNS_PER_AGGREGATE = 8


def col(name: str) -> Column:
    """Refer to a column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans count as numeric (0/1); dates, times, arrays, maps and structs do not."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if is_numeric(field.dataType)]


def default_target(df: DataFrame) -> str:
    """The last numeric column."""
    names = numeric_columns(df)
    if not names:
        raise DatasetError("The dataset has no numeric column to use as target.")
    return names[-1]


def as_double(name: str) -> Column:
    return col(name).cast("double")


def require_numeric(df: DataFrame, name: str, role: str = "Column") -> None:
    if name not in df.columns:
        raise DatasetError(f"{role} '{name}' does not exist in the dataset.")
    if not is_numeric(df.schema[name].dataType):
        raise DatasetError(f"{role} '{name}' is not numeric.")


def chunks(items: Sequence[Item], size: int = COLUMNS_PER_AGGREGATE) -> Iterator[Sequence[Item]]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def pandas_label(dtype: T.DataType, missing: Column) -> Column:
    """The dtype name a pandas CSV reader would report for the column."""
    if isinstance(dtype, T.BooleanType):
        return F.when(missing > 0, "object").otherwise("bool")
    if isinstance(dtype, T.IntegralType):
        return F.when(missing > 0, "float64").otherwise("int64")
    return F.lit("float64" if isinstance(dtype, T.NumericType) else "object")
