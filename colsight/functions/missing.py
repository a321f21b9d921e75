"""One notion of a missing value: NULL, with NaN and textual NA tokens mapped onto it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colsight.functions.columns import col

# The texts a CSV reader takes for a missing cell.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def is_missing(name: str, dtype: T.DataType) -> Column:
    value = col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in float columns, so that every later aggregate skips it."""
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, with NaN as NULL."""
    value = col(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def numbers(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named numeric columns as doubles, with NaN as NULL."""
    return df.select(*[number(df, name).alias(name) for name in names])


def tokens_to_null(df: DataFrame, tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Turn NA tokens into NULL in string columns."""
    tokens = list(tokens)
    return df.select(
        *[
            F.when(~col(f.name).isin(tokens), col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_missing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep the rows where all named columns hold a value."""
    for name in names:
        df = df.where(~is_missing(name, df.schema[name].dataType))
    return df
