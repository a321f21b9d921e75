"""Optional limits on the shape of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colsight.errors import DatasetError


def require_rows(rows: int, max_rows: int | None) -> None:
    if max_rows is not None and rows > max_rows:
        raise DatasetError(f"The table has {rows:,} rows; the limit is {max_rows:,}.")


def require_columns(columns: int, max_columns: int | None) -> None:
    if max_columns is not None and columns > max_columns:
        raise DatasetError(f"The table has {columns} columns; the limit is {max_columns}.")


def check_shape(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Return the table unchanged, or raise when it is empty or larger than a given limit."""
    require_columns(len(df.columns), max_columns)
    if max_rows is not None:
        rows = df.count()
        require_rows(rows, max_rows)
        empty = rows == 0
    else:
        empty = df.isEmpty()
    if empty:
        raise DatasetError("The table is empty: not one row of data.")
    return df


def shape(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """One row: rows and columns, and whether each is within its limit."""
    columns = len(df.columns)
    rows = F.count("*")
    return df.agg(
        rows.alias("row_count"),
        F.lit(columns).cast("long").alias("column_count"),
        (rows > 0).alias("has_rows"),
        (F.lit(True) if max_rows is None else rows <= max_rows).alias("rows_within_limit"),
        F.lit(max_columns is None or columns <= max_columns).alias("columns_within_limit"),
    )
