"""Column profile: counts, missing cells, distinct counts, moments, quartiles, preview."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colsight.functions.columns import (
    chunks,
    col,
    is_numeric,
    numeric_columns,
    pandas_label,
)
from colsight.functions.local import local_frame
from colsight.functions.missing import is_missing, nan_to_null
from colsight.functions.text import round4, undefined_to_zero
from colsight.operators.quantiles import column_quantiles
from colsight.operators.states import State, column_states

QUARTILES = (0.25, 0.5, 0.75)
# Counting needs no arithmetic, so more columns fit in one aggregate.
COUNTS_PER_AGGREGATE = 64


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def column_counts(df: DataFrame) -> DataFrame:
    """(position, name, rows, missing): one row per column of the table."""
    frames = []
    for part in chunks(list(enumerate(df.schema.fields)), COUNTS_PER_AGGREGATE):
        counts = df.agg(
            F.count("*").alias("rows"),
            *[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in part],
        )
        cells = [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("name"),
                F.col("rows"),
                F.col(f"m{i}").alias("missing"),
            )
            for i, f in part
        ]
        frames.append(counts.select(F.inline(F.array(*cells))))
    return _union(frames)


def dataset_overview(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row: table size, number of numeric and other columns, missing cells and their share.

    ``counts`` takes the result of :func:`column_counts` where it is known.
    """
    width, numeric = len(df.columns), len(numeric_columns(df))
    return (column_counts(df) if counts is None else counts).agg(
        F.max("rows").alias("row_count"),
        F.lit(width).cast("long").alias("column_count"),
        F.lit(numeric).cast("long").alias("numeric_count"),
        F.lit(width - numeric).cast("long").alias("categorical_count"),
        F.sum("missing").alias("total_missing"),
        F.coalesce(
            F.round(F.try_divide(F.sum("missing") * 100.0, F.sum("rows")), 2), F.lit(0.0)
        ).alias("missing_cell_pct"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, distinct): exact number of different values per column, missing ones excluded.

    Columns of one type become narrow (position, value) rows, so equal values collapse before the
    shuffle and no row carries the whole width of the table. Each scan reads its own columns only.
    """
    df = nan_to_null(df if columns is None else df.select(*[col(c) for c in columns]))
    by_type: dict[str, list[tuple[int, str]]] = {}
    for i, field in enumerate(df.schema.fields):
        by_type.setdefault(_common_type(field.dataType).simpleString(), []).append((i, field.name))
    frames = []
    for dtype, members in by_type.items():
        # Maps have no order and cannot be compared; their sorted entries can.
        whole = (lambda c: F.array_sort(F.map_entries(col(c)))) if dtype.startswith("map<") else (lambda c: col(c).cast(dtype))
        cells = [part for i, c in members for part in (F.lit(i), whole(c))]
        values = df.select(F.stack(F.lit(len(members)), *cells).alias("position", "value"))
        different = values.where("value IS NOT NULL").distinct()
        frames.append(different.groupBy("position").agg(F.count("*").alias("distinct")))
    return _union(frames)


def approx_distinct_counts(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """(position, distinct): sketch-based estimate, for tables where exact counts cost too much."""
    clean = nan_to_null(df)
    frames = []
    for part in chunks(list(enumerate(clean.columns))):
        row = clean.agg(*[F.approx_count_distinct(col(c), rsd).alias(f"d{i}") for i, c in part])
        cells = [F.struct(F.lit(i).alias("position"), F.col(f"d{i}").alias("distinct")) for i, _ in part]
        frames.append(row.select(F.inline(F.array(*cells))))
    return _union(frames)


def _common_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return T.LongType()
    return T.DoubleType() if isinstance(dtype, T.FloatType) else dtype


def profile_columns(
    df: DataFrame, approximate: bool = False, labels: str = "spark", counts: DataFrame | None = None
) -> DataFrame:
    """One row per column: type, missing count and share, distinct values, numeric or not.

    An entirely missing text column counts as numeric only after CSV ingest has typed it so.
    ``labels="pandas"`` reports the dtype names a pandas reader would show.
    """
    fields = df.schema.fields
    spark_names = _lookup([F.lit(f.dataType.simpleString()) for f in fields])
    pandas_names = _lookup([pandas_label(f.dataType, F.col("missing")) for f in fields])
    distinct = approx_distinct_counts(df) if approximate else distinct_counts(df)
    # Both sides have one row per column of the table.
    return (
        (column_counts(df) if counts is None else counts)
        .join(F.broadcast(distinct), "position", "left")
        .select(
            "position",
            "name",
            (pandas_names if labels == "pandas" else spark_names).alias("dtype"),
            F.col("missing").alias("missing_count"),
            F.coalesce(
                F.round(F.try_divide(F.col("missing") * 100.0, F.col("rows")), 2), F.lit(0.0)
            ).alias("missing_pct"),
            F.coalesce("distinct", F.lit(0)).alias("unique_count"),
            _lookup([F.lit(is_numeric(f.dataType)) for f in fields]).alias("is_numeric"),
        )
    )


def _lookup(per_column: Sequence[Column]) -> Column:
    return F.element_at(F.array(*per_column), F.col("position") + 1)


MOMENTS = "position int, name string, count long, mean double, std double, min double, max double"


def moments(df: DataFrame, columns: Sequence[str] | None = None, state: State | None = None) -> DataFrame:
    """(position, name, count, mean, std, min, max) of numeric columns, unrounded, from one scan or a ``state`` of it."""
    names = numeric_columns(df) if columns is None else list(columns)
    state = column_states(df, names) if names and state is None else state
    rows = [(i, name, *(state.moments(i) if state else (0, None, None, None, None))) for i, name in enumerate(names)]
    return local_frame(df.sparkSession, rows, MOMENTS)


def describe_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approximate: bool = False,
    interval_rows: int | None = None,
    state: State | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles (exact, unless told otherwise) of each numeric column.

    Quartiles that are not exact are off by about a thousandth of the rows. ``state`` takes a scan made before.
    """
    names = numeric_columns(df) if columns is None else list(columns)
    state = column_states(df, names, sketch=True) if names and state is None else state
    summaries = state.summaries if state else []
    if approximate:
        quartiles = {name: s.quantiles(QUARTILES) for name, s in zip(names, summaries) if s.n}
    else:
        quartiles = column_quantiles(df, names, QUARTILES, interval_rows, summaries)
    found = local_frame(
        df.sparkSession,
        [(names.index(name), *values) for name, values in quartiles.items()],
        "position int, q25 double, median double, q75 double",
    )
    # Both sides have one row per numeric column; columns without values drop out here.
    return (
        moments(df, names, state)
        .join(F.broadcast(found), "position")
        .select(
            "position",
            "name",
            F.col("count").cast("double").alias("count"),
            round4(F.col("mean")).alias("mean"),
            round4(undefined_to_zero(F.col("std"))).alias("std"),
            *[round4(F.col(c)).alias(c) for c in ("min", "q25", "median", "q75", "max")],
        )
    )


def preview_rows(df: DataFrame, order_by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """The first ``n`` rows by the given key, missing cells as NULL.

    Tables have no row order of their own: without a key, any ``n`` rows come back.
    """
    clean = nan_to_null(df)
    if order_by:
        clean = clean.orderBy(*[col(c) for c in order_by])
    return clean.limit(n)
