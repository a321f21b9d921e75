"""The three workflows: profile a table, fit a model on it, report on both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colsight.functions.columns import col, numeric_columns
from colsight.functions.local import local_frame
from colsight.functions.missing import nan_to_null
from colsight.operators.correlation import full_grid, matrix_rows, ranked_pairs, raw_correlations
from colsight.operators.profile import column_counts, dataset_overview, describe_numeric, preview_rows, profile_columns
from colsight.operators.regression import LinearModel, fit_linear_regression
from colsight.operators.states import column_states
from colsight.plans.report import report_lines
from colsight.sources.checks import check_shape


@dataclass
class Analysis:
    """Profile and associations of one table, as small result frames."""

    name: str
    table: DataFrame
    overview: DataFrame
    columns: DataFrame
    statistics: DataFrame
    preview: DataFrame
    pairs: DataFrame
    matrix: DataFrame

    def train(self, target: str | None = None, features: Sequence[str] | None = None, **options) -> LinearModel:
        """See :func:`colsight.operators.regression.fit_linear_regression`."""
        return fit_linear_regression(self.table, target, features, **options)

    def report(self, model: LinearModel | None = None) -> DataFrame:
        return report_lines(self.name, self.overview, self.columns, self.statistics, self.pairs, model)

    def record(self) -> DataFrame:
        """Everything but the model as one nested row, ready for a JSON sink.

        Its lists have one entry per column, column pair or preview row.
        """

        def listed(df: DataFrame, order: str) -> Column:
            cells = F.struct(order, *[c for c in df.columns if c != order])
            return df.agg(F.array_sort(F.collect_list(cells))).scalar()

        return self.overview.select(
            "*",
            listed(self.columns, "position").alias("columns"),
            listed(self.statistics, "position").alias("statistics"),
            listed(self.pairs, "rank").alias("pairs"),
            listed(matrix_rows(self.matrix), "i").alias("matrix"),
            self.preview.agg(F.collect_list(F.struct(*[col(c) for c in self.preview.columns]))).scalar().alias("preview"),
        )


def analyse(
    df: DataFrame,
    name: str = "dataset",
    key: Sequence[str] = (),
    max_rows: int | None = None,
    max_columns: int | None = None,
    approximate_distinct: bool = False,
    labels: str = "spark",
) -> Analysis:
    """Profile a table and correlate its numeric columns.

    ``key`` orders the preview. The table is scanned several times; persist it first where reading
    it is dearer than keeping it.
    """
    check_shape(df, max_rows, max_columns)
    table = nan_to_null(df)
    spark = df.sparkSession
    # Counts are one scan, everything about numbers another; both leave a few rows per column or pair.
    counts = local_frame(spark, column_counts(table).collect(), "position int, name string, rows long, missing long")
    numeric = numeric_columns(table)
    state = column_states(table, numeric, pairs=True, sketch=True) if numeric else None
    correlations = raw_correlations(table, state=state)
    return Analysis(
        name,
        table,
        dataset_overview(table, counts),
        profile_columns(table, approximate_distinct, labels, counts),
        describe_numeric(table, state=state),
        preview_rows(table, key),
        ranked_pairs(correlations),
        full_grid(correlations),
    )
