"""Pearson and Spearman correlation of numeric columns on pairwise complete rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colsight.errors import DatasetError
from colsight.functions.columns import chunks, col, numeric_columns, require_numeric
from colsight.functions.local import local_frame
from colsight.functions.missing import number, numbers
from colsight.functions.text import round4
from colsight.operators.profile import moments
from colsight.operators.ranks import rank_correlation, rank_sums
from colsight.operators.states import State, column_states

RAW_SCHEMA = "i int, j int, col1 string, col2 string, r double"
# Pairs per aggregate of the plan that works on moments instead of sums of products.
PAIRS_PER_SCAN = 256
# Below this share of the square sum of values of the column's usual size a variance is taken for rounding noise.
VARIANCE_NOISE = 1e-10


def usable_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, name) of the numeric columns that hold at least two different values."""
    return moments(df, columns).where("min <> max").select("position", "name")


def correlation_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """All defined pairs ranked by absolute correlation: (rank, i, j, col1, col2, correlation, abs_correlation).

    ``i`` and ``j`` are positions among the usable columns. Ties keep upper-triangle order.
    """
    return ranked_pairs(raw_correlations(df, columns, method))


def ranked_pairs(raw: DataFrame) -> DataFrame:
    # One row per pair of columns, so the ranking window stays small at any number of rows.
    order = Window.orderBy(F.desc("abs_correlation"), "i", "j")
    return (
        raw.where(F.col("r").isNotNull() & (F.col("i") < F.col("j")))
        .select(
            "i", "j", "col1", "col2",
            round4(F.col("r")).alias("correlation"),
            round4(F.abs("r")).alias("abs_correlation"),
        )
        .select(F.row_number().over(order).alias("rank"), "*")
    )


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.orderBy("rank").limit(k)


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """(i, j, col1, col2, value): the full grid of usable columns, 0.0 where undefined."""
    return full_grid(raw_correlations(df, columns, method))


def full_grid(raw: DataFrame) -> DataFrame:
    mirrored = raw.where("i < j").select(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r"
    )
    return raw.unionByName(mirrored).select(
        "i", "j", "col1", "col2", F.coalesce(round4(F.col("r")), F.lit(0.0)).alias("value")
    )


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """(i, name, row array<double>): one array per column of the matrix."""
    cells = F.array_sort(F.collect_list(F.struct("j", "value")))
    return matrix.groupBy("i", F.col("col1").alias("name")).agg(
        F.transform(cells, lambda c: c["value"]).alias("row")
    )


def wide_matrix(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column of the matrix, one column per name."""
    return matrix.groupBy("i", F.col("col1").alias("name")).pivot("col2", list(names)).agg(F.first("value"))


def raw_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", state: State | None = None
) -> DataFrame:
    """(i, j, col1, col2, r) for i <= j; r is NULL where a column is constant, or one infinite, within the pair.

    ``state`` takes a scan of the same columns that was made before, with pairs.
    """
    if method not in ("pearson", "spearman"):
        raise DatasetError(f"Unknown correlation method '{method}'.")
    clean = _doubles(df, columns)
    names = clean.columns
    if names and state is None:
        state = column_states(clean, names, pairs=method == "pearson")
    usable = [k for k in range(len(names)) if state and state.low[k] < state.high[k]]
    if len(usable) < 2:
        return local_frame(df.sparkSession, [], RAW_SCHEMA)
    named = [names[k] for k in usable]
    if method == "spearman":
        return _spearman(clean, named)

    known: list[tuple] = []
    redo = []
    for i, a in enumerate(usable):
        for j, b in enumerate(usable[i:], i):
            n, sxx, syy, sxy = state.n[a, b], state.square[a, b], state.square[b, a], state.cross[a, b]
            # Squares around the task's own centre: what is left of a constant side is rounding noise.
            noise_x, noise_y = (VARIANCE_NOISE * n * max(1.0, state.mean[p, q] ** 2) for p, q in ((a, b), (b, a)))
            if state.infinite[a, b] or not n:
                known.append((i, j, named[i], named[j], None))
            elif not (noise_x < sxx < math.inf and noise_y < syy < math.inf):
                redo.append((i, j))
            else:
                r = sxy / math.sqrt(sxx) / math.sqrt(syy)
                known.append((i, j, named[i], named[j], max(-1.0, min(1.0, r))))
    result = local_frame(df.sparkSession, known, RAW_SCHEMA)
    if redo:
        result = result.unionByName(pair_correlations(clean, named, redo))
    return result


def pair_correlations(df: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Correlations of chosen pairs from central moments, which are exactly zero for a constant.

    Cells go to long (i, j, x, y) rows, which keeps the aggregate small for any number of pairs.
    """
    clean = _doubles(df, names)
    undefined = F.lit(None).cast("double")
    frames = []
    for part in chunks(list(pairs), PAIRS_PER_SCAN):
        cells = [
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), col(names[i]).alias("x"), col(names[j]).alias("y"))
            for i, j in part
        ]
        # A pair without any complete row must come back undefined, so its rows stay in as NULLs.
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        frames.append(
            clean.select(F.inline(F.array(*cells)))
            .select("i", "j", F.when(both, F.col("x")).alias("x"), F.when(both, F.col("y")).alias("y"))
            .groupBy("i", "j")
            .agg(safe_corr(F.col("x"), F.col("y")).alias("r"))
        )
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    labels = F.array(*[F.lit(n) for n in names])
    return result.select(
        "i", "j",
        F.get(labels, F.col("i")).alias("col1"),
        F.get(labels, F.col("j")).alias("col2"),
        F.nanvl("r", undefined).alias("r"),
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation that is NULL for a constant side; both sides must be missing together."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def relationship(df: DataFrame, x: str, y: str, method: str = "pearson", bucket_rows: int | None = None) -> DataFrame:
    """One row: number of complete pairs and their Pearson or Spearman correlation."""
    for name in (x, y):
        require_numeric(df, name)
    if method not in ("pearson", "spearman"):
        raise DatasetError(f"Unknown correlation method '{method}'.")
    if method == "spearman":
        sums = rank_sums(df, [x, y], bucket_rows)
        result = sums.agg(
            F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("pair_count"), F.max(rank_correlation()).alias("r")
        )
    else:
        pair = df.select(number(df, x).alias("x"), number(df, y).alias("y"))
        result = pair.where("x IS NOT NULL AND y IS NOT NULL").agg(
            F.count("*").alias("pair_count"), safe_corr(F.col("x"), F.col("y")).alias("r")
        )
    return result.select(
        F.lit(x).alias("col1"),
        F.lit(y).alias("col2"),
        F.lit(method).alias("method"),
        "pair_count",
        round4(F.nanvl("r", F.lit(None).cast("double"))).alias("correlation"),
    )


def _doubles(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    names = numeric_columns(df) if columns is None else list(columns)
    for name in names:
        require_numeric(df, name)
    return numbers(df, names)


def _spearman(clean: DataFrame, names: Sequence[str]) -> DataFrame:
    """All pairs at once, each ranked on its own complete rows."""
    labels = F.array(*[F.lit(n) for n in names])
    pairs = rank_sums(clean, names).select("i", "j", rank_correlation().alias("r"))
    diagonal = local_frame(clean.sparkSession, [(k, k, 1.0) for k in range(len(names))], "i int, j int, r double")
    return pairs.unionByName(diagonal).select(
        "i", "j", F.get(labels, F.col("i")).alias("col1"), F.get(labels, F.col("j")).alias("col2"), "r"
    )
