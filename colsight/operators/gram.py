"""Pairwise sums of products over complete rows, from one scan.

Every task adds up its own small matrices over Arrow batches and emits one row per column pair, so
the shuffle carries (columns squared / 2) rows per task whatever the number of table rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colsight.functions.missing import number

PARTIAL = ("n", "sx", "sy", "sxx", "syy", "sxy")
_SCHEMA = "i int, j int, " + ", ".join(f"{name} double" for name in PARTIAL)


def pairwise_sums(
    df: DataFrame, columns: Sequence[str], centres: Sequence[float], scales: Sequence[float] | None = None
) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for i <= j over rows where both columns hold a value.

    Values are taken relative to ``centres`` and ``scales``; centres near the means keep the sums well
    conditioned, scales near the deviations keep them from overflowing.
    """
    values = df.select(*[number(df, c).alias(f"c{k}") for k, c in enumerate(columns)])
    partials = values.mapInArrow(_partials(np.asarray(centres, dtype=float), np.asarray(scales or 1.0, dtype=float)), _SCHEMA)
    return partials.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in PARTIAL])


def _partials(centres: np.ndarray, scales: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            cells = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            values = (np.column_stack(cells).astype(float) - centres) / scales
            present = ~np.isnan(values)
            values[~present] = 0.0
            mask = present.astype(float)
            sums = values.T @ mask
            squares = (values * values).T @ mask
            part = np.stack([mask.T @ mask, sums, sums.T, squares, squares.T, values.T @ values])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(centres))
            arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
            arrays += [pa.array(matrix[i, j]) for matrix in total]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", *PARTIAL])

    return run


def triangular_factor(df: DataFrame, columns: Sequence[str], centres: Sequence[float]) -> np.ndarray:
    """R of the QR factorisation of the centred columns, missing cells as zero.

    Tasks factor their batches on top of what they have, and factors are factored again in a tree: the products of
    columns, whose condition is that of the columns squared, are never formed.
    """
    width = len(columns)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            values = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns]).astype(float) - centres
            r = np.linalg.qr(np.vstack([r, np.nan_to_num(values)]), mode="r")
        yield _rows(r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                rows = np.asarray(batch.column(0).flatten()).reshape(-1, width)
                r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        yield _rows(r)

    schema = "r array<double>, task int"
    partial = df.select(*[number(df, c).alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(factor, schema)
    merged = partial.repartition("task").mapInArrow(merge, schema).repartition(1).mapInArrow(merge, schema)
    return np.array([row["r"] for row in merged.collect()]).reshape(-1, width)


def _rows(r: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(r) + 1) * r.shape[1], pa.int32())
    task = np.full(len(r), TaskContext.get().partitionId(), np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(r.ravel())), pa.array(task)], names=["r", "task"])
