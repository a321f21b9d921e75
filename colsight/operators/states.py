"""Everything that numeric columns need from one scan: counts, sums, extremes, quantile summaries and co-moments.

Each task folds its Arrow batches into one state for all columns together, whatever their number; states are merged
in a tree, first one for each shuffle partition, then one. Co-moments of a pair are taken over the rows where both
columns hold a finite value, around means of their own; infinite ones are counted per pair. A column's values are
scaled by a power of two of its own, so that squares neither overflow nor vanish.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colsight.functions.missing import numbers

# Points of a summary, and values that are summarised at once.
POINTS, RAW = 2048, 1 << 16


@dataclass
class Summary:
    """Quantiles of ``n`` values: all of them, or POINTS of equal weight.

    Each merge of equals moves a rank by at most 1 / (2 * POINTS) of the values, and there are as many as the tree is high.
    """

    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n: int = 0

    @classmethod
    def merged(cls, parts: Sequence[Summary]) -> Summary:
        parts = [p for p in parts if p.n]
        n = sum(p.n for p in parts)
        if not n:
            return cls()
        values = np.concatenate([p.values for p in parts])
        order = np.argsort(values, kind="stable")
        values = values[order]
        if len(values) == n <= POINTS:
            return cls(values, n)
        upto = np.cumsum(np.concatenate([np.full(len(p.values), p.n / len(p.values)) for p in parts])[order])
        at = np.searchsorted(upto, (np.arange(POINTS) + 0.5) * (n / POINTS))
        return cls(values[np.minimum(at, len(values) - 1)], n)

    def quantiles(self, points: Sequence[float]) -> list[float]:
        last = len(self.values) - 1
        return [float(self.values[min(last, int(p * len(self.values)))]) for p in points]


class _Summarising:
    """A summary of a stream: one for each power of two of RAW values, merged like the digits of a counter."""

    def __init__(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.levels: list[Summary | None] = []

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.size += len(values)
        if self.size >= RAW:
            self._carry(self._raw())

    def _raw(self) -> Summary:
        values = np.concatenate(self.waiting) if self.waiting else np.zeros(0)
        self.waiting, self.size = [], 0
        return Summary.merged([Summary(values, len(values))])

    def _carry(self, one: Summary) -> None:
        for level, held in enumerate(self.levels):
            if held is None:
                self.levels[level] = one
                return
            one = Summary.merged([held, one])
            self.levels[level] = None
        self.levels.append(one)

    def result(self) -> Summary:
        return Summary.merged([*(s for s in self.levels if s), self._raw()])


@dataclass
class State:
    """Arrays by column, and by pair (column, partner): what the column has in rows where the partner has a value too.

    ``mean`` counts from ``centre``; it, ``square`` and ``cross`` are divided by 2 ** ``exponent`` of their columns.
    """

    count: np.ndarray
    total: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    exponent: np.ndarray
    n: np.ndarray
    infinite: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    cross: np.ndarray
    summaries: list[Summary]

    def merge(self, other: State) -> State:
        exponent = np.maximum(self.exponent, other.exponent)
        one, two = np.ldexp(1.0, self.exponent - exponent)[:, None], np.ldexp(1.0, other.exponent - exponent)[:, None]
        n = self.n + other.n
        # A column without finite values has no centre of its own.
        centre = np.where(np.isnan(self.centre), other.centre, self.centre)
        shift = np.nan_to_num(np.ldexp(other.centre - centre, -exponent))[:, None]
        mean = self.mean * one
        moved = np.where(other.n > 0, other.mean * two + shift, 0.0)
        with np.errstate(invalid="ignore", over="ignore"):
            step = np.where((self.n > 0) & (other.n > 0), moved - mean, 0.0)
            weight = self.n * (other.n / np.maximum(n, 1))
            square = self.square * one**2 + other.square * two**2 + step**2 * weight
            cross = self.cross * one * one.T + other.cross * two * two.T + step * step.T * weight
        mean = np.where(self.n > 0, mean + step * other.n / np.maximum(n, 1), moved)
        return State(
            self.count + other.count, self.total + other.total, np.fmin(self.low, other.low), np.fmax(self.high, other.high), centre, exponent,
            n, self.infinite + other.infinite, mean, square, cross, [Summary.merged([a, b]) for a, b in zip(self.summaries, other.summaries)],
        )

    def moments(self, k: int) -> tuple[int, float | None, float | None, float | None, float | None]:
        """Count, mean, sample deviation, minimum and maximum of a column."""
        count = int(self.count[k])
        if not count:
            return 0, None, None, None, None
        std = None
        if count > 1:
            std = math.nan if self.infinite[k, k] else float(np.ldexp(math.sqrt(self.square[k, k] / (count - 1)), self.exponent[k]))
        return count, float(self.total[k] / count), std, float(self.low[k]), float(self.high[k])


class _Folding:
    """The state of one task. Without ``pairs`` a column meets only itself."""

    def __init__(self, width: int, pairs: bool, sketch: bool) -> None:
        self.width, self.pairs = width, pairs
        self.count, self.total = np.zeros(width, np.int64), np.zeros(width)
        self.low, self.high = np.full(width, np.nan), np.full(width, np.nan)
        self.centre, self.exponent = np.full(width, np.nan), np.zeros(width, np.int64)
        shape = (width, width) if pairs else (width,)
        self.n, self.infinite = np.zeros(shape), np.zeros(shape)
        self.sums, self.squares, self.cross = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.summaries = [_Summarising() for _ in range(width)] if sketch else []

    def add(self, values: np.ndarray) -> None:
        present = ~np.isnan(values)
        self.count += present.sum(axis=0)
        with np.errstate(invalid="ignore"):
            self.total += np.where(present, values, 0.0).sum(axis=0)
        for k in np.flatnonzero(present.any(axis=0)):
            held = values[present[:, k], k]
            self.low[k], self.high[k] = np.fmin(self.low[k], held.min()), np.fmax(self.high[k], held.max())
            if self.summaries:
                self.summaries[k].add(held)
        finite = np.isfinite(values)
        for k in np.flatnonzero(np.isnan(self.centre) & finite.any(axis=0)):
            held = values[finite[:, k], k]
            self.centre[k] = held.mean() if math.isfinite(held.sum()) else held[0]
            self.exponent[k] = int(np.frexp(np.abs(held - self.centre[k]).max() or 1.0)[1])
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.where(finite, np.ldexp(values - np.nan_to_num(self.centre), -self.exponent), 0.0)
            mask, squares = finite.astype(float), scaled * scaled
            if self.pairs:
                self.n += mask.T @ mask
                self.sums += scaled.T @ mask
                self.squares += squares.T @ mask
                self.cross += scaled.T @ scaled
                if (present & ~finite).any():
                    held = present.astype(float)
                    self.infinite += held.T @ held - mask.T @ mask
            else:
                self.n += mask.sum(axis=0)
                self.sums += scaled.sum(axis=0)
                self.squares += squares.sum(axis=0)
                self.infinite += (present & ~finite).sum(axis=0)

    def result(self) -> State:
        full = (lambda x: x) if self.pairs else np.diag
        n, sums, squares, cross = (full(x) for x in (self.n, self.sums, self.squares, self.cross))
        mean = sums / np.maximum(n, 1)
        with np.errstate(invalid="ignore", over="ignore"):
            square = np.maximum(squares - sums * mean, 0.0)
            cross = cross - sums * mean.T
        return State(
            self.count, self.total, self.low, self.high, self.centre, self.exponent, n, full(self.infinite), mean, square, cross,
            [s.result() for s in self.summaries],
        )


def column_states(df: DataFrame, columns: Sequence[str], pairs: bool = False, sketch: bool = False) -> State | None:
    """The state of numeric columns; None for a frame without rows."""
    width = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folding = None
        for batch in batches:
            if batch.num_rows:
                folding = folding or _Folding(width, pairs, sketch)
                folding.add(np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns]).astype(float))
        if folding:
            yield _packed(folding.result())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for packed in batch.column(1):
                other = pickle.loads(packed.as_py())
                state = other if state is None else state.merge(other)
        if state is not None:
            yield _packed(state)

    schema = "key bigint, state binary"
    states = numbers(df, columns).toDF(*[f"c{k}" for k in range(width)]).mapInArrow(fold, schema)
    merged = states.repartition("key").mapInArrow(merge, schema).repartition(1).mapInArrow(merge, schema)
    row = merged.first()
    return None if row is None else pickle.loads(row["state"])


def _packed(state: State) -> pa.RecordBatch:
    from pyspark import TaskContext

    key = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["key", "state"])
