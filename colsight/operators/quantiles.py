"""Exact quantiles with linear interpolation, without gathering a column in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a mergeable sketch proposes a narrow interval around each wanted rank, and a second scan counts the
rows before and in each interval exactly, keeps the values inside and reads the ranks off them. The sketch steers how much is kept, never the answer: a rank outside its interval is
looked up again in the gap it fell into, and an interval with too many rows is sketched again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colsight.functions.columns import chunks, col
from colsight.functions.local import local_frame
from colsight.functions.missing import nan_to_null, numbers
from colsight.functions.shared import kept
from colsight.operators.states import Summary, column_states

SKETCH_SIZE = 4096
# Half width of the interval around a wanted rank, a few times the rank error of such a sketch.
RANK_MARGIN = 0.003
# The most rows of one interval that the final ranking window may sort in one task.
INTERVAL_ROWS = 4_000_000
# Groups with more rows than this are ranked by intervals instead of one aggregation buffer.
GROUP_ROWS = 1_000_000
# Oversized groups whose selection is under way at once.
GROUPS_AT_ONCE = 100_000
GRID = 512


@dataclass
class _Interval:
    """A closed value interval that should hold the wanted ranks (0-based, group-wide)."""

    low: float
    high: float
    ranks: set[int]
    # Rows before the interval and rows up to its end, once counted.
    below: int = 0
    upto: int = 0


_Intervals = dict[tuple, list[_Interval]]


def sketch_quantiles(value: Column, points: Sequence[float], size: int = SKETCH_SIZE) -> Column:
    """Approximate quantiles of an aggregate at fixed points, and the number of values seen."""
    sketch = F.kll_sketch_agg_double(value, size)
    wanted = F.array(*[F.lit(float(p)) for p in points])
    return F.struct(
        F.kll_sketch_get_n_double(sketch).alias("n"),
        F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, wanted)).alias("edges"),
    )


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    interval_rows: int | None = None,
    summaries: Sequence[Summary] | None = None,
) -> dict[str, list[float]]:
    """Exact quantiles of whole numeric columns; columns without values are left out.

    The number of scans does not depend on that of columns. ``summaries`` of a scan made before save one.
    """
    columns = list(columns)
    if not columns:
        return {}
    if summaries is None:
        state = column_states(df, columns, sketch=True)
        summaries = state.summaries if state else []
    points = _interval_points(probabilities)
    groups = {(i,): (s.n, s.quantiles(points)) for i, s in enumerate(summaries) if s.n}
    cells = numbers(df, columns).toDF(*[f"c{k}" for k in range(len(columns))])
    with _WholeColumns(cells, max([0, *(n for n, _ in groups.values())])) as source:
        found = _select(source, groups, probabilities, interval_rows)
    return {columns[key[0]]: values for key, values in found.items()}


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    group_rows: int = GROUP_ROWS,
    aggregates: Sequence[Column] = (),
    name: str = "quantiles",
) -> DataFrame:
    """(by..., aggregates..., quantiles array<double>) per group, exact.

    Small groups use the built-in aggregate, next to any other ``aggregates`` of the rows. Groups with
    more than ``group_rows`` values go through the interval selection, some at a time, so no task ever
    holds all values of one. Both ways interpolate alike.
    """
    by = list(by)
    keys = [f"_g{i}" for i in range(len(by))]
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    builtin = F.percentile(col(value).cast("double"), wanted).alias(name)
    clean = nan_to_null(df)
    sizes = clean.groupBy(*[col(c).alias(k) for c, k in zip(by, keys)]).agg(F.count(col(value)).alias("_rows"))
    over = sizes.where(F.col("_rows") > group_rows)
    n_over = over.count()
    if not n_over:
        return clean.groupBy(*[col(c) for c in by]).agg(*aggregates, builtin)

    rows = clean.select(*[col(c).alias(k) for c, k in zip(by, keys)], col(value).cast("double").alias("x"))
    rows = rows.where("x IS NOT NULL")
    points = _interval_points(probabilities)
    blocks = -(-n_over // GROUPS_AT_ONCE)
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys] + [T.StructField(name, T.ArrayType(T.DoubleType()))]
    frames = []
    for block in range(blocks):
        mine = over.where(F.pmod(F.hash(*keys), F.lit(blocks)) == block).select(*keys).collect()
        large = _keyed_frame(rows, keys, {tuple(key): () for key in mine})
        # About GROUPS_AT_ONCE keys.
        hot = rows.join(F.broadcast(large), _same_keys(rows, large, keys), "left_semi")
        groups = {
            tuple(r[k] for k in keys): (r["_s"]["n"], r["_s"]["edges"])
            for r in hot.groupBy(*keys).agg(sketch_quantiles(F.col("x"), points).alias("_s")).collect()
        }
        found = _select(_Groups(hot, keys), groups, probabilities)
        frames.append(local_frame(df.sparkSession, [(*k, v) for k, v in found.items()], T.StructType(fields)))
    large_groups = reduce(DataFrame.unionByName, frames)
    # The values of oversized groups stay out of the built-in aggregate, their other aggregates do not.
    marked = clean.join(over.select(*keys, F.lit(True).alias("_over")), _same_values(clean, over, by, keys), "left")
    small = F.percentile(F.when(F.col("_over").isNull(), col(value).cast("double")), wanted)
    grouped = marked.groupBy(*[col(c) for c in by]).agg(*aggregates, small.alias("_small"))
    joined = grouped.join(large_groups, _same_values(grouped, large_groups, by, keys), "left")
    kept = [c for c in grouped.columns if c != "_small"]
    return joined.select(*[grouped["`" + c.replace("`", "``") + "`"] for c in kept], F.coalesce(large_groups[name], "_small").alias(name))


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float] | None:
    """Exact quantiles of one column, or None when it holds no value."""
    return column_quantiles(df, [value], probabilities).get(value)


def _interval_points(probabilities: Sequence[float]) -> list[float]:
    return [
        min(1.0, max(0.0, p + side * RANK_MARGIN)) for p in probabilities for side in (-1, 1)
    ]


def _same_values(rows: DataFrame, keys: DataFrame, by: Sequence[str], named: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name, key in zip(by, named):
        condition = condition & rows["`" + name.replace("`", "``") + "`"].eqNullSafe(keys[key])
    return condition


def _same_keys(rows: DataFrame, keys: DataFrame, by: Sequence[str]) -> Column:
    condition = F.lit(True)
    for i, name in enumerate(by):
        condition = condition & rows["`" + name.replace("`", "``") + "`"].eqNullSafe(keys[f"_k{i}"])
    return condition


def _wanted_ranks(n: int, probability: float) -> tuple[int, int, float]:
    position = probability * (n - 1)
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def _keyed_frame(rows: DataFrame, by: list[str], values: dict[tuple, tuple], schema: str = "") -> DataFrame:
    """(_k0, _k1, ..., values): one row per group, for joins with the group columns."""
    keys = [T.StructField(f"_k{i}", rows.schema[c].dataType) for i, c in enumerate(by)]
    fields = T.StructType(keys + (T.StructType.fromDDL(schema).fields if schema else []))
    return local_frame(rows.sparkSession, [(*key, *value) for key, value in values.items()], fields)


def _contains(x: Column, low: Column | float, high: Column | float) -> Column:
    return (x >= low) & (x <= high)


def _inner_sketch(x: Column, low: Column | float, high: Column | float) -> Column:
    """Copies of both ends, and a grid of quantiles of the values strictly between them.

    With the ends counted apart, a heavily repeated value stops mattering once it is an end.
    """
    points = [i / GRID for i in range(GRID + 1)]
    return F.struct(
        F.count_if(x == low).alias("at_low"),
        F.count_if(x == high).alias("at_high"),
        sketch_quantiles(F.when((x > low) & (x < high), x), points).alias("inner"),
    )


class _WholeColumns:
    """The columns of a frame of NaN-free doubles; the key of a column is its position.

    One scan over Arrow batches counts for all columns. While intervals are narrow it also keeps the values inside.
    """

    by = ["position"]

    def __init__(self, df: DataFrame, rows: int) -> None:
        self.df, self.rows = df, rows
        self.probed: DataFrame | None = None
        self.opened = ExitStack()

    def __enter__(self) -> _WholeColumns:
        return self

    def __exit__(self, *error: object) -> None:
        self.opened.close()

    def counts(self, pending: _Intervals, limit: int) -> dict[tuple, list[tuple[int, int]]]:
        keep = 2 * RANK_MARGIN * self.rows <= limit
        found = self.df.mapInArrow(_probe(pending, True, keep), _PROBED).groupBy("position", "slot", "x").agg(F.sum("n").alias("n"))
        self.opened.close()
        self.probed = self.opened.enter_context(kept(found, "intervals")) if keep else None
        counts = {(r["position"], r["slot"]): r["n"] for r in (self.probed or found).where("slot >= 0").collect()}
        return {
            key: [(counts.get((key[0], 2 * m), 0), counts.get((key[0], 2 * m + 1), 0)) for m in range(len(intervals))]
            for key, intervals in pending.items()
        }

    def sketches(self, pending: _Intervals) -> dict[tuple, list]:
        return self._per_interval(pending, lambda x, i: _inner_sketch(x, i.low, i.high))

    def inside(self, pending: _Intervals) -> DataFrame:
        if self.probed is None:
            rows = self.df.mapInArrow(_probe(pending, False, True), _PROBED)
        else:
            rows = self.probed.where(
                reduce(lambda a, b: a | b, [(F.col("position") == key[0]) & _contains(F.col("x"), i.low, i.high) for key, intervals in pending.items() for i in intervals])
            )
        return rows.where("slot < 0").select("position", "x", F.col("n").alias("copies"))

    def keyed(self, values: dict[tuple, tuple], schema: str) -> DataFrame:
        return local_frame(self.df.sparkSession, [(*k, *v) for k, v in values.items()], f"_k0 int, {schema}")

    def _per_interval(self, pending: _Intervals, aggregate: Callable[[Column, _Interval], Column]) -> dict[tuple, list]:
        found = {}
        for part in chunks(list(pending.items())):
            row = self.df.agg(
                *[
                    F.array(*[aggregate(col(self.df.columns[key[0]]), i) for i in intervals]).alias(str(key[0]))
                    for key, intervals in part
                ]
            ).first()
            found.update({key: row[str(key[0])] for key, _ in part})
        return found


# Slot 2 m counts the values below interval m, slot 2 m + 1 those up to its end; -1 has values inside.
_PROBED = "position int, slot int, x double, n bigint"
# Values that a task holds before it passes them on.
_HELD = 1_000_000


def _probe(pending: _Intervals, count: bool, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ends = {key[0]: (np.array([i.low for i in intervals]), np.array([i.high for i in intervals])) for key, intervals in pending.items()}

    def batch_of(position: int, slots: np.ndarray, x: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(n), position, np.int32)), pa.array(slots.astype(np.int32)), x, pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["position", "slot", "x", "n"])

    def values_of(position: int, held: list[np.ndarray]) -> pa.RecordBatch:
        x, n = np.unique(np.concatenate(held), return_counts=True)
        return batch_of(position, np.full(len(n), -1), pa.array(x), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {position: np.zeros(2 * len(low), np.int64) for position, (low, _) in ends.items()}
        held: dict[int, list[np.ndarray]] = {position: [] for position in ends}
        sizes = dict.fromkeys(ends, 0)
        for batch in batches:
            for position, (low, high) in ends.items():
                x = batch.column(position).to_numpy(zero_copy_only=False)
                x = np.sort(x[~np.isnan(x)])
                first, last = np.searchsorted(x, low, "left"), np.searchsorted(x, high, "right")
                counts[position][::2] += first
                counts[position][1::2] += last
                if keep:
                    held[position] += [x[a:b] for a, b in zip(first, last) if b > a]
                    sizes[position] += int((last - first).sum())
                    if sizes[position] >= _HELD:
                        yield values_of(position, held[position])
                        held[position], sizes[position] = [], 0
        for position in ends:
            if held[position]:
                yield values_of(position, held[position])
            if count:
                n = counts[position]
                yield batch_of(position, np.arange(len(n)), pa.nulls(len(n), pa.float64()), n)

    return run


class _Groups:
    """(by..., x) rows of large groups; intervals are broadcast, one row per group."""

    def __init__(self, rows: DataFrame, by: list[str]) -> None:
        self.rows, self.by = rows, by

    def counts(self, pending: _Intervals, limit: int) -> dict[tuple, list[tuple[int, int]]]:
        def pair(m: int) -> Column:
            return F.struct(F.count_if(F.col("x") < F.col("_low")[m]), F.count_if(F.col("x") <= F.col("_high")[m]))

        return {key: [tuple(p) for p in found] for key, found in self._per_interval(pending, pair).items()}

    def sketches(self, pending: _Intervals) -> dict[tuple, list]:
        return self._per_interval(pending, lambda m: _inner_sketch(F.col("x"), F.col("_low")[m], F.col("_high")[m]))

    def inside(self, pending: _Intervals) -> DataFrame:
        joined, width = self._joined(pending)
        within = [_contains(F.col("x"), F.col("_low")[m], F.col("_high")[m]) for m in range(width)]
        return joined.where(reduce(lambda a, b: a | b, within)).select(*[col(c) for c in self.by], "x", F.lit(1).alias("copies"))

    def keyed(self, values: dict[tuple, tuple], schema: str) -> DataFrame:
        return _keyed_frame(self.rows, self.by, values, schema)

    def _joined(self, pending: _Intervals) -> tuple[DataFrame, int]:
        width = max(len(intervals) for intervals in pending.values())
        # NaN orders above every value here, so no value lies inside the padding.
        padding = [math.nan] * width
        ends = {
            key: (([i.low for i in intervals] + padding)[:width], ([i.high for i in intervals] + padding)[:width])
            for key, intervals in pending.items()
        }
        state = self.keyed(ends, "_low array<double>, _high array<double>")
        return self.rows.join(F.broadcast(state), _same_keys(self.rows, state, self.by)), width

    def _per_interval(self, pending: _Intervals, aggregate: Callable[[int], Column]) -> dict[tuple, list]:
        joined, width = self._joined(pending)
        found = joined.groupBy(*[col(c) for c in self.by]).agg(F.array(*[aggregate(m) for m in range(width)]).alias("_found"))
        return {tuple(r[c] for c in self.by): r["_found"] for r in found.collect()}


def _select(
    source: _WholeColumns | _Groups,
    groups: dict[tuple, tuple[int, list[float]]],
    probabilities: Sequence[float],
    interval_rows: int | None = None,
) -> dict[tuple, list[float]]:
    """Quantiles per key, from the number of values and the first interval ends of each."""
    pending: _Intervals = {}
    for key, (n, edges) in groups.items():
        for i, p in enumerate(probabilities):
            low, high, _ = _wanted_ranks(n, p)
            pending.setdefault(key, []).append(_Interval(edges[2 * i], edges[2 * i + 1], {low, high}))

    limit = INTERVAL_ROWS if interval_rows is None else interval_rows
    values: dict[tuple, dict[int, float]] = {key: {} for key in groups}
    while pending:
        pending = {key: _merge(intervals) for key, intervals in pending.items()}
        ready: _Intervals = {}
        wide: _Intervals = {}
        missed: _Intervals = {}
        for key, counts in source.counts(pending, limit).items():
            missed[key] = _place(pending[key], counts)
            for i in pending[key]:
                if i.ranks and i.low == i.high:
                    values[key].update(dict.fromkeys(i.ranks, i.low))
                elif i.ranks:
                    (ready if i.upto - i.below <= limit else wide).setdefault(key, []).append(i)
        if wide:
            for key, sketches in source.sketches(wide).items():
                for interval, sketch in zip(wide[key], sketches):
                    keep, narrower = _narrow(interval, sketch, values[key], limit)
                    ready.setdefault(key, []).extend(keep)
                    missed[key] += narrower
        ready = {key: sorted(intervals, key=lambda i: i.low) for key, intervals in ready.items() if intervals}
        if ready:
            _read_ranks(source, ready, values)
        pending = {key: intervals for key, intervals in missed.items() if intervals}

    result = {}
    for key, (n, _) in groups.items():
        result[key] = []
        for p in probabilities:
            low, high, fraction = _wanted_ranks(n, p)
            a, b = values[key][low], values[key][high]
            # The formula of the built-in aggregate.
            result[key].append(a if a == b else (low + 1 - p * (n - 1)) * a + fraction * b)
    return result


def _merge(intervals: list[_Interval]) -> list[_Interval]:
    """Disjoint intervals in ascending order."""
    merged: list[_Interval] = []
    for current in sorted(intervals, key=lambda i: i.low):
        if merged and current.low <= merged[-1].high:
            merged[-1].high = max(merged[-1].high, current.high)
            merged[-1].ranks |= current.ranks
        else:
            merged.append(_Interval(current.low, current.high, set(current.ranks)))
    return merged


def _place(intervals: list[_Interval], counts: Sequence[tuple[int, int]]) -> list[_Interval]:
    """Give each rank to the interval that holds it; return the gaps that hold the others."""
    wanted = {r for i in intervals for r in i.ranks}
    for interval, (below, upto) in zip(intervals, counts):
        interval.below, interval.upto = below, upto
        interval.ranks = {r for r in wanted if below <= r < upto}
    gaps = []
    for rank in wanted.difference(*[i.ranks for i in intervals]):
        at = sum(i.upto <= rank for i in intervals)
        low = intervals[at - 1].high if at > 0 else -math.inf
        high = intervals[at].low if at < len(intervals) else math.inf
        gaps.append(_Interval(low, high, {rank}))
    return gaps


def _narrow(interval: _Interval, sketch, values: dict[int, float], interval_rows: int) -> tuple[list[_Interval], list[_Interval]]:
    """(intervals small enough to read, smaller intervals to count) for one that holds too many rows."""
    first, last = interval.below + sketch["at_low"], interval.upto - sketch["at_high"]
    values.update({r: interval.low for r in interval.ranks if r < first})
    values.update({r: interval.high for r in interval.ranks if r >= last})
    between = {r for r in interval.ranks if first <= r < last}
    if not between:
        return [], []
    if last - first <= interval_rows:
        return [_Interval(interval.low, interval.high, between, interval.below, interval.upto)], []
    grid = sketch["inner"]["edges"]
    cells = [int((r - first) / (last - first) * GRID) for r in between]
    return [], [_Interval(grid[max(0, at - 2)], grid[min(GRID, at + 3)], {r}) for r, at in zip(between, cells)]


def _read_ranks(source: _WholeColumns | _Groups, ready: _Intervals, values: dict[tuple, dict[int, float]]) -> None:
    """Read ranks off the values inside counted intervals."""
    rank_of: dict[tuple, dict[int, int]] = {}
    for key, intervals in ready.items():
        rank_of[key], before = {}, 0
        for i in intervals:
            rank_of[key].update({before + r - i.below: r for r in i.ranks})
            before += i.upto - i.below
    keys = [col(c) for c in source.by]
    counted = source.inside(ready).groupBy(*keys, "x").agg(F.sum("copies").alias("_rows"))
    # One window partition holds the different values of a few intervals of INTERVAL_ROWS rows each.
    upto = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_rows").over(upto))
    wanted = source.keyed({key: (sorted(found),) for key, found in rank_of.items()}, "_wanted array<bigint>")
    here = F.filter("_wanted", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_rows")))
    hits = (
        ranked.join(F.broadcast(wanted), _same_keys(ranked, wanted, source.by))
        .select(*keys, "x", here.alias("_hits"))
        .where(F.size("_hits") > 0)
        .collect()
    )
    for hit in hits:
        key = tuple(hit[c] for c in source.by)
        values[key].update({rank_of[key][index]: hit["x"] for index in hit["_hits"]})
