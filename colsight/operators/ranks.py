"""Average ranks of all columns at once, without a single-task sort.

One long frame holds the different values of every column with their numbers of rows. It is range-partitioned by
(column, value) and sorted, each partition adds up its rows, and the rows of the partitions before give the shift:
partitions are even by Spark's own sample, however many rows there are, and no list of ends leaves the engine.

A pair of columns with gaps is ranked on the rows where both hold a value. A column's ranks depend on its partner only
through the partner's gaps, so each value carries one number of rows for each column with gaps (and one for all rows),
and one sort a column serves all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from colsight.functions.local import local_frame
from colsight.functions.missing import number
from colsight.functions.shared import kept

# A value with more than this share of the rows is frequent: there are at most 1 / share of them, sent to all tasks.
FREQUENT_SHARE = 0.001

# Small buckets make at most so many partitions: a task costs the same however few its rows. More are made only for full ones.
MOST_SMALL, FULL_BUCKET = 256, 1_000_000

PARTIAL = ("n", "sxx", "syy", "sxy")


def in_order(
    frame: DataFrame, by: Sequence[str], scan: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None
) -> DataFrame:
    """``scan(batches, part)`` over each of the partitions of a frame sorted by ``by``, whose numbers grow with the keys.

    To be stored: the numbers hold for one run.
    """
    dealt = frame.repartitionByRange(parts, *by) if parts else frame.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by).mapInArrow(lambda batches: scan(batches, TaskContext.get().partitionId()), schema)


def parts_for(rows: int, bucket_rows: int | None) -> int | None:
    """Number of partitions for so many rows each, or for more where there would be too many; None leaves it to Spark."""
    if not bucket_rows:
        return None
    return max(1, min(math.ceil(rows / bucket_rows), max(MOST_SMALL, math.ceil(rows / FULL_BUCKET))))


def _running(width: int) -> Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]:
    """Adds the part's number and, for each of ``width`` counts, the rows of the column up to the value within the part."""

    def scan(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        last, total = -1, np.zeros(width, np.int64)
        for batch in batches:
            position = batch.column(0).to_numpy()
            counts = np.stack([batch.column(2 + k).to_numpy() for k in range(width)])
            upto = np.cumsum(counts, axis=1)
            starts = np.flatnonzero(np.diff(position, prepend=position[:1] - 1))
            before = np.where(starts > 0, upto[:, starts - 1], 0)
            if len(starts) and position[0] == last:
                before[:, 0] -= total
            upto -= np.repeat(before, np.diff(np.append(starts, len(position))), axis=1)
            if len(position):
                last, total = position[-1], upto[:, -1].copy()
            arrays = [*batch.columns, pa.array(np.full(len(position), part, np.int32)), *(pa.array(u) for u in upto)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "part", *(f"u{k}" for k in range(width))])

    return scan


def values_in_order(cells: DataFrame, gappy: Sequence[int], rows: int, bucket_rows: int | None = None) -> DataFrame:
    """(position, value, n0, ..., part, u0, ...): numbers of rows with the different values of all columns, and of the rows up to them within their part.

    0 stands for all rows, k for those where the k-th of the ``gappy`` columns holds a value. To be stored.
    """
    names, width = cells.columns, 1 + len(gappy)
    held = [F.col(names[g]).isNotNull().alias(f"h{k}") for k, g in enumerate(gappy, 1)]
    long = cells.select(*held, F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.col(c).alias("value")) for i, c in enumerate(names)])))
    counted = long.where("value IS NOT NULL").groupBy("position", "value").agg(
        F.count("*").alias("n0"), *[F.count_if(F.col(f"h{k}")).alias(f"n{k}") for k in range(1, width)]
    )
    numbers_ = ", ".join(f"n{k} bigint" for k in range(width))
    schema = f"position int, value double, {numbers_}, part int, {', '.join(f'u{k} bigint' for k in range(width))}"
    return in_order(counted, ["position", "value"], _running(width), schema, parts_for(rows * len(names), bucket_rows))


def average_ranks(ordered: DataFrame, width: int) -> DataFrame:
    """(position, value, n0, ..., r0, ...): the 1-based mean ranks of stored :func:`values_in_order`."""
    # One row for each part of each column: at most the number of partitions and that of columns.
    parts = ordered.groupBy("position", "part").agg(*[F.max(f"u{k}").alias(f"t{k}") for k in range(width)])
    earlier = Window.partitionBy("position").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("position", "part", *[F.coalesce(F.sum(f"t{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in range(width)])
    rank = lambda k: (F.col(f"b{k}") + F.col(f"u{k}") - (F.col(f"n{k}") - 1) / 2).cast("double").alias(f"r{k}")
    shifted = ordered.join(F.broadcast(shifts), ["position", "part"])
    return shifted.select("position", "value", *[f"n{k}" for k in range(width)], *[rank(k) for k in range(width)])


def rank_sums(df: DataFrame, names: Sequence[str], bucket_rows: int | None = None) -> DataFrame:
    """(i, j, n, sxx, syy, sxy) for i < j: sums over the centred average ranks of each pair's complete rows.

    The number of jobs and of sorts does not depend on the number of pairs.
    """
    cells = df.select(*[number(df, c).alias(f"c{k}") for k, c in enumerate(names)])
    row = cells.agg(F.count("*"), *[F.count(c) for c in cells.columns]).first()
    rows, held = row[0], row[1:]
    gappy = [k for k, n in enumerate(held) if n < rows]
    with kept(values_in_order(cells, gappy, rows, bucket_rows), "ranks", "position") as ordered:
        sums = _rank_sums(cells, average_ranks(ordered, 1 + len(gappy)), gappy, rows).collect()
    return local_frame(df.sparkSession, sums, "i int, j int, " + ", ".join(f"{p} double" for p in PARTIAL))


def _rank_sums(cells: DataFrame, ranks: DataFrame, gappy: Sequence[int], rows: int) -> DataFrame:
    names = cells.columns
    # One row per column: the rows of each of its pairs, and whether it has frequent values.
    often = F.col("n0") > rows * FREQUENT_SHARE
    totals = ranks.groupBy("position").agg(F.count_if(often).alias("often"), F.count_if(~often).alias("rare"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(1 + len(gappy))])
    total = {r["position"]: r for r in totals.collect()}
    given = {g: k for k, g in enumerate(gappy, 1)}
    partners = [sorted({given.get(j, 0) for j in range(len(names)) if j != i}) for i in range(len(names))]
    listed = [f"r{i}_{k}" for i, wanted in enumerate(partners) for k in wanted]
    centres = [((total[i][f"n{k}"] if i in total else 0) + 1) / 2 for i, wanted in enumerate(partners) for k in wanted]

    # Frequent values are looked up in each task; a row that has no others is done, and not joined again. What is left of
    # a row shrinks as it goes from join to join: the ranks found, and the cells that are still to be looked up.
    looked, found = cells, []
    for i, wanted in enumerate(partners):
        frequent = ranks.where((F.col("position") == i) & often).select(F.col("value").alias(f"v{i}"), *[F.col(f"r{k}").alias(f"r{i}_{k}") for k in wanted])
        looked = looked.join(F.broadcast(frequent), F.col(f"c{i}") == F.col(f"v{i}"), "left")
        found += [f"r{i}_{k}" for k in wanted]
    open_ = [i for i in range(len(names)) if i in total and total[i]["rare"]]
    cell = lambda i: F.when(F.col(f"v{i}").isNull(), F.col(f"c{i}")).alias(f"c{i}")
    looked = looked.select(*found, *[cell(i) for i in open_])
    done = reduce(and_, [F.col(f"c{i}").isNull() for i in open_], F.lit(True))
    ranked = looked.where(~done)
    for i in open_:
        ranked = _attach(ranked, ranks.where((F.col("position") == i) & ~often), i, partners[i])
    ranked = ranked.select(*listed)
    if all(k in given or (k in total and total[k]["often"]) for k in range(len(names))):
        ranked = ranked.unionByName(looked.where(done).select(*listed))

    place = {name: at for at, name in enumerate(listed)}
    pairs = [
        (i, j, place[f"r{i}_{given.get(j, 0)}"], place[f"r{j}_{given.get(i, 0)}"]) for i in range(len(names)) for j in range(i + 1, len(names))
    ]
    sums = ranked.mapInArrow(_pair_sums(pairs, centres), "i int, j int, " + ", ".join(f"{p} double" for p in PARTIAL))
    return sums.groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in PARTIAL])


def _attach(rows: DataFrame, ranks: DataFrame, position: int, wanted: Sequence[int]) -> DataFrame:
    """Fills in the ranks of a column's values that are not frequent, and drops its cells.

    Rows without such a cell meet nothing. They are spread by all they hold, of which there are few copies: at least one of their values is not frequent.
    """
    cell = F.col(f"c{position}")
    found = ranks.select(F.col("value").alias("_value"), F.lit(0).cast("long").alias("_spread"), *[F.col(f"r{k}").alias(f"_r{k}") for k in wanted])
    salt = F.when(cell.isNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long"))
    keyed = rows.withColumn("_salt", salt)
    joined = keyed.join(found, (cell == F.col("_value")) & (F.col("_salt") == F.col("_spread")), "left")
    filled = {f"r{position}_{k}": F.coalesce(f"r{position}_{k}", f"_r{k}") for k in wanted}
    return joined.select(*[filled[c].alias(c) if c in filled else c for c in rows.columns if c != f"c{position}"])


def _pair_sums(pairs: Sequence[tuple[int, int, int, int]], centres: Sequence[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), len(PARTIAL)))
        for batch in batches:
            ranks = [column.to_numpy(zero_copy_only=False) - centre for column, centre in zip(batch.columns, centres)]
            for at, (_, _, a, b) in enumerate(pairs):
                both = ~(np.isnan(ranks[a]) | np.isnan(ranks[b]))
                x, y = ranks[a][both], ranks[b][both]
                total[at] += len(x), x @ x, y @ y, x @ y
        sides = [pa.array([p[k] for p in pairs], pa.int32()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*sides, *(pa.array(c) for c in total.T)], names=["i", "j", *PARTIAL])

    return run


def rank_correlation() -> Column:
    """Correlation from the sums of :func:`rank_sums`; NULL where a side is constant.

    The mean rank is the centre, so all ranks of a constant side are exactly zero.
    """
    r = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
