"""Exact-size, repeatable train/test split.

Rows are ordered by a hash of their key and the first share is the test side. Only the hash of the
last test row has to be found, by counting hash prefixes; membership is then a comparison that needs
no shuffle and no sort of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from colsight.errors import DatasetError
from colsight.functions.columns import col

PREFIX = 4
HASH_LENGTH = 32
# The most different hashes that the last step may order in one task.
CANDIDATE_ROWS = 1_000_000
COPIES_PER_TASK = 100_000


@dataclass(frozen=True)
class Split:
    """A split of one table: rows up to the cut are test rows."""

    key: tuple[str, ...]
    seed: int
    test_rows: int
    train_rows: int
    cut: str
    # Where several rows share the hash of the cut: how the whole rows behind it are divided.
    row_cut: str | None = None
    copies: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Add ``split_hash`` and ``is_test``."""
        hashed = df.withColumn("split_hash", split_hash(df, self.key, self.seed))
        if self.row_cut is None:
            return hashed.withColumn("is_test", F.col("split_hash") <= self.cut)
        whole = _row_hash(df, self.seed)
        tied = F.col("split_hash") == self.cut
        in_test = (F.col("split_hash") < self.cut) | (tied & (whole < self.row_cut))
        if self.copies is None:
            return hashed.withColumn("is_test", in_test | (tied & (whole == self.row_cut)))
        equal = tied & (whole == self.row_cut)
        others = hashed.where(~equal).withColumn("is_test", in_test)
        return others.unionByName(_divide_copies(hashed.where(equal), self.copies))


def split_hash(df: DataFrame, key: Sequence[str], seed: int) -> Column:
    """md5 of ``seed:key``; without a key, of the whole row."""
    if not key:
        return _row_hash(df, seed)
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in key]
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *parts)))


def _row_hash(df: DataFrame, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*[col(c) for c in df.columns]))))


def exact_split(
    df: DataFrame,
    key: Sequence[str] = (),
    test_size: float = 0.2,
    seed: int = 42,
    candidate_rows: int | None = None,
) -> Split:
    """Find the split with exactly ``ceil(test_size * rows)`` test rows.

    Rows that share a key hash are ordered by a hash of all their columns; identical rows are
    interchangeable and divided by number.
    """
    if not 0.0 < test_size < 1.0:
        raise DatasetError("test_size must lie between 0 and 1.")
    key = tuple(key)
    candidate_rows = CANDIDATE_ROWS if candidate_rows is None else candidate_rows
    hashes = df.select(split_hash(df, key, seed).alias("h"))
    total, cut, below, ties = _find_cut(hashes, lambda n: F.ceil(n * F.lit(test_size)), candidate_rows)
    test_rows = math.ceil(test_size * total)
    if test_rows == 0 or total - test_rows == 0:
        raise DatasetError("Too few rows for a training side and a test side.")
    split = Split(key, seed, test_rows, total - test_rows, cut)
    rest = test_rows - below
    if rest == ties:
        return split
    row_cut, in_row_cut = cut, ties
    if key:
        tied = df.where(split_hash(df, key, seed) == cut)
        _, row_cut, below, in_row_cut = _find_cut(tied.select(_row_hash(df, seed).alias("h")), lambda n: F.lit(rest), candidate_rows)
        rest -= below
    copies = None if rest == in_row_cut else rest
    return Split(key, seed, test_rows, total - test_rows, cut, row_cut, copies)


def _find_cut(hashes: DataFrame, rank_of: Callable[[Column], Column], candidate_rows: int) -> tuple[int, str, int, int]:
    """(rows, cut, rows below the cut, rows at the cut) for the hash at a 1-based rank.

    ``rank_of`` gives the rank from the number of rows.
    """
    total, rank, prefix, below, size = None, 0, "", 0, math.inf
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while size > candidate_rows and len(prefix) < HASH_LENGTH:
        # At most 16 ** PREFIX groups reach these windows, whatever the number of rows.
        groups = (
            hashes.where(F.col("h").startswith(prefix))
            .groupBy(F.substring("h", len(prefix) + 1, PREFIX).alias("p"))
            .agg(F.count("*").alias("n"))
        )
        row = (
            groups.select("p", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(everything).alias("rows"))
            .withColumn("rank", rank_of(F.col("rows")) if total is None else F.lit(rank))
            .where(F.col("upto") >= F.col("rank") - F.lit(below))
            .orderBy("p")
            .first()
        )
        if row is None:
            return 0, "", 0, 0
        if total is None:
            total, rank = row["rows"], row["rank"]
        below, size, prefix = below + row["upto"] - row["n"], row["n"], prefix + row["p"]
    upto = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    # At most candidate_rows different hashes: a full-length prefix leaves one.
    row = (
        hashes.where(F.col("h").startswith(prefix))
        .groupBy("h")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .where(F.col("upto") >= rank - below)
        .orderBy("h")
        .first()
    )
    return total, row["h"], below + row["upto"] - row["n"], row["n"]


def _divide_copies(equal: DataFrame, copies: int) -> DataFrame:
    """Identical rows: the first ``copies`` become test rows.

    They are counted, not gathered, and written out again in blocks over several tasks.
    """
    names = equal.columns
    blocks = (
        equal.groupBy(*[col(c) for c in names])
        .agg(F.count("*").alias("_n"))
        .withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(COPIES_PER_TASK))))
        .repartition("_from")
    )
    last = F.least(F.col("_from") + COPIES_PER_TASK, F.col("_n")) - 1
    return blocks.withColumn("_at", F.explode(F.sequence(F.col("_from"), last))).select(
        *[col(c) for c in names], (F.col("_at") < copies).alias("is_test")
    )
