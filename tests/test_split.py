import hashlib
import math

import pytest
from pyspark.sql import functions as F

from colsight.errors import DatasetError
from colsight.operators import split as S


def members(df, split, side=True):
    return split.apply(df).where(F.col("is_test") == side)


@pytest.mark.parametrize("candidates", [1_000_000, 10])
def test_exact_sizes_and_order(spark, monkeypatch, candidates):
    monkeypatch.setattr(S, "CANDIDATE_ROWS", candidates)
    monkeypatch.setattr(S, "PREFIX", 1)
    for n, size in ((10, 0.2), (101, 0.2), (1000, 0.35)):
        df = spark.range(n).repartition(4)
        split = S.exact_split(df, ["id"], size)
        want = sorted(range(n), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert (split.test_rows, split.train_rows) == (math.ceil(size * n), n - math.ceil(size * n))
        assert {r["id"] for r in members(df, split).collect()} == set(want[: split.test_rows])


def test_partitioning_does_not_matter(spark):
    df = spark.range(500)
    assert S.exact_split(df.repartition(1), ["id"]) == S.exact_split(df.repartition(17), ["id"])


def test_key_with_copies_orders_whole_rows(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    split = S.exact_split(df, ["k"], 0.3)
    assert members(df, split).count() == 30 and members(df, split, False).count() == 70
    assert split.apply(df).distinct().count() == 100
    again = S.exact_split(df.repartition(9), ["k"], 0.3)
    assert {r["v"] for r in members(df, split).collect()} == {r["v"] for r in members(df, again).collect()}


@pytest.mark.parametrize("key", [[], ["k"]])
def test_identical_rows_are_divided_by_number(spark, monkeypatch, key):
    monkeypatch.setattr(S, "COPIES_PER_TASK", 7)
    df = spark.range(60).select(F.lit(1).alias("k"), F.when(F.col("id") < 50, -1).otherwise(F.col("id")).alias("v"))
    split = S.exact_split(df, key, 0.5)
    done = split.apply(df)
    assert done.where("is_test").count() == 30 and done.count() == 60
    assert done.where("v = -1").count() == 50 and done.where("v <> -1").distinct().count() == 10


def test_without_key_copies_stay_together(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("v"))
    sides = S.exact_split(df).apply(df).groupBy("v").agg(F.count_distinct("is_test").alias("n"))
    assert sides.where("n > 1").count() <= 1


def test_bad_requests(spark):
    with pytest.raises(DatasetError, match="test_size"):
        S.exact_split(spark.range(10), ["id"], 1.0)
    with pytest.raises(DatasetError, match="Too few rows"):
        S.exact_split(spark.range(1), ["id"])
    with pytest.raises(DatasetError, match="Too few rows"):
        S.exact_split(spark.range(0), ["id"])
