import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.errors import DatasetError
from colsight.operators import correlation as C, ranks
from colsight.operators.ranks import FULL_BUCKET, MOST_SMALL, parts_for


def pairs(df, **kw):
    return [(r["col1"], r["col2"], r["correlation"]) for r in C.correlation_pairs(df, **kw).orderBy("rank").collect()]


def test_perfect_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, "a") for i in range(1, 6)], "x double, y double, cat string")
    assert pairs(df) == [("x", "y", 1.0)]
    assert {r["value"] for r in C.correlation_matrix(df).collect()} == {1.0}


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a", "c"), ("b", "d")], "p string, q string")
    assert pairs(df) == [] and C.correlation_matrix(df).count() == 0


def test_column_constant_within_a_pair(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 5, None), (3, 5, None), (None, 7, 2)], "x int, y int, z int")
    assert pairs(df) == [("y", "z", 1.0)]
    grid = {(r["col1"], r["col2"]): r["value"] for r in C.correlation_matrix(df).collect()}
    assert grid[("x", "y")] == grid[("y", "x")] == grid[("x", "z")] == 0.0 and grid[("z", "y")] == 1.0


def test_constant_decimal_is_not_a_pair(spark):
    df = spark.createDataFrame([(0.1, float(i), None if i < 7 else 3.0) for i in range(9)], "c double, x double, z double")
    got = C.correlation_pairs(df.unionByName(df.limit(0)))
    assert got.count() == 0
    df = spark.createDataFrame([(0.1 if i < 7 else 9.0, i if i < 7 else None) for i in range(9)], "c double, x int")
    assert C.correlation_pairs(df).count() == 0


def test_booleans_and_ties(spark):
    df = spark.createDataFrame([(True, 1), (False, 2), (True, 3)], "b boolean, x int")
    assert pairs(df) == [("b", "x", 0.0)]
    df = spark.createDataFrame([(i, 2 * i, -i) for i in range(9)], "x int, y int, z int")
    assert [p[:2] for p in pairs(df)] == [("x", "y"), ("x", "z"), ("y", "z")]


def test_infinite_values_are_undefined(spark):
    df = spark.createDataFrame([(1.0, 1, 3), (float("inf"), 2, 4), (2.0, 3, 1)], "x double, y int, z int")
    assert [p[:2] for p in pairs(df)] == [("y", "z")]


def random_frame(n=3000):
    rng = np.random.default_rng(11)
    base = rng.normal(size=n)
    pdf = pd.DataFrame(
        {
            "a": base,
            "b": 1e6 + base + rng.normal(size=n),
            "hot": np.where(rng.random(n) < 0.4, 2.0, rng.lognormal(size=n)),
            "small": rng.integers(0, 4, n).astype(float),
        }
    )
    pdf["gaps"] = np.where(rng.random(n) < 0.2, np.nan, pdf.a * pdf.hot)
    return pdf


def check(df, pdf, method):
    want = pdf.corr(method=method)
    for r in C.raw_correlations(df, method=method).collect():
        assert (np.nan if r["r"] is None else r["r"]) == pytest.approx(want.loc[r["col1"], r["col2"]], abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("parts", [1, 17])
def test_pearson_plans_match_pandas(spark, parts):
    pdf = random_frame()
    df = spark.createDataFrame(pdf).repartition(parts)
    check(df, pdf, "pearson")
    names = list(pdf.columns)
    some = [(0, 1), (2, 4), (3, 3)]
    got = {(r["i"], r["j"]): r["r"] for r in C.pair_correlations(df, names, some).collect()}
    for i, j in some:
        assert got[i, j] == pytest.approx(pdf.corr().iloc[i, j], abs=1e-9)


@pytest.mark.parametrize("bucket_rows", [None, 100])
def test_spearman_matches_pandas(spark, bucket_rows):
    pdf = random_frame()
    pdf = pd.concat([pdf] + [pdf.head(1)] * 1500, ignore_index=True)
    ranked = pdf.assign(gaps=pdf.gaps)
    df = spark.createDataFrame(pdf)
    want = ranked.corr(method="spearman")
    for x, y in (("a", "hot"), ("hot", "gaps"), ("small", "b")):
        got = C.relationship(df, x, y, "spearman", bucket_rows).first()
        assert got["pair_count"] == len(pdf[[x, y]].dropna())
        assert got["correlation"] == pytest.approx(want.loc[x, y], abs=1e-4)
    check(df.select("a", "hot", "small", "gaps"), pdf[["a", "hot", "small", "gaps"]], "spearman")


def test_partitions_of_small_buckets_do_not_grow_with_the_rows():
    assert parts_for(10, None) is None and parts_for(0, 100) == 1
    assert [parts_for(n, 100) for n in (1000, 10**6, 10**7)] == [10, MOST_SMALL, MOST_SMALL]
    assert [parts_for(n, 500) for n in (72 * 10**6, 432 * 10**6)] == [MOST_SMALL, 432]
    assert parts_for(10**9, 10 * FULL_BUCKET) == 100


def test_rows_shrink_from_join_to_join(spark, monkeypatch):
    joined = []
    attach = ranks._attach
    monkeypatch.setattr(ranks, "_attach", lambda rows, *given: joined.append(rows.columns) or attach(rows, *given))
    n = np.arange(4000)
    pdf = pd.DataFrame({"a": n * 7 % 4001, "few": n % 3, "b": n * 11 % 4001, "hot": np.where(n % 2, 5, n)}).astype(float)
    check(spark.createDataFrame(pdf), pdf, "spearman")
    found = ["r0_0", "r1_0", "r2_0", "r3_0"]
    assert joined == [found + ["c0", "c2", "c3"], found + ["c2", "c3"], found + ["c3"]]


def test_spearman_of_pairs_with_gaps_of_their_own(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({f"c{k}": rng.integers(0, 40, 900).astype(float) for k in range(5)})
    pdf["c3"] += pdf.c1
    for k in range(1, 5):
        pdf.loc[rng.random(900) < 0.15 * k, f"c{k}"] = np.nan
    pdf["flat"] = np.where(pdf.c1.isna(), np.arange(900), 7.0)
    pdf["few"] = np.where(np.arange(900) < 3, np.arange(900.0), np.nan)
    check(spark.createDataFrame(pdf), pdf, "spearman")


def test_number_of_jobs_does_not_grow_with_the_pairs(spark):
    def jobs(width):
        group = f"jobs-{width}"
        rows = spark.range(400).select(*[F.when(F.xxhash64("id", F.lit(k)) % 5 != 0, F.xxhash64(F.lit(k), "id") % 90).alias(f"c{k}") for k in range(width)])
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert C.correlation_pairs(rows, method="spearman").count() == width * (width - 1) // 2
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    # The broadcast of a join is a job of its own: those grow with the columns (3, 5, 7), not with the pairs (3, 10, 21).
    three, five, seven = jobs(3), jobs(5), jobs(7)
    assert seven - five == five - three


def test_infinities_are_counted_per_pair(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (inf, None, 2.0), (2.0, 3.0, 1.0), (4.0, -1.0, 0.5)], "x double, y double, z double")
    found = {(r["col1"], r["col2"]): r["r"] for r in C.raw_correlations(df).collect()}
    # The infinite x is in no row with y.
    assert found["x", "y"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 3, -1])[0, 1])
    assert found["x", "z"] is None and found["x", "x"] is None and found["y", "z"] is not None
    assert "Generate" not in C.raw_correlations(df)._jdf.queryExecution().toString()


def test_relationship(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, float("nan")), (5, 1.0)], "x int, y double")
    got = C.relationship(df, "x", "y").first()
    assert got["pair_count"] == 3 and got["correlation"] == pytest.approx(np.corrcoef([1, 3, 5], [2, 5, 1])[0, 1], abs=1e-4)
    constant = spark.createDataFrame([(1, 2), (1, 3)], "x int, y int")
    for method in ("pearson", "spearman"):
        assert C.relationship(constant, "x", "y", method).first()["correlation"] is None
        assert C.relationship(constant.limit(0), "x", "y", method).first()["pair_count"] == 0
    with pytest.raises(DatasetError, match="Unknown"):
        C.relationship(df, "x", "y", "kendall")


def test_matrix_shapes(spark):
    df = spark.createDataFrame(random_frame(200))
    matrix = C.correlation_matrix(df)
    nested = C.matrix_rows(matrix).orderBy("i").collect()
    grid = np.array([r["row"] for r in nested])
    assert grid.shape == (5, 5) and np.allclose(grid, grid.T) and np.allclose(np.diag(grid), 1.0)
    wide = C.wide_matrix(matrix, [r["name"] for r in nested]).orderBy("i").collect()
    assert [w["hot"] for w in wide] == list(grid[:, 2])
