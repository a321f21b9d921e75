import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from colsight.operators import profile as P


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def mixed(spark):
    return spark.createDataFrame(
        [(1.0, "a", None, True), (float("nan"), "b", None, False), (None, "a", None, True), (3.0, "b", None, True)],
        "num double, cat string, empty double, flag boolean",
    )


def test_overview_counts_nan_and_null(spark):
    got = rows(P.dataset_overview(mixed(spark)))[0]
    assert got["row_count"] == 4 and got["column_count"] == 4
    assert got["numeric_count"] == 3 and got["categorical_count"] == 1
    assert got["total_missing"] == 6 and got["missing_cell_pct"] == 37.5


def test_overview_of_an_empty_table(spark):
    got = rows(P.dataset_overview(spark.createDataFrame([], "a int")))[0]
    assert (got["row_count"], got["total_missing"], got["missing_cell_pct"]) == (0, 0, 0.0)


def test_profile_columns(spark):
    got = rows(P.profile_columns(mixed(spark)), "position")
    assert [r["missing_count"] for r in got] == [2, 0, 4, 0]
    assert [r["missing_pct"] for r in got] == [50.0, 0.0, 100.0, 0.0]
    assert [r["unique_count"] for r in got] == [2, 2, 0, 2]
    assert [r["is_numeric"] for r in got] == [True, False, True, True]
    labels = rows(P.profile_columns(mixed(spark), labels="pandas"), "position")
    assert [r["dtype"] for r in labels] == ["float64", "object", "float64", "bool"]


def test_describe_skips_columns_without_values(spark):
    got = {r["name"]: r for r in rows(P.describe_numeric(mixed(spark)), "position")}
    assert set(got) == {"num", "flag"}
    assert (got["num"]["mean"], got["num"]["count"], got["num"]["median"]) == (2.0, 2.0, 2.0)
    single = rows(P.describe_numeric(spark.createDataFrame([(5,)], "x int")))[0]
    assert single["std"] == 0.0 and single["q25"] == 5.0 == single["q75"]


def test_describe_matches_pandas_over_many_columns(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({f"c{i}": rng.normal(i, i + 1, 500) for i in range(20)})
    pdf.loc[::7, "c3"] = np.nan
    expected = pdf.describe().T.round(4)
    for r in P.describe_numeric(spark.createDataFrame(pdf)).collect():
        want = expected.loc[r["name"]]
        np.testing.assert_allclose(
            [r[c] for c in ("count", "mean", "std", "min", "q25", "median", "q75", "max")], want.values, atol=1.01e-4
        )


def test_distinct_counts_of_many_types(spark):
    df = spark.sql(
        "SELECT id % 3 AS l, cast(id % 5 AS int) AS i, cast(id % 4 AS float) AS f, cast(id % 2 AS string) AS s,"
        " timestamp_ntz'2024-01-01' + make_dt_interval(id % 7) AS t, array(id % 6) AS a, id % 2 = 0 AS b,"
        " cast(NULL AS date) AS d FROM range(100)"
    )
    got = {r["position"]: r["distinct"] for r in P.distinct_counts(df).collect()}
    assert got == {0: 3, 1: 5, 2: 4, 3: 2, 4: 7, 5: 6, 6: 2}
    approximate = {r["position"]: r["distinct"] for r in P.approx_distinct_counts(df.drop("d")).collect()}
    assert approximate == got


def test_preview(spark):
    df = spark.range(50).select(F.col("id"), F.when(F.col("id") != 2, 1.0).otherwise(F.lit(float("nan"))).alias("x"))
    got = P.preview_rows(df.repartition(7), ["id"]).collect()
    assert [r["id"] for r in got] == list(range(10)) and got[2]["x"] is None
    assert P.preview_rows(df, n=4).count() == 4
