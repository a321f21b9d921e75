import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.operators import quantiles as Q

PROBS = [0.25, 0.5, 0.75]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(5)


def skewed(n=20_000):
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(n) < 0.34, 3.5, rng.lognormal(0, 3, n))
    return {
        "hot": hot,
        "uniform": rng.random(n),
        "three": rng.integers(0, 3, n).astype(float),
        "constant": np.full(n, 0.1),
        "signed": rng.normal(0, 1e6, n),
    }


def expect(values):
    return np.quantile(values, PROBS)


def test_small_interpolation(spark):
    df = frame(spark, x=[1.0, 2.0, 4.0, 9.0])
    assert Q.exact_quantiles(df, "x", PROBS) == [1.75, 3.0, 5.25]
    assert Q.exact_quantiles(frame(spark, x=[7.0]), "x", PROBS) == [7.0] * 3


def test_missing_values_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert Q.exact_quantiles(df, "x", [0.5]) == [2.0]
    assert Q.exact_quantiles(df.where("x IS NULL"), "x", [0.5]) is None


@pytest.mark.parametrize("interval_rows", [4_000_000, 300, 20])
def test_column_quantiles_match_numpy(spark, monkeypatch, interval_rows):
    monkeypatch.setattr(Q, "INTERVAL_ROWS", interval_rows)
    data = skewed()
    found = Q.column_quantiles(frame(spark, **data), list(data), PROBS)
    for name, values in data.items():
        np.testing.assert_allclose(found[name], expect(values), rtol=1e-12)


def test_ranks_outside_every_interval_are_found(spark, monkeypatch):
    # Intervals taken from the wrong points: all ranks fall into gaps first.
    monkeypatch.setattr(Q, "_interval_points", lambda ps: [0.9, 0.95, 0.01, 0.02, 0.1, 0.2])
    values = skewed()["signed"]
    found = Q.column_quantiles(frame(spark, x=values), ["x"], PROBS)
    np.testing.assert_allclose(found["x"], expect(values), rtol=1e-12)


@pytest.mark.parametrize("group_rows", [1_000_000, 500])
def test_grouped_quantiles_with_a_dominant_group(spark, group_rows):
    rng = np.random.default_rng(1)
    key = np.where(rng.random(9000) < 0.4, "big", rng.integers(0, 40, 9000).astype(str))
    pdf = pd.DataFrame({"k": key, "v": rng.normal(size=9000)})
    pdf.loc[pdf.k == "7", "k"] = None
    got = Q.grouped_quantiles(spark.createDataFrame(pdf), ["k"], "v", PROBS, group_rows).collect()
    got = {r["k"]: r["quantiles"] for r in got}

    assert len(got) == pdf.k.nunique(dropna=False)
    for k, q in got.items():
        part = pdf[pdf.k.isna()] if k is None else pdf[pdf.k == k]
        np.testing.assert_allclose(q, np.quantile(part.v, PROBS), rtol=1e-12)


def test_partitioning_does_not_matter(spark):
    values = skewed(3000)["hot"]
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    one = Q.exact_quantiles(df.repartition(1), "x", PROBS)
    assert one == Q.exact_quantiles(df.repartition(17), "x", PROBS)
    assert Q.exact_quantiles(df.where(F.col("x") > 1e300), "x", PROBS) is None
