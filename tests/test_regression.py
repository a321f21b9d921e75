import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.errors import DatasetError
from colsight.operators import regression as G


def weights(model):
    return {r["feature"]: r["weight"] for r in model.coefficients().collect()}


def sides(model):
    rows = model.predictions().toPandas()
    return rows[~rows.is_test], rows[rows.is_test]


def lstsq(train, features, target="y"):
    x = np.column_stack([np.ones(len(train)), *[train[f] for f in features]])
    return np.linalg.lstsq(x, train[target], rcond=None)[0]


def noisy(n=100, seed=42):
    rng = np.random.default_rng(seed)
    x1, x2 = np.linspace(1, 10, n), rng.normal(5, 1, n)
    return pd.DataFrame({"id": range(n), "x1": x1, "x2": x2, "y": 3 * x1 + 2 * x2 + 5 + rng.normal(0, 0.2, n)})


def test_recovers_weights_and_metrics(spark):
    df = spark.createDataFrame(noisy())
    model = G.fit_linear_regression(df, "y", ["x1", "x2"], key=["id"])
    train, test = sides(model)
    want = lstsq(train, ["x1", "x2"])
    np.testing.assert_allclose([model.intercept, *model.weights], want, rtol=1e-9)
    got = model.metrics().first()
    error = test.actual - test.predicted
    assert (got["train_samples"], got["test_samples"]) == (80, 20)
    assert got["r2"] > 0.95 and got["mae"] < 1.0
    assert got["r2"] == pytest.approx(1 - (error**2).sum() / ((test.actual - test.actual.mean()) ** 2).sum(), abs=1e-4)
    assert got["mae"] == pytest.approx(error.abs().mean(), abs=1e-4)
    assert got["rmse"] == pytest.approx((error**2).mean() ** 0.5, abs=1e-4)
    assert abs((train.actual - train.predicted).sum()) < 1e-8
    assert model.points().count() == 20 and model.points(7).count() == 7
    assert model.median_absolute_error().first()["medae"] == pytest.approx(error.abs().median(), abs=1e-4)
    table = {r["model"]: r for r in model.median_baseline().collect()}
    assert table["median"]["mae"] == pytest.approx((test.actual - train.actual.median()).abs().mean(), abs=1e-4)
    assert table["linear"]["mae"] == got["mae"]


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(noisy())
    a = G.fit_linear_regression(df.repartition(1), "y", key=["id"])
    b = G.fit_linear_regression(df.repartition(17), "y", key=["id"])
    np.testing.assert_allclose(a.weights, b.weights, rtol=1e-9)
    assert a.metrics().first() == b.metrics().first()


def test_imputation_uses_training_rows_only(spark):
    pdf = pd.DataFrame({"id": range(50), "x": np.linspace(1, 10, 50)})
    pdf["y"] = 2 * pdf.x + 1
    pdf.loc[[2, 11, 30], "x"] = np.nan
    model = G.fit_linear_regression(spark.createDataFrame(pdf), "y", ["x"], key=["id"])
    train, _ = sides(model)
    seen = pdf[pdf.id.isin(train.id)]
    assert model.means[0] == pytest.approx(seen.x.mean())
    np.testing.assert_allclose([model.intercept, *model.weights], lstsq(seen.fillna({"x": seen.x.mean()}), ["x"]), rtol=1e-9)
    assert model.metrics().first()["r2"] > 0.8


def test_collinear_features_take_the_smallest_norm(spark):
    pdf = noisy()
    pdf["x3"] = 2 * pdf.x1
    pdf["flat"] = 0.1
    model = G.fit_linear_regression(spark.createDataFrame(pdf), "y", ["x1", "x2", "x3", "flat"], key=["id"])
    train, _ = sides(model)
    centred = train[["x1", "x2", "x3", "flat"]] - train[["x1", "x2", "x3", "flat"]].mean()
    want = np.linalg.pinv(centred.values, rcond=1e-10) @ (train.actual - train.actual.mean())
    np.testing.assert_allclose(model.weights, want, atol=1e-8)


def test_feature_without_training_values(spark):
    pdf = noisy().assign(gone=np.nan)
    model = G.fit_linear_regression(spark.createDataFrame(pdf), "y", ["gone", "x1", "x2"], key=["id"])
    assert weights(model)["gone"] is None
    plain = G.fit_linear_regression(spark.createDataFrame(pdf), "y", ["x1", "x2"], key=["id"])
    assert weights(model)["x1"] == weights(plain)["x1"] and model.metrics().first() == plain.metrics().first()


def test_constant_target(spark):
    pdf = noisy().assign(y=0.1)
    got = G.fit_linear_regression(spark.createDataFrame(pdf), "y", ["x1"], key=["id"]).metrics().first()
    assert got["r2"] == 1.0 and got["train_r2"] == 1.0


def test_ridge_and_ratio(spark):
    pdf = noisy()
    model = G.fit_linear_regression(spark.createDataFrame(pdf), "y", ["x1", "x2"], ["id"], test_size=0.3, ridge=1.0)
    train, test = sides(model)
    assert len(test) == 30
    x = (train[["x1", "x2"]] - train[["x1", "x2"]].mean()).values
    want = np.linalg.solve(x.T @ x + np.eye(2), x.T @ (train.actual - train.actual.mean()))
    np.testing.assert_allclose(model.weights, want, rtol=1e-9)


def test_deduplicated_rows(spark):
    pdf = pd.concat([noisy()] * 3, ignore_index=True)
    pdf["id"] = range(len(pdf))
    df = spark.createDataFrame(pdf)
    model = G.fit_linear_regression(df, "y", ["x1", "x2"], key=["id"], deduplicate=True)
    assert model.split.test_rows + model.split.train_rows == 100
    assert model.predictions().agg(F.max("id")).first()[0] == 99


def test_without_key(spark):
    pdf = noisy().drop(columns="id")
    df = spark.createDataFrame(pd.concat([pdf, pdf.head(1), pdf.head(1)]))
    model = G.fit_linear_regression(df)
    got = model.metrics().first()
    assert model.target == "y" and (got["train_samples"], got["test_samples"]) == (81, 21)
    record = model.record().first()
    assert record["feature_columns"] == ["x1", "x2"] and len(record["chart_points"]) == 21
    assert [c["feature"] for c in record["coefficients"]] == ["x1", "x2"]
    assert model.weak_signal().first()["weak_signal"] is False


def test_bounds(spark):
    points = spark.createDataFrame([(1.0, 2.5), (-3.0, 0.0)], "actual double, predicted double")
    assert tuple(G.prediction_bounds(points).first()) == (-3.0, 2.5, 5.5)
    flat = spark.createDataFrame([(1.0, 1.0)], "actual double, predicted double")
    assert G.prediction_bounds(flat).first()["range"] == 1.0


def test_errors(spark):
    df = spark.createDataFrame([(1, "a", 2)] * 3, "x int, cat string, y int")
    fit = G.fit_linear_regression
    with pytest.raises(DatasetError, match="not numeric"):
        fit(df, "cat")
    with pytest.raises(DatasetError, match="There is no column"):
        fit(df, "nope")
    with pytest.raises(DatasetError, match="Feature column 'cat' is not numeric"):
        fit(df, "y", ["cat"])
    with pytest.raises(DatasetError, match="does not exist"):
        fit(df, "y", ["nope"])
    with pytest.raises(DatasetError, match="no numeric column left"):
        fit(df, "y", [])
    with pytest.raises(DatasetError, match="also among"):
        fit(df, "y", ["y"])
    with pytest.raises(DatasetError, match="twice"):
        fit(df, "y", ["x", "x"])
    with pytest.raises(DatasetError, match="At least 10 rows"):
        fit(df, "y")
    with pytest.raises(DatasetError, match="At least 10 rows"):
        fit(df.where("x > 5"), "y")
    endless = spark.range(20).select("id", F.lit(float("inf")).alias("x"), F.col("id").alias("y"))
    with pytest.raises(DatasetError, match="infinite"):
        fit(endless, "y", ["x"], ["id"])


def test_columns_called_like_results(spark):
    df = spark.createDataFrame([(k, float(k % 7), 2.0 * (k % 7) + k % 3) for k in range(60)], "id long, x double, y double")
    plain = G.fit_linear_regression(df, "y", ["x"], key=["id"])
    renamed = df.select(F.col("id").alias("split_hash"), F.col("x").alias("predicted"), F.col("y").alias("is_test"))
    odd = G.fit_linear_regression(renamed, "is_test", ["predicted"], key=["split_hash"])
    assert odd.coefficients().first()["feature"] == "predicted" and odd.meta().first()["target_column"] == "is_test"
    assert odd.coefficients().first()["weight"] == plain.coefficients().first()["weight"]
    assert odd.metrics().collect() == plain.metrics().collect() and odd.points().collect() == plain.points().collect()
    assert {"predicted_", "is_test_", "split_hash_", "predicted", "is_test"} < set(odd.predictions().columns)


def test_nearly_collinear_features(spark):
    rng = np.random.default_rng(2)
    x, z = rng.integers(1, 50, 4000).astype(float), rng.integers(0, 100, 4000)
    y = 3.0 * x + 5.0 * z + rng.normal(size=4000)
    pdf = pd.DataFrame({"id": np.arange(4000), "x": x, "near": x + z * 2.0**-26, "y": y})
    model = G.fit_linear_regression(spark.createDataFrame(pdf).repartition(5), "y", ["x", "near"], key=["id"])
    train = model.predictions().where("NOT is_test").select("id").toPandas()["id"].to_numpy()
    a = np.column_stack([x, z, np.ones(4000)])[train]
    want = np.linalg.lstsq(a, y[train], rcond=None)[0]
    assert sum(model.weights) == pytest.approx(want[0], rel=1e-4) and model.weights[1] * 2.0**-26 == pytest.approx(want[1], rel=1e-5)


def test_deduplicated_rows_are_stored_once(spark):
    df = spark.createDataFrame([(k, float(k % 40), 2.0 * (k % 40)) for k in range(200)], "id long, x double, y double")
    model = G.fit_linear_regression(df, "y", ["x"], key=["id"], deduplicate=True)
    assert model.split.train_rows + model.split.test_rows == 40
    # The aggregate of the deduplication is not part of the model's scans.
    assert "HashAggregate" not in model.predictions()._jdf.queryExecution().executedPlan().toString()
    assert model.metrics().first()["r2"] == 1.0
    model.release()
