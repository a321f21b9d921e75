"""Linear regression on numeric columns with an exact holdout.

Missing features take the training mean. The fit needs one scan for the training means and one for
the sums of products of the centred training rows, where a filled-in cell is simply zero; what
remains is a features-by-features system. Nearly collinear features take one scan more, for a QR
factor of the rows themselves. Predictions are a plain column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from colsight.errors import DatasetError
from colsight.functions.columns import as_double, col, default_target, numeric_columns, require_numeric
from colsight.functions.local import local_frame
from colsight.functions.missing import drop_missing, is_missing, nan_to_null
from colsight.functions.shared import stored
from colsight.functions.text import round4
from colsight.operators.gram import pairwise_sums, triangular_factor
from colsight.operators.profile import moments
from colsight.operators.quantiles import exact_quantiles
from colsight.operators.split import Split, exact_split

MIN_ROWS = 10
# Columns that the model's result frames add to features and target.
RESERVED = frozenset(("split_hash", "is_test", "actual", "predicted"))
# Directions below this share of the largest eigenvalue carry no information of their own.
RANK_TOLERANCE = 1e-12
# An eigenvalue below this share of the largest has lost half of its digits: the rows are factored instead.
ILL_CONDITIONED = 1e-8
# Singular values of the factor below this share of the largest carry no information of their own.
FACTOR_TOLERANCE = 1e-13
# Squared residuals below this share of the squared values are rounding noise.
ZERO_RESIDUAL = 1e-24


@dataclass
class LinearModel:
    """A fitted model together with the rows it was fitted and tested on."""

    target: str
    features: list[str]
    # None: the feature has no value in the training rows and takes no part.
    weights: list[float | None]
    means: list[float | None]
    intercept: float
    split: Split
    rows: DataFrame = field(repr=False)
    row_key: list[str] = field(default_factory=list)
    # Names in the table of columns that are called like a result; in row frames they end in underscores.
    shown: dict[str, str] = field(default_factory=dict)
    # Deletes the stored rows of a deduplicated table; the model's row frames end with it.
    release: Callable[[], None] = field(default=lambda: None, repr=False)

    def imputed(self) -> DataFrame:
        """Key, features with training means filled in, target, ``split_hash`` and ``is_test``."""
        rows = self.split.apply(self.rows)
        filled = [
            F.coalesce(as_double(f), F.lit(m).cast("double")).alias(f) for f, m in zip(self.features, self.means)
        ]
        kept = [col(c) for c in self.row_key if c not in [self.target, *self.features]]
        return rows.select(*kept, *filled, as_double(self.target).alias(self.target), "split_hash", "is_test")

    def predictions(self) -> DataFrame:
        """The rows of :meth:`imputed` with ``actual`` and ``predicted``."""
        predicted: Column = F.lit(self.intercept)
        for feature, weight in zip(self.features, self.weights):
            if weight is not None:
                predicted = predicted + col(feature) * F.lit(weight)
        return self.imputed().select(
            "*", col(self.target).alias("actual"), predicted.alias("predicted")
        )

    def metrics(self) -> DataFrame:
        """One row: sample counts, holdout and training R2, holdout MAE, RMSE, MSE."""
        return _metrics(self.predictions())

    def median_absolute_error(self) -> DataFrame:
        errors = self.predictions().where("is_test").select(F.abs(F.col("actual") - F.col("predicted")).alias("e"))
        found = exact_quantiles(errors, "e", [0.5])
        return local_frame(self.rows.sparkSession, [(found[0],)], "medae double").select(
            round4(F.col("medae")).alias("medae")
        )

    def median_baseline(self) -> DataFrame:
        """The metrics of predicting the training median everywhere, next to those of the model."""
        predictions = self.predictions()
        median = exact_quantiles(predictions.where("NOT is_test"), "actual", [0.5])[0]
        baseline = _metrics(predictions.withColumn("predicted", F.lit(median)))
        return self.metrics().select(F.lit("linear").alias("model"), "*").unionByName(
            baseline.select(F.lit("median").alias("model"), "*")
        )

    def coefficients(self) -> DataFrame:
        """(rank, position, feature, weight, share_pct), largest absolute weight first.

        ``share_pct`` is the weight's part of the sum of absolute weights; a feature without training
        values has neither.
        """
        raw = [(i, self.shown.get(f, f), w) for i, (f, w) in enumerate(zip(self.features, self.weights))]
        total = sum(abs(w) for w in self.weights if w is not None)
        weighted = local_frame(self.rows.sparkSession, raw, "position int, feature string, w double")
        ranked = weighted.select(
            "position",
            "feature",
            round4(F.col("w")).alias("weight"),
            round4(F.abs("w")).alias("_size"),
            F.round(F.try_divide(F.abs("w") * 100.0, F.lit(total)), 2).alias("share_pct"),
        )
        # One row per feature.
        return ranked.selectExpr(
            "cast(row_number() over (order by _size desc nulls last, position) as int) AS rank",
            "position", "feature", "weight", "share_pct",
        )

    def points(self, n: int = 50) -> DataFrame:
        """(actual, predicted) of the first ``n`` test rows in split order."""
        order = ["split_hash", *[c for c in self.row_key], "actual", "predicted"]
        first = self.predictions().where("is_test").orderBy(*[col(c) for c in order]).limit(n)
        return first.select(round4(F.col("actual")).alias("actual"), round4(F.col("predicted")).alias("predicted"))

    def meta(self) -> DataFrame:
        target, *features = (self.shown.get(c, c) for c in (self.target, *self.features))
        row = (target, features, self.split.train_rows, self.split.test_rows, self.intercept)
        schema = "target_column string, feature_columns array<string>, train_samples long, test_samples long, b double"
        return local_frame(self.rows.sparkSession, [row], schema).select(
            "target_column", "feature_columns", "train_samples", "test_samples", round4(F.col("b")).alias("intercept")
        )

    def weak_signal(self, threshold: float = 0.2) -> DataFrame:
        """One row: holdout R2, the threshold, and whether the model falls below it."""
        return self.metrics().select(
            "r2", F.lit(threshold).alias("threshold"), (F.col("r2") < threshold).alias("weak_signal")
        )

    def record(self) -> DataFrame:
        """Everything in one nested row, ready for a JSON sink."""
        metrics = self.metrics().select(F.struct("r2", "train_r2", "mae", "rmse", "mse"))
        coefficients = self.coefficients().agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "feature", "weight"))),
                lambda c: F.struct(c["feature"].alias("feature"), c["weight"].alias("weight")),
            )
        )
        points = self.points().agg(F.collect_list(F.struct("actual", "predicted")))
        return self.meta().select(
            "*",
            metrics.scalar().alias("metrics"),
            coefficients.scalar().alias("coefficients"),
            points.scalar().alias("chart_points"),
        )


def prediction_bounds(points: DataFrame) -> DataFrame:
    """One row: smallest and largest value over actual and predicted, and their distance (1 if none)."""
    low, high = F.min(F.least("actual", "predicted")), F.max(F.greatest("actual", "predicted"))
    return points.agg(low.alias("low"), high.alias("high")).select(
        "low", "high", F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low")).alias("range")
    )


def feature_columns(df: DataFrame, target: str, features: Sequence[str] | None = None) -> list[str]:
    """Check target and features; without explicit features, take all other numeric columns."""
    if target not in df.columns:
        raise DatasetError(f"There is no column '{target}' to use as target.")
    if target not in numeric_columns(df):
        raise DatasetError(f"The target '{target}' is not numeric.")
    if features is None:
        chosen = [c for c in numeric_columns(df) if c != target]
    else:
        chosen = list(features)
        for name in chosen:
            require_numeric(df, name, "Feature column")
        if target in chosen:
            raise DatasetError(f"The target '{target}' is also among the features.")
        if len(set(chosen)) < len(chosen):
            raise DatasetError("A feature column is named twice.")
    if not chosen:
        raise DatasetError("There is no numeric column left to use as feature.")
    return chosen


def modelling_rows(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    key: Sequence[str] = (),
    deduplicate: bool = False,
) -> DataFrame:
    """Key, features and target, rows without a target left out.

    ``deduplicate`` keeps one row of each set of identical features and target, with the smallest key.
    """
    extra = [c for c in key if c not in features and c != target]
    cells = [col(c) for c in [*features, target]]
    rows = drop_missing(nan_to_null(df.select(*[col(c) for c in extra], *cells)), [target])
    if not deduplicate:
        return rows
    if not extra:
        return rows.distinct()
    smallest = F.min(F.struct(*[col(c) for c in extra])).alias("_key")
    return rows.groupBy(*cells).agg(smallest).select("_key.*", *cells)


def training_checks(df: DataFrame, target: str, test_size: float = 0.2) -> DataFrame:
    """One row: rows with a target, whether they are enough, and whether both sides of a split hold any."""
    usable = F.count_if(~is_missing(target, df.schema[target].dataType))
    test = F.ceil(F.col("usable_rows") * F.lit(test_size))
    return df.agg(usable.alias("usable_rows")).select(
        "usable_rows",
        (F.col("usable_rows") >= MIN_ROWS).alias("enough_rows"),
        ((test > 0) & (test < F.col("usable_rows"))).alias("both_sides"),
    )


def train_means(rows: DataFrame, split: Split, features: Sequence[str]) -> DataFrame:
    """(position, name, count, mean, ...) of the features over the training rows."""
    return moments(split.apply(rows).where("NOT is_test"), list(features))


def fit_linear_regression(
    df: DataFrame,
    target: str | None = None,
    features: Sequence[str] | None = None,
    key: Sequence[str] = (),
    test_size: float = 0.2,
    seed: int = 42,
    ridge: float = 0.0,
    deduplicate: bool = False,
) -> LinearModel:
    """Least squares with intercept, or ridge with penalty ``ridge`` on the unscaled weights.

    The target defaults to the last numeric column. With collinear features the weights of smallest
    norm are taken. Columns may have any name. With ``deduplicate`` the rows are stored once, until ``release`` of the
    model. Give a unique ``key`` where there is one: it makes the split cheap to recompute
    and the order of the points meaningful.
    """
    target = target if target is not None else default_target(df)
    features = feature_columns(df, target, features)
    named = {c: c for c in (*features, target, *key)}
    for c in RESERVED.intersection(named):
        while named[c] in RESERVED.union(set(named) - {c}, df.columns):
            named[c] += "_"
    shown = {inner: c for c, inner in named.items() if inner != c}
    df = df.select(*[col(c).alias(inner) for c, inner in named.items()])
    target, features, key = named[target], [named[c] for c in features], [named[c] for c in key]
    rows, release = modelling_rows(df, target, features, key, deduplicate), lambda: None
    if deduplicate:
        # Every scan of the model would shuffle the table again.
        rows, release = stored(rows, "deduplicated")
    try:
        split = exact_split(rows, key, test_size, seed)
        total = split.test_rows + split.train_rows
    except DatasetError:
        total = rows.count()
        if total >= MIN_ROWS:
            raise
    if total < MIN_ROWS:
        raise DatasetError(
            f"At least {MIN_ROWS} rows with a target are needed; there are {total}."
        )

    stats = {r["name"]: r for r in train_means(rows, split, [*features, target]).collect()}
    for name in [*features, target]:
        if stats[name]["count"] and not math.isfinite(stats[name]["max"] - stats[name]["min"]):
            raise DatasetError(f"Column '{shown.get(name, name)}' holds infinite values.")
    used = [f for f in features if stats[f]["count"]]
    if not used:
        raise DatasetError("No feature column holds a value in the training rows.")
    # The mean of a constant may be off in its last digit; its value is not.
    centres = [s["min"] if s["min"] == s["max"] else s["mean"] for s in (stats[c] for c in [*used, target])]
    products = np.zeros((len(centres), len(centres)))
    train = split.apply(rows).where("NOT is_test")
    for row in pairwise_sums(train, [*used, target], centres).collect():
        products[row["i"], row["j"]] = products[row["j"], row["i"]] = row["sxy"]
    if not ridge and ill_conditioned(products[:-1, :-1]):
        solved = solve_factor(triangular_factor(train, [*used, target], centres))
    else:
        solved = solve(products[:-1, :-1], products[:-1, -1], ridge)
    weight_of = dict(zip(used, (float(w) for w in solved)))
    mean_of = dict(zip(used, centres))
    intercept = centres[-1] - sum(weight_of[f] * mean_of[f] for f in used)
    return LinearModel(
        target,
        features,
        [weight_of.get(f) for f in features],
        [mean_of.get(f) for f in features],
        float(intercept),
        split,
        rows,
        list(key),
        shown,
        release,
    )


def solve(products: np.ndarray, with_target: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Weights from the centred sums of products (features by features, a small local matrix)."""
    if ridge:
        return np.linalg.solve(products + ridge * np.eye(len(products)), with_target)
    scale = np.sqrt(np.diag(products))
    varying = scale > 0
    weights = np.zeros(len(products))
    if not varying.any():
        return weights
    scale = scale[varying]
    scaled = products[np.ix_(varying, varying)] / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(scaled)
    informative = values > RANK_TOLERANCE * len(values) * values[-1]
    basis = vectors[:, informative]
    found = basis @ ((basis.T @ (with_target[varying] / scale)) / values[informative]) / scale
    if not informative.all():
        # Directions that change no prediction, in the units of the features: remove what lies in them.
        idle = np.linalg.qr(vectors[:, ~informative] / scale[:, None])[0]
        found = found - idle @ (idle.T @ found)
    weights[varying] = found
    return weights


def ill_conditioned(products: np.ndarray) -> bool:
    scale = np.sqrt(np.diag(products))
    varying = scale > 0
    if not varying.any():
        return False
    values = np.linalg.eigvalsh(products[np.ix_(varying, varying)] / np.outer(scale[varying], scale[varying]))
    return bool(values[0] < ILL_CONDITIONED * values[-1])


def solve_factor(factor: np.ndarray) -> np.ndarray:
    """Weights from the triangular factor of features and target (last)."""
    features, target = factor[:, :-1], factor[:, -1]
    scale = np.sqrt((features**2).sum(axis=0))
    varying = scale > 0
    weights, scale = np.zeros(len(scale)), scale[varying]
    left, values, right = np.linalg.svd(features[:, varying] / scale, full_matrices=False)
    informative = values > FACTOR_TOLERANCE * len(values) * values[0]
    found = right[informative].T @ ((left.T @ target)[informative] / values[informative]) / scale
    if not informative.all():
        idle = np.linalg.qr(right[~informative].T / scale[:, None])[0]
        found = found - idle @ (idle.T @ found)
    weights[varying] = found
    return weights


def _metrics(predictions: DataFrame) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    sides = predictions.groupBy("is_test").agg(
        F.count("*").alias("n"),
        F.sum(error * error).alias("ss_res"),
        (F.var_pop("actual") * F.count("*")).alias("ss_tot"),
        F.sum(F.col("actual") * F.col("actual")).alias("ss_raw"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
    )
    constant = F.when(F.col("ss_res") <= ZERO_RESIDUAL * F.col("ss_raw"), 1.0).otherwise(0.0)
    r2 = F.when(F.col("ss_tot") == 0.0, constant).otherwise(1.0 - F.try_divide("ss_res", "ss_tot"))

    def side(test: bool, value: Column) -> Column:
        return F.max(F.when(F.col("is_test") == test, value))

    return sides.agg(
        side(False, F.col("n")).alias("train_samples"),
        side(True, F.col("n")).alias("test_samples"),
        round4(side(True, r2)).alias("r2"),
        round4(side(False, r2)).alias("train_r2"),
        round4(side(True, F.col("mae"))).alias("mae"),
        round4(F.sqrt(side(True, F.col("mse")))).alias("rmse"),
        round4(side(True, F.col("mse"))).alias("mse"),
    )
