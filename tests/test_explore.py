import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.errors import DatasetError
from colsight.operators import explore as E
from colsight.operators.ranks import MOST_SMALL, in_order


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame(
        {
            "store": rng.choice(["n", "s", "w"], n, p=[0.7, 0.2, 0.1]),
            "amount": rng.lognormal(3, 1, n).round(2),
            "day": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n) * 2, unit="D"),
        }
    )
    pdf.loc[::11, "amount"] = np.nan
    pdf.loc[::50, "store"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("day", F.col("day").cast("timestamp_ntz")).repartition(6)


def test_filters(sales):
    pdf, df = sales
    filters = [E.between("amount", 10, 60), E.one_of("store", ["n", "w"]), E.between("day", low=dt.datetime(2024, 1, 10))]
    want = pdf[pdf.amount.between(10, 60) & pdf.store.isin(["n", "w"]) & (pdf.day >= "2024-01-10")]
    assert E.apply_filters(df, filters).count() == E.apply_filters(df, filters * 5).count() == len(want)
    assert E.apply_filters(df, [E.one_of("store", [*map(str, range(500)), "n"])]).count() == (pdf.store == "n").sum()
    counts = E.filter_counts(df, [E.one_of("store", ["n"])], "amount").first()
    part = pdf[pdf.store == "n"]
    assert tuple(counts) == (400, len(part), part.amount.count())
    for bad in (lambda: E.between("amount"), lambda: E.one_of("store", [])):
        with pytest.raises(DatasetError):
            bad()


def test_grouped_aggregate(sales):
    pdf, df = sales
    got = {r["store"]: r for r in E.grouped_aggregate(df, ["store"], "amount").collect()}
    want = pdf.groupby("store").amount.agg(["count", "sum", "mean", "median", "min", "max"])
    assert set(got) == set(want.index)
    for store, row in want.iterrows():
        assert [got[store][c] for c in want.columns] == pytest.approx(list(row), abs=1e-4)
    assert "median" not in E.grouped_aggregate(df, ["store", "day"], "amount", median=False).columns


def test_trend_shows_empty_periods(sales):
    pdf, df = sales
    trend = E.date_trend(df, "day", "amount", "day")
    rows = {r["period_start"]: r for r in trend.collect()}
    days = pd.date_range(pdf.day.min(), pdf.day.max())
    assert sorted(rows) == [d.to_pydatetime() for d in days]
    daily = pdf.groupby("day").amount.agg(["count", "mean"])
    empty = [r for r in rows.values() if r["count"] == 0]
    assert len(empty) >= 39 and all(r["mean"] is None for r in empty)
    peak, trough = daily["mean"].idxmax(), daily["mean"].idxmin()
    extremes = E.time_extremes(trend).first()
    assert (extremes["peak_period"], extremes["trough_period"]) == (peak, trough)
    assert extremes["peak_value"] == pytest.approx(daily["mean"].max(), abs=1e-4)
    for period in ("month", "quarter", "week", "year"):
        total = E.date_trend(df, "day", "amount", period).agg(F.sum("count")).first()[0]
        assert total == pdf.amount.count()
    few = E.chart_points(trend, 10).orderBy("period_start").collect()
    assert len(few) == 10 and few[0]["period_start"] == days[0] and few[-1]["period_start"] == days[-1]
    assert E.chart_points(trend).count() == len(days)
    minutes = E.date_trend(df, "day", "amount", "minute")
    assert minutes.count() == (len(days) - 1) * 1440 + 1 and minutes.agg(F.sum("count")).first()[0] == pdf.amount.count()
    with pytest.raises(DatasetError, match="Unknown period"):
        E.date_trend(df, "day", "amount", "eon")


@pytest.mark.parametrize("bucket_rows", [200_000, 20])
def test_date_coverage(spark, bucket_rows):
    rng = np.random.default_rng(2)
    stamps = pd.Series(pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**6, 700), unit="s"))
    stamps = pd.concat([stamps, pd.Series([stamps[0]] * 300)])
    df = spark.createDataFrame(pd.DataFrame({"t": stamps})).withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = E.date_coverage(df, "t", bucket_rows).first()
    unique = np.sort(stamps.unique())
    assert got["unique_observations"] == len(unique)
    assert got["median_spacing_seconds"] == pytest.approx(np.median(np.diff(unique)) / np.timedelta64(1, "s"))
    assert got["span_days"] == (stamps.max().normalize() - stamps.min().normalize()).days
    assert got["first_date"] == stamps.min()
    days = df.select(F.col("t").cast("date").alias("d"))
    assert E.date_coverage(days, "d").first()["median_spacing_seconds"] == 86400.0
    with pytest.raises(DatasetError, match="no dates"):
        E.date_coverage(df.limit(0), "t")


def test_small_ranges_of_many_dates_stay_few(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(E, "in_order", lambda *given: asked.append(given[-1]) or in_order(*given[:-1], 3))
    df = spark.range(60_000).select(F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("t"))
    got = E.date_coverage(df, "t", 100).first()
    assert asked == [MOST_SMALL]
    assert (got["unique_observations"], got["median_spacing_seconds"]) == (60_000, 7.0)


def test_categories(sales):
    pdf, df = sales
    counts = pdf.store.value_counts()
    top = E.top_categories(df, k=2).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == list(counts.head(2).items())
    shares = E.category_shares(df, "store").orderBy("rank").collect()
    assert shares[-1]["cumulative_pct"] == 100.0 and shares[0]["share_pct"] == round(100 * counts.iloc[0] / counts.sum(), 2)


@pytest.mark.parametrize("share", [0.1, 0.5, 0.7, 1.0])
def test_concentration(spark, share):
    sizes = [40, 40, 30, 10, 10, 10, 5, 1, 1, 1]
    df = spark.createDataFrame([(f"k{i}",) for i, n in enumerate(sizes) for _ in range(n)] + [(None,)], "c string")
    got = E.category_concentration(df, "c", share).first()
    covered = np.cumsum(sizes)
    needed = int(np.argmax(covered >= share * sum(sizes) - 1e-9)) + 1
    assert (got["category_count"], got["categories_needed"]) == (10, needed)
    assert got["covered_pct"] == pytest.approx(100 * covered[needed - 1] / sum(sizes), abs=0.01)


def test_outliers_and_histogram(sales):
    pdf, df = sales
    x = pdf.amount.dropna()
    q1, q3 = x.quantile([0.25, 0.75])
    got = E.outlier_counts(df).first()
    assert got["iqr_outliers"] == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
    assert got["z_outliers"] == (((x - x.mean()) / x.std(ddof=0)).abs() > 3).sum()
    bins = E.histogram(df, bins=8).orderBy("bin").collect()
    assert [b["count"] for b in bins] == list(np.histogram(x, 8)[0])
    flat = df.select(F.lit(2.0).alias("c"))
    assert [b["count"] for b in E.histogram(flat, bins=3).orderBy("bin").collect()] == [400, 0, 0]
    assert E.outlier_counts(flat).first()["z_outliers"] == 0
    assert E.outlier_counts(df.select("store")).count() == 0


def test_duplicates(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 1.0), (2, 1.0), (2, 1.0)], "a int, b double")
    assert tuple(E.duplicate_rows(df).first()) == (5, 2, 3)
    assert tuple(E.duplicate_rows(df.limit(0)).first()) == (0, 0, 0)


def test_zone_free_dates_ignore_the_session_zone(spark):
    """02:30 does not exist on 2024-03-10 in New York, but it does without a zone."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = ["2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-03-10 04:00:00.5"]
        df = spark.createDataFrame([(t, 1.0) for t in times], "s string, x double").selectExpr("cast(s as timestamp_ntz) AS t", "x")
        trend = {str(r["period_start"]): r["count"] for r in E.date_trend(df, "t", "x", "hour").collect()}
        assert trend == {"2024-03-10 01:00:00": 1, "2024-03-10 02:00:00": 1, "2024-03-10 03:00:00": 0, "2024-03-10 04:00:00": 1}
        assert E.date_coverage(df, "t").first()["median_spacing_seconds"] == (3600 + 5400.5) / 2
        for period, starts in (("day", ["2024-03-10"]), ("week", ["2024-03-04"]), ("month", ["2024-03-01"]), ("quarter", ["2024-01-01"]), ("year", ["2024-01-01"])):
            assert [str(r["period_start"])[:10] for r in E.date_trend(df, "t", "x", period).collect()] == starts
        zoned = df.selectExpr("cast(date_add(date'2024-03-09', cast(row_number() over (order by t) as int)) as timestamp) AS t", "x")
        assert [r["count"] for r in E.date_trend(zoned, "t", "x", "day").collect()] == [1, 1, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_top_categories_without_text_columns(spark):
    assert E.top_categories(spark.range(3)).count() == 0


@pytest.mark.parametrize("broadcast_hashes", [0, 1000])
def test_duplicates_of_many_types(spark, broadcast_hashes):
    rows = [(k % 5, -0.0 if k % 2 else 0.0, None if k % 3 else float("nan"), {"b": k % 2, "a": 1}, [k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "i int, x double, y float, m map<string,int>, a array<int>")
    want = len({(r[0], r[3]["b"]) for r in rows})
    assert tuple(E.duplicate_rows(df, broadcast_hashes).first()) == (60, want, 60 - want)
    assert tuple(E.duplicate_rows(df.limit(0)).first()) == (0, 0, 0)


def test_repeated_rows_are_compared_in_full(spark, monkeypatch):
    # Hashes that all collide change nothing.
    monkeypatch.setattr(E.F, "xxhash64", lambda *cells: F.lit(7).cast("long"))
    df = spark.createDataFrame([(k % 10, k % 4) for k in range(50)], "a int, b int")
    assert tuple(E.duplicate_rows(df).first()) == (50, 20, 30)
