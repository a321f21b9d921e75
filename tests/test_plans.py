"""What the physical plans must look like, whatever the data size."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from colsight.operators import correlation, explore, profile
from colsight.operators.split import exact_split

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{FOLDER}/orders.parquet")


def test_filters_and_columns_reach_the_scan(orders):
    filters = [explore.between("o_totalprice", 1000, 2000), explore.one_of("o_orderstatus", ["F"])]
    text = plan(explore.grouped_aggregate(explore.apply_filters(orders, filters), ["o_orderstatus"], "o_totalprice", median=False))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["o_orderstatus:string,o_totalprice:double"]


def test_split_membership_needs_no_shuffle(orders):
    rows = orders.select("o_orderkey")
    text = plan(exact_split(rows, ["o_orderkey"]).apply(rows).where("is_test"))
    assert "Exchange" not in text and "Sort" not in text


def test_counts_and_distinct_values_stay_in_the_engine(orders):
    for df in (profile.dataset_overview(orders), profile.profile_columns(orders)):
        text = plan(df)
        assert "Python" not in text and "Arrow" not in text and "SortAggregate" not in text


def jobs(spark, run):
    """Number of jobs of a run."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_number_of_jobs_does_not_depend_on_the_columns(spark, orders, tmp_path):
    def wide(width):
        return orders.select(*[(F.col("o_totalprice") * k).alias(f"c{k}") for k in range(1, width + 1)])

    assert jobs(spark, lambda: profile.moments(wide(3))) == jobs(spark, lambda: profile.moments(wide(30)))
    assert jobs(spark, lambda: profile.describe_numeric(wide(3))) == jobs(spark, lambda: profile.describe_numeric(wide(30)))
    assert jobs(spark, lambda: correlation.raw_correlations(wide(3))) == jobs(spark, lambda: correlation.raw_correlations(wide(30)))
    wide(30).coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    lines = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv"))
    assert jobs(spark, lambda: profile.describe_numeric(lines)) == jobs(spark, lambda: profile.describe_numeric(lines.select("c1", "c2")))


def test_rank_limit_is_applied_before_the_shuffle(orders):
    text = plan(explore.top_categories(orders))
    assert text.count("WindowGroupLimit") == 2


def test_sums_of_products_are_added_by_task(spark, orders):
    from colsight.operators.gram import pairwise_sums

    text = plan(pairwise_sums(orders, ["o_custkey", "o_totalprice"], [0.0, 0.0]))
    assert text.index("partial_sum") < text.index("MapInArrow") and "BatchEvalPython" not in text


def test_no_cartesian_products(spark, orders):
    frames = [
        correlation.relationship(orders, "o_custkey", "o_totalprice", "spearman"),
        explore.date_coverage(orders, "o_orderdate"),
        explore.category_shares(orders, "o_orderstatus"),
        explore.category_concentration(orders, "o_orderpriority"),
        explore.duplicate_rows(orders),
        orders.select(F.lit(1)),
    ]
    for df in frames:
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
