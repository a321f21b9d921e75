"""Queries over the standard tables, each next to SQL that states the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colsight.functions.columns import col
from colsight.functions.local import local_frame
from colsight.functions.missing import tokens_to_null
from colsight.functions.shared import shared_folder
from colsight.operators import correlation, explore, profile, regression
from colsight.operators.split import exact_split
from colsight.plans import report
from colsight.plans.analysis import analyse
from colsight.sources import csv
from colsight.sources.checks import shape
from colsight.sources.inference import infer_types

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        REGISTRY[name] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Derived tables --------------------------------------------------------------------------------

LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
ORDERS_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
PART_TYPES = {
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
    "p_retailprice": "double",
}
EVENTS_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "props": "string",
}
GAPPY_TYPES = {
    "l_orderkey": "bigint", "l_quantity": "double", "discount": "double", "tax": "double", "nothing": "double",
    "flag": "string",
}
GAPPY_SQL = """(SELECT l_orderkey, l_quantity, nullif(l_discount, 0.0) AS discount,
  CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE nullif(l_tax, 0.0) END AS tax,
  CAST(NULL AS DOUBLE) AS nothing, nullif(l_returnflag, 'R') AS flag FROM lineitem)"""


def gappy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with NULLs, NaNs and a column without values."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.nullif("l_tax", F.lit(0.0))).alias("tax"),
        F.lit(None).cast("double").alias("nothing"),
        F.nullif("l_returnflag", F.lit("R")).alias("flag"),
    )


ODD_TYPES = {
    "p_partkey": "bigint", "size": "int", "price": "double", "single": "double", "flat": "double", "cheap": "boolean",
}
ODD_SQL = """(SELECT p_partkey, nullif(p_size, 7) AS size,
  CASE WHEN p_size = 9 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS price,
  CASE WHEN p_partkey = 0 THEN p_retailprice END AS single,
  CASE WHEN p_size > 25 THEN CAST(0.1 AS DOUBLE) WHEN p_size = 7 THEN CAST(3 AS DOUBLE) END AS flat,
  p_retailprice < 910 AS cheap FROM part)"""


def odd_part(spark: SparkSession, folder: str) -> DataFrame:
    """part with a one-value column, a boolean, and a column constant next to ``size``."""
    return table(spark, folder, "part").select(
        "p_partkey",
        F.nullif("p_size", F.lit(7)).alias("size"),
        F.when(F.col("p_size") == 9, float("nan")).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(F.col("p_partkey") == 0, F.col("p_retailprice")).alias("single"),
        F.when(F.col("p_size") > 25, 0.1).when(F.col("p_size") == 7, 3.0).alias("flat"),
        (F.col("p_retailprice") < 910).alias("cheap"),
    )


# SQL building blocks ---------------------------------------------------------------------------


def _numeric(types: dict[str, str]) -> list[str]:
    return [c for c, t in types.items() if t in ("bigint", "int", "double", "boolean")]


def _clean(column: str, dtype: str) -> str:
    return f"CASE WHEN isnan({column}) THEN NULL ELSE {column} END" if dtype == "double" else column


def _as_number(column: str, dtype: str) -> str:
    return _clean(column, dtype) if dtype == "double" else f"CAST(CAST({column} AS BIGINT) AS DOUBLE)"


def _union(parts: Sequence[str]) -> str:
    return "\nUNION ALL ".join(parts)


def overview_sql(source: str, types: dict[str, str]) -> str:
    missing = " + ".join(f"(count(*) - count({_clean(c, t)}))" for c, t in types.items())
    numeric = len(_numeric(types))
    return (
        f"SELECT count(*) AS row_count, CAST({len(types)} AS BIGINT) AS column_count,"
        f" CAST({numeric} AS BIGINT) AS numeric_count, CAST({len(types) - numeric} AS BIGINT) AS categorical_count,"
        f" CAST({missing} AS BIGINT) AS total_missing,"
        f" round(({missing}) * 100.0::DOUBLE / (count(*) * {len(types)}), 2) AS missing_cell_pct FROM {source}"
    )


def profile_sql(source: str, types: dict[str, str]) -> str:
    return _union(
        [
            f"SELECT {i} AS position, '{c}' AS name, '{t}' AS dtype, count(*) - count({_clean(c, t)}) AS missing_count,"
            f" round((count(*) - count({_clean(c, t)})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,"
            f" count(DISTINCT {_clean(c, t)}) AS unique_count, {c in _numeric(types)} AS is_numeric FROM {source}"
            for i, (c, t) in enumerate(types.items())
        ]
    )


def describe_sql(source: str, types: dict[str, str]) -> str:
    return _union(
        [
            f"SELECT {i} AS position, '{c}' AS name, CAST(count(x) AS DOUBLE) AS count, round(avg(x), 4) AS mean,"
            " round(coalesce(stddev_samp(x), 0.0), 4) AS std, round(min(x), 4) AS min,"
            " round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS median,"
            " round(quantile_cont(x, 0.75), 4) AS q75, round(max(x), 4) AS max"
            f" FROM (SELECT {_as_number(c, types[c])} AS x FROM {source}) HAVING count(x) > 0"
            for i, c in enumerate(_numeric(types))
        ]
    )


def pairs_sql(source: str, types: dict[str, str], columns: Sequence[str]) -> str:
    """Rows (i, j, col1, col2, r) for i < j; r is NULL where undefined."""
    parts = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            both = f"SELECT {_as_number(a, types[a])} AS x, {_as_number(b, types[b])} AS y FROM {source}"
            parts.append(
                f"SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2,"
                " CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS r"
                f" FROM ({both}) WHERE x IS NOT NULL AND y IS NOT NULL"
            )
    return _union(parts)


def ranked_pairs_sql(pairs: str) -> str:
    return (
        "SELECT CAST(row_number() OVER (ORDER BY abs_correlation DESC, i, j) AS INTEGER) AS rank, * FROM ("
        "SELECT i, j, col1, col2, round(r, 4) AS correlation, round(abs(r), 4) AS abs_correlation"
        f" FROM ({pairs}) WHERE r IS NOT NULL)"
    )


def matrix_sql(pairs: str, columns: Sequence[str]) -> str:
    diagonal = _union([f"SELECT {i} AS i, {i} AS j, '{c}' AS col1, '{c}' AS col2, 1.0::DOUBLE AS r" for i, c in enumerate(columns)])
    return (
        f"WITH p AS ({pairs}) SELECT i, j, col1, col2, coalesce(round(r, 4), 0.0) AS value FROM (SELECT * FROM p"
        f" UNION ALL SELECT j AS i, i AS j, col2 AS col1, col1 AS col2, r FROM p UNION ALL {diagonal})"
    )


def split_sql(source: str, key: str, share: float = 0.2) -> str:
    return (
        f"SELECT *, rn <= CAST(ceil(CAST({share} AS DOUBLE) * n) AS BIGINT) AS is_test FROM (SELECT *,"
        f" row_number() OVER (ORDER BY h, {key}) AS rn, count(*) OVER () AS n"
        f" FROM (SELECT *, md5('42:' || CAST({key} AS VARCHAR)) AS h FROM {source}))"
    )


PART_ROWS = "(SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS x1, CAST(p_size AS DOUBLE) AS x2, p_retailprice AS y FROM part)"


def fit_sql(source: str = PART_ROWS, share: float = 0.2, ridge: float = 0.0) -> str:
    """CTEs s (rows with is_test), f (w1, w2, b) and p (rows with actual and predicted)."""
    return f"""WITH s AS ({split_sql(source, "p_partkey", share)}),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM s WHERE NOT is_test),
g AS (SELECT sum((x1 - m1) * (x1 - m1)) + {ridge} AS a, sum((x1 - m1) * (x2 - m2)) AS b,
  sum((x2 - m2) * (x2 - m2)) + {ridge} AS c, sum((x1 - m1) * (y - my)) AS d, sum((x2 - m2) * (y - my)) AS e
  FROM s, m WHERE NOT is_test),
w AS (SELECT (d * c - e * b) / (a * c - b * b) AS w1, (e * a - d * b) / (a * c - b * b) AS w2 FROM g),
f AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS b FROM w, m),
p AS (SELECT s.*, y AS actual, b + w1 * x1 + w2 * x2 AS predicted FROM s, f)
"""


METRICS_SQL = """SELECT count(*) FILTER (WHERE NOT is_test) AS train_samples, count(*) FILTER (WHERE is_test) AS test_samples,
 round(1 - sum(e * e) FILTER (WHERE is_test) / (var_pop(actual) FILTER (WHERE is_test) * count(*) FILTER (WHERE is_test)), 4) AS r2,
 round(1 - sum(e * e) FILTER (WHERE NOT is_test) / (var_pop(actual) FILTER (WHERE NOT is_test) * count(*) FILTER (WHERE NOT is_test)), 4) AS train_r2,
 round(avg(abs(e)) FILTER (WHERE is_test), 4) AS mae, round(sqrt(avg(e * e) FILTER (WHERE is_test)), 4) AS rmse,
 round(avg(e * e) FILTER (WHERE is_test), 4) AS mse FROM (SELECT *, actual - predicted AS e FROM {source})"""

def part_coefficients_sql(fit: str) -> str:
    rows = _union(
        [
            "SELECT 0 AS position, 'p_partkey' AS feature, w1 AS w FROM f",
            "SELECT 1 AS position, 'p_size' AS feature, w2 AS w FROM f",
        ]
    )
    return fit + ranked_weights_sql(rows)


def ranked_weights_sql(rows: str) -> str:
    return (
        "SELECT CAST(row_number() OVER (ORDER BY round(abs(w), 4) DESC, position) AS INTEGER) AS rank, position, feature,"
        f" round(w, 4) AS weight, round(abs(w) * 100.0 / sum(abs(w)) OVER (), 2) AS share_pct FROM ({rows})"
    )


def decimal_sql(value: str, places: int = 4) -> str:
    return f"regexp_replace(regexp_replace(printf('%.{places}f', {value}), '0+$', ''), '\\.$', '.0')"


# Profile ---------------------------------------------------------------------------------------


@registered("dataset_overview", overview_sql("orders", ORDERS_TYPES))
def _(spark, folder):
    return profile.dataset_overview(table(spark, folder, "orders"))


@registered("dataset_overview_missing", overview_sql(GAPPY_SQL, GAPPY_TYPES))
def _(spark, folder):
    return profile.dataset_overview(gappy_lineitem(spark, folder))


@registered("profile_columns", profile_sql("lineitem", LINEITEM_TYPES))
def _(spark, folder):
    return profile.profile_columns(table(spark, folder, "lineitem"))


@registered("profile_columns_events", profile_sql("events", EVENTS_TYPES))
def _(spark, folder):
    return profile.profile_columns(table(spark, folder, "events"))


@registered("profile_columns_missing", profile_sql(GAPPY_SQL, GAPPY_TYPES))
def _(spark, folder):
    return profile.profile_columns(gappy_lineitem(spark, folder))


@registered("describe_numeric", describe_sql("lineitem", LINEITEM_TYPES))
def _(spark, folder):
    return profile.describe_numeric(table(spark, folder, "lineitem"))


@registered("describe_events", describe_sql("events", EVENTS_TYPES))
def _(spark, folder):
    return profile.describe_numeric(table(spark, folder, "events"))


@registered("describe_with_missing", describe_sql(GAPPY_SQL, GAPPY_TYPES))
def _(spark, folder):
    return profile.describe_numeric(gappy_lineitem(spark, folder))


@registered("describe_single_and_boolean", describe_sql(ODD_SQL, ODD_TYPES))
def _(spark, folder):
    return profile.describe_numeric(odd_part(spark, folder))


@registered(
    "preview_rows",
    "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderpriority"
    " FROM orders ORDER BY o_orderkey LIMIT 10",
)
def _(spark, folder):
    nan = F.when(F.col("o_custkey") % 2 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    rows = table(spark, folder, "orders").select("o_orderkey", nan.alias("price"), "o_orderpriority")
    return profile.preview_rows(rows, ["o_orderkey"])


@registered(
    "profile_records",
    "SELECT CAST(json_object('name', name, 'missing_count', missing_count, 'unique_count', unique_count,"
    f" 'is_numeric', is_numeric) AS VARCHAR) AS record FROM ({profile_sql('orders', ORDERS_TYPES)})",
)
def _(spark, folder):
    columns = profile.profile_columns(table(spark, folder, "orders"))
    return columns.select(F.to_json(F.struct("name", "missing_count", "unique_count", "is_numeric")).alias("record"))


@registered(
    "table_shape",
    "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count, count(*) > 0 AS has_rows,"
    " count(*) <= 100000 AS rows_within_limit, true AS columns_within_limit FROM lineitem",
)
def _(spark, folder):
    return shape(table(spark, folder, "lineitem"), 100_000, 100)


# Types and tokens ------------------------------------------------------------------------------

TEXT_COLUMNS = {
    "event_id": "CAST(event_id AS VARCHAR)",
    "value": "CASE WHEN user_id % 7 = 0 THEN 'N/A' ELSE CAST(value AS VARCHAR) END",
    "users": "CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END",
    "flag": "CASE WHEN event_type = 'click' THEN 'True' WHEN event_type = 'view' THEN '' ELSE 'False' END",
    "mixed": "CASE WHEN event_type = 'error' THEN 'true' ELSE '1' END",
    "day": "CAST(CAST(ts AS DATE) AS VARCHAR)",
    "nothing": "'NaN'",
}


def _inference_sql() -> str:
    tokens = "'', 'N/A', 'null', 'NaN'"
    parts = []
    for i, (name, text) in enumerate(TEXT_COLUMNS.items()):
        parts.append(
            f"SELECT {i} AS position, '{name}' AS name, CASE WHEN count(v) = 0 THEN 'double'"
            " WHEN count(v) = count(TRY_CAST(v AS BIGINT)) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+')) THEN 'bigint'"
            " WHEN count(v) = count(TRY_CAST(v AS DOUBLE)) THEN 'double'"
            " WHEN count(v) = count(*) FILTER (WHERE v IN ('True', 'False', 'true', 'false')) THEN 'boolean'"
            f" ELSE 'string' END AS dtype FROM (SELECT CASE WHEN t NOT IN ({tokens}) THEN t END AS v"
            f" FROM (SELECT {text} AS t FROM events))"
        )
    return _union(parts)


def _text_events(spark: SparkSession, folder: str) -> DataFrame:
    texts = [F.expr(e.replace("VARCHAR", "STRING")).alias(n) for n, e in TEXT_COLUMNS.items()]
    return table(spark, folder, "events").select(*texts)


@registered("infer_types", _inference_sql())
def _(spark, folder):
    return infer_types(tokens_to_null(_text_events(spark, folder)))


@registered(
    "missing_tokens",
    f"SELECT count(*) AS rows, count(*) FILTER (WHERE {TEXT_COLUMNS['value']} = 'N/A') AS value_missing,"
    f" count(*) FILTER (WHERE {TEXT_COLUMNS['users']} = 'null') AS users_missing,"
    f" count(*) FILTER (WHERE {TEXT_COLUMNS['flag']} = '') AS flag_missing FROM events",
)
def _(spark, folder):
    clean = tokens_to_null(_text_events(spark, folder))
    return clean.agg(
        F.count("*").alias("rows"),
        *[F.count_if(col(c).isNull()).alias(f"{c}_missing") for c in ("value", "users", "flag")],
    )


# Association -----------------------------------------------------------------------------------

LINEITEM_NUMERIC = _numeric(LINEITEM_TYPES)
PART_NUMERIC = _numeric(PART_TYPES)
ODD_USABLE = [c for c in _numeric(ODD_TYPES) if c != "single"]


@registered(
    "usable_numeric_columns",
    _union([f"SELECT {i} AS position, '{c}' AS name FROM {ODD_SQL} HAVING min({c}) <> max({c})" for i, c in enumerate(_numeric(ODD_TYPES))]),
)
def _(spark, folder):
    return correlation.usable_columns(odd_part(spark, folder))


@registered("correlation_pairs", ranked_pairs_sql(pairs_sql("lineitem", LINEITEM_TYPES, LINEITEM_NUMERIC)))
def _(spark, folder):
    return correlation.correlation_pairs(table(spark, folder, "lineitem"))


@registered("correlation_pairs_missing", ranked_pairs_sql(pairs_sql(ODD_SQL, ODD_TYPES, ODD_USABLE)))
def _(spark, folder):
    return correlation.correlation_pairs(odd_part(spark, folder))


@registered("correlation_matrix", matrix_sql(pairs_sql("part", PART_TYPES, PART_NUMERIC), PART_NUMERIC))
def _(spark, folder):
    return correlation.correlation_matrix(table(spark, folder, "part"))


@registered("correlation_matrix_missing", matrix_sql(pairs_sql(ODD_SQL, ODD_TYPES, ODD_USABLE), ODD_USABLE))
def _(spark, folder):
    return correlation.correlation_matrix(odd_part(spark, folder))


@registered(
    "correlation_matrix_wide",
    "SELECT i, col1 AS name, "
    + ", ".join(f"max(value) FILTER (WHERE col2 = '{c}') AS {c}" for c in PART_NUMERIC)
    + f" FROM ({matrix_sql(pairs_sql('part', PART_TYPES, PART_NUMERIC), PART_NUMERIC)}) GROUP BY i, col1",
)
def _(spark, folder):
    matrix = correlation.correlation_matrix(table(spark, folder, "part"))
    return correlation.wide_matrix(matrix, PART_NUMERIC)


@registered(
    "correlation_empty",
    "SELECT 0 AS rank, 0 AS i, 0 AS j, '' AS col1, '' AS col2, 0.0::DOUBLE AS correlation,"
    " 0.0::DOUBLE AS abs_correlation FROM region WHERE r_regionkey < 0",
)
def _(spark, folder):
    return correlation.correlation_pairs(table(spark, folder, "region"))


LINEITEM_PAIRS = ranked_pairs_sql(pairs_sql("lineitem", LINEITEM_TYPES, LINEITEM_NUMERIC))


@registered("top_pairs", f"SELECT * FROM ({LINEITEM_PAIRS}) ORDER BY rank LIMIT 6")
def _(spark, folder):
    return correlation.top_pairs(correlation.correlation_pairs(table(spark, folder, "lineitem")), 6)


@registered("correlation_pair_count", f"SELECT count(*) AS pair_count FROM ({ranked_pairs_sql(pairs_sql(ODD_SQL, ODD_TYPES, ODD_USABLE))})")
def _(spark, folder):
    return correlation.correlation_pairs(odd_part(spark, folder)).agg(F.count("*").alias("pair_count"))


@registered(
    "relationship_pearson",
    "SELECT 'size' AS col1, 'price' AS col2, 'pearson' AS method, count(*) AS pair_count, round(corr(x, y), 4) AS correlation"
    f" FROM (SELECT CAST(size AS DOUBLE) AS x, {_clean('price', 'double')} AS y FROM {ODD_SQL})"
    " WHERE x IS NOT NULL AND y IS NOT NULL",
)
def _(spark, folder):
    return correlation.relationship(odd_part(spark, folder), "size", "price")


def _rank_sql(value: str) -> str:
    return f"rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0"


@registered(
    "relationship_spearman",
    "SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, 'spearman' AS method, count(*) AS pair_count,"
    f" round(corr(rx, ry), 4) AS correlation FROM (SELECT {_rank_sql('l_quantity')} AS rx,"
    f" {_rank_sql('l_extendedprice')} AS ry FROM lineitem)",
)
def _(spark, folder):
    return correlation.relationship(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "spearman")


def _spearman_sql(source: str, types: dict[str, str], columns: Sequence[str]) -> str:
    parts = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            both = (
                f"SELECT * FROM (SELECT {_as_number(a, types[a])} AS x, {_as_number(b, types[b])} AS y FROM {source})"
                " WHERE x IS NOT NULL AND y IS NOT NULL"
            )
            parts.append(
                f"SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2, corr(rx, ry) AS r"
                f" FROM (SELECT {_rank_sql('x')} AS rx, {_rank_sql('y')} AS ry FROM ({both}))"
            )
    return _union(parts)


@registered("spearman_pairs", ranked_pairs_sql(_spearman_sql("part", PART_TYPES, PART_NUMERIC)))
def _(spark, folder):
    return correlation.correlation_pairs(table(spark, folder, "part"), method="spearman")


SPEARMAN_COLUMNS = ["p_partkey", "size", "price"]


@registered("spearman_matrix_missing", matrix_sql(_spearman_sql(ODD_SQL, ODD_TYPES, SPEARMAN_COLUMNS), SPEARMAN_COLUMNS))
def _(spark, folder):
    return correlation.correlation_matrix(odd_part(spark, folder), SPEARMAN_COLUMNS, "spearman")


LINEITEM_NUMERIC_SPEARMAN = _spearman_sql("lineitem", LINEITEM_TYPES, LINEITEM_NUMERIC)


@registered("spearman_pairs_lineitem", ranked_pairs_sql(LINEITEM_NUMERIC_SPEARMAN))
def _(spark, folder):
    return correlation.correlation_pairs(table(spark, folder, "lineitem"), method="spearman")


GAPPY_RANKED = ["l_orderkey", "l_quantity", "discount", "tax"]


@registered("spearman_pairs_gappy_lineitem", ranked_pairs_sql(_spearman_sql(GAPPY_SQL, GAPPY_TYPES, GAPPY_RANKED)))
def _(spark, folder):
    return correlation.correlation_pairs(gappy_lineitem(spark, folder), method="spearman")


# Regression ------------------------------------------------------------------------------------


@registered("exact_split", f"SELECT o_orderkey, h AS split_hash, is_test FROM ({split_sql('orders', 'o_orderkey')})")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return exact_split(orders, ["o_orderkey"]).apply(orders)


@registered("exact_split_ratio", f"SELECT is_test, count(*) AS rows FROM ({split_sql('orders', 'o_orderkey', 0.35)}) GROUP BY is_test")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    split = exact_split(orders, ["o_orderkey"], 0.35)
    return split.apply(orders).groupBy("is_test").agg(F.count("*").alias("rows"))


@registered(
    "exact_split_without_key",
    "SELECT is_test, CASE WHEN is_test THEN t ELSE n - t END AS rows FROM (SELECT count(*) AS n,"
    " CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS t FROM lineitem), (VALUES (true), (false)) AS v(is_test)",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    return exact_split(rows).apply(rows).groupBy("is_test").agg(F.count("*").alias("rows"))


GAPPY_ORDERS = """(SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust,
 CASE WHEN o_orderpriority = '5-LOW' THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS price FROM orders)"""
USABLE_ORDERS = f"(SELECT * FROM {GAPPY_ORDERS} WHERE NOT isnan(price))"


def _gappy_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("cust"),
        F.when(F.col("o_orderpriority") == "5-LOW", float("nan")).otherwise(F.col("o_totalprice")).alias("price"),
    )


@registered(
    "train_means",
    f"SELECT 'cust' AS name, count(cust) AS count, round(avg(cust), 4) AS mean FROM ({split_sql(USABLE_ORDERS, 'o_orderkey')}) WHERE NOT is_test",
)
def _(spark, folder):
    rows = regression.modelling_rows(_gappy_orders(spark, folder), "price", ["cust"], ["o_orderkey"])
    split = exact_split(rows, ["o_orderkey"])
    return regression.train_means(rows, split, ["cust"]).select("name", "count", F.round("mean", 4).alias("mean"))


@registered(
    "imputed_rows",
    f"WITH s AS ({split_sql(USABLE_ORDERS, 'o_orderkey')}) SELECT o_orderkey, is_test, price,"
    " round(coalesce(cust, (SELECT avg(cust) FROM s WHERE NOT is_test)), 4) AS cust FROM s",
)
def _(spark, folder):
    model = regression.fit_linear_regression(_gappy_orders(spark, folder), "price", ["cust"], ["o_orderkey"])
    return model.imputed().select("o_orderkey", "is_test", "price", F.round("cust", 4).alias("cust"))


def _part_model(spark: SparkSession, folder: str, **options) -> regression.LinearModel:
    part = table(spark, folder, "part")
    return regression.fit_linear_regression(part, "p_retailprice", ["p_partkey", "p_size"], ["p_partkey"], **options)


@registered(
    "ols_one_feature",
    f"SELECT round(regr_slope(y, x1), 4) AS weight, round(regr_intercept(y, x1), 4) AS intercept"
    f" FROM ({split_sql(PART_ROWS, 'p_partkey')}) WHERE NOT is_test",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    model = regression.fit_linear_regression(part, "p_retailprice", ["p_partkey"], ["p_partkey"])
    return model.coefficients().select("weight", model.meta().select("intercept").scalar().alias("intercept"))


@registered(
    "ols_missing_feature",
    f"WITH s AS ({split_sql(USABLE_ORDERS, 'o_orderkey')}), t AS (SELECT price,"
    " coalesce(cust, avg(cust) OVER ()) AS cust FROM s WHERE NOT is_test)"
    " SELECT round(regr_slope(price, cust), 4) AS weight, round(regr_intercept(price, cust), 4) AS intercept FROM t",
)
def _(spark, folder):
    model = regression.fit_linear_regression(_gappy_orders(spark, folder), "price", ["cust"], ["o_orderkey"])
    return model.coefficients().select("weight", model.meta().select("intercept").scalar().alias("intercept"))


@registered("ols_two_features", part_coefficients_sql(fit_sql()))
def _(spark, folder):
    return _part_model(spark, folder).coefficients()


@registered(
    "regression_meta",
    fit_sql() + "SELECT 'p_retailprice' AS target_column, 'p_partkey,p_size' AS feature_columns,"
    " (SELECT count(*) FROM s WHERE NOT is_test) AS train_samples, (SELECT count(*) FROM s WHERE is_test) AS test_samples,"
    " round(b, 4) AS intercept FROM f",
)
def _(spark, folder):
    return _part_model(spark, folder).meta().withColumn("feature_columns", F.concat_ws(",", "feature_columns"))


@registered("regression_metrics", fit_sql() + METRICS_SQL.format(source="p"))
def _(spark, folder):
    return _part_model(spark, folder).metrics()


POINTS_SQL = "SELECT round(actual, 4) AS actual, round(predicted, 4) AS predicted FROM p WHERE is_test ORDER BY h, p_partkey LIMIT 50"


@registered("regression_points", fit_sql() + POINTS_SQL)
def _(spark, folder):
    return _part_model(spark, folder).points()


@registered(
    "prediction_bounds",
    fit_sql() + f"SELECT low, high, CASE WHEN high = low THEN 1.0 ELSE round(high - low, 4) END AS range FROM (SELECT"
    f" min(least(actual, predicted)) AS low, max(greatest(actual, predicted)) AS high FROM ({POINTS_SQL}))",
)
def _(spark, folder):
    bounds = regression.prediction_bounds(_part_model(spark, folder).points())
    return bounds.withColumn("range", F.round("range", 4))


@registered(
    "ols_collinear",
    fit_sql() + ranked_weights_sql(
        _union(
            [
                "SELECT 0 AS position, 'p_partkey' AS feature, w1 AS w FROM f",
                "SELECT 1 AS position, 'p_size' AS feature, w2 / 5 AS w FROM f",
                "SELECT 2 AS position, 'double_size' AS feature, 2 * w2 / 5 AS w FROM f",
            ]
        )
    ),
)
def _(spark, folder):
    part = table(spark, folder, "part").withColumn("double_size", F.col("p_size") * 2)
    features = ["p_partkey", "p_size", "double_size"]
    return regression.fit_linear_regression(part, "p_retailprice", features, ["p_partkey"]).coefficients()


# x2 and x2 + x1 / 2^26, both exact: what tells them apart is 1e-8 of their size.
ILL_EPSILON = 2.0**-26


@registered(
    "ols_ill_conditioned",
    fit_sql() + f"SELECT round(w2, 4) AS together, round(w1, 4) AS apart FROM f, (SELECT {ILL_EPSILON!r} AS e)",
)
def _(spark, folder):
    """The weights of two nearly equal columns, as those of their common part and of their difference."""
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("size"))
    part = part.withColumn("near", F.col("size") + F.col("p_partkey") * F.lit(ILL_EPSILON))
    model = regression.fit_linear_regression(part, "p_retailprice", ["size", "near"], ["p_partkey"])
    size, near = model.weights
    return local_frame(spark, [(round(size + near, 4), round(near * ILL_EPSILON, 4))], "together double, apart double")


@registered("ridge", part_coefficients_sql(fit_sql(ridge=1.0)))
def _(spark, folder):
    return _part_model(spark, folder, ridge=1.0).coefficients()


@registered("split_ratio_metrics", fit_sql(share=0.35) + METRICS_SQL.format(source="p"))
def _(spark, folder):
    return _part_model(spark, folder, test_size=0.35).metrics()


@registered(
    "median_absolute_error",
    fit_sql() + "SELECT round(quantile_cont(abs(actual - predicted), 0.5), 4) AS medae FROM p WHERE is_test",
)
def _(spark, folder):
    return _part_model(spark, folder).median_absolute_error()


@registered(
    "median_baseline",
    fit_sql(share=0.35) + ", q AS (SELECT quantile_cont(actual, 0.5) AS med FROM p WHERE NOT is_test)"
    " SELECT 'linear' AS model, * FROM (" + METRICS_SQL.format(source="p") + ") UNION ALL SELECT 'median' AS model, * FROM ("
    + METRICS_SQL.format(source="(SELECT is_test, actual, med AS predicted FROM p, q)") + ")",
)
def _(spark, folder):
    # With 35 % test rows no mean of one-decimal prices lands on a rounding tie.
    return _part_model(spark, folder, test_size=0.35).median_baseline()


@registered(
    "weak_signal",
    fit_sql() + "SELECT r2, 0.2::DOUBLE AS threshold, r2 < 0.2 AS weak_signal FROM (" + METRICS_SQL.format(source="p") + ")",
)
def _(spark, folder):
    return _part_model(spark, folder).weak_signal()


DEDUPLICATED = (
    "(SELECT min(l_orderkey) AS l_orderkey, CAST(l_quantity AS DOUBLE) AS x, l_tax AS y FROM lineitem GROUP BY l_quantity, l_tax)"
)


@registered(
    "deduplicated_rows",
    f"SELECT l_orderkey, x AS l_quantity, y AS l_tax FROM {DEDUPLICATED}",
)
def _(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return regression.modelling_rows(lineitem, "l_tax", ["l_quantity"], ["l_orderkey"], deduplicate=True)


# Report ----------------------------------------------------------------------------------------


def _text_lines(lines: DataFrame) -> DataFrame:
    return lines.select("section", "line", "text")


def _fixed_sql(section: int, texts: Sequence[str], start: int = 0) -> str:
    rows = [f"SELECT {section} AS section, {start + i} AS line, '{t}' AS text" for i, t in enumerate(texts)]
    return _union(rows)


@registered(
    "report_overview",
    f"WITH o AS ({overview_sql('part', PART_TYPES)}) " + _fixed_sql(1, ["# Table profile: part", "", "## Size", "- **Source**: part"])
    + " UNION ALL SELECT 1, 4, '- **Rows**: ' || format('{:,}', row_count) FROM o"
    " UNION ALL SELECT 1, 5, '- **Columns**: ' || CAST(column_count AS VARCHAR) FROM o"
    " UNION ALL SELECT 1, 6, '- **Missing cells**: ' || format('{:,}', total_missing) FROM o",
)
def _(spark, folder):
    return _text_lines(report.overview_lines(profile.dataset_overview(table(spark, folder, "part")), "part"))


def _schema_lines_sql(source: str, types: dict[str, str]) -> str:
    head = ["", "## Columns", "| Name | Kind | Missing | Share missing | Distinct |", "| :--- | :--- | :--- | :--- | :--- |"]
    return (
        _fixed_sql(2, head)
        + " UNION ALL SELECT 2, position + 4, '| `' || name || '` | `' || dtype || '` | ' || CAST(missing_count AS VARCHAR) || ' | ' || "
        + decimal_sql("missing_pct", 2)
        + f" || '% | ' || CAST(unique_count AS VARCHAR) || ' |' FROM ({profile_sql(source, types)})"
    )


@registered("report_schema", _schema_lines_sql(GAPPY_SQL, GAPPY_TYPES))
def _(spark, folder):
    return _text_lines(report.schema_lines(profile.profile_columns(gappy_lineitem(spark, folder))))


@registered(
    "report_statistics",
    _fixed_sql(3, ["", "## Numeric columns", "| Name | Average | Deviation | Smallest | Middle | Largest |", "| :--- | :--- | :--- | :--- | :--- | :--- |"])
    + " UNION ALL SELECT 3, position + 4, '| `' || name || '` | ' || "
    + " || ' | ' || ".join(decimal_sql(c) for c in ("mean", "std", "min", "median", "max"))
    + f" || ' |' FROM ({describe_sql('part', PART_TYPES)})",
)
def _(spark, folder):
    return _text_lines(report.statistics_lines(profile.describe_numeric(table(spark, folder, "part"))))


def _correlation_lines_sql(pairs: str) -> str:
    return (
        _fixed_sql(4, ["", "## Strongest correlations", "| One | Other | Pearson r |", "| :--- | :--- | :--- |"])
        + " UNION ALL SELECT 4, rank + 3, '| `' || col1 || '` | `' || col2 || '` | ' || "
        + decimal_sql("correlation")
        + f" || ' |' FROM ({pairs}) WHERE rank <= 10"
    )


@registered("report_correlations", _correlation_lines_sql(LINEITEM_PAIRS))
def _(spark, folder):
    return _text_lines(report.correlation_lines(correlation.correlation_pairs(table(spark, folder, "lineitem"))))


@registered(
    "report_no_correlations",
    f"WITH n AS (SELECT count(*) AS n FROM region) SELECT 4 AS section, line, text FROM n, ({_fixed_sql(4, ['', '## Strongest correlations', report.NO_PAIRS])}) WHERE n > 0",
)
def _(spark, folder):
    return _text_lines(report.correlation_lines(correlation.correlation_pairs(table(spark, folder, "region"))))


def _report_regression_sql() -> str:
    facts = [
        ("Rows fitted", "format('{:,}', train_samples)"),
        ("Rows held out", "format('{:,}', test_samples)"),
        ("R² held out", decimal_sql("r2")),
        ("R² fitted", decimal_sql("train_r2")),
        ("Mean absolute error", decimal_sql("mae")),
        ("Root mean squared error", decimal_sql("rmse")),
        ("Constant", decimal_sql("(SELECT round(b, 4) FROM f)")),
    ]
    parts = [_fixed_sql(5, ["", "## Linear Regression Results", "- **Predicted column**: `p_retailprice`"])]
    parts += [f"SELECT 5, {i + 3}, '- **{label}**: ' || {value} FROM k" for i, (label, value) in enumerate(facts)]
    parts.append(_fixed_sql(6, ["", "### Weights", "| Name | Weight |", "| :--- | :--- |"]))
    weights = ranked_weights_sql("SELECT 0 AS position, 'p_partkey' AS feature, w1 AS w FROM f UNION ALL SELECT 1, 'p_size', w2 FROM f")
    parts.append(f"SELECT 6, rank + 3, '| `' || feature || '` | ' || {decimal_sql('weight')} || ' |' FROM ({weights})")
    return fit_sql() + f", k AS ({METRICS_SQL.format(source='p')}) " + _union(parts)


@registered("report_regression", _report_regression_sql())
def _(spark, folder):
    return _text_lines(report.regression_lines(_part_model(spark, folder)))


# Exploration -----------------------------------------------------------------------------------

FILTER_SQL = "o_totalprice BETWEEN 50000 AND 400000 AND o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1997-01-01'"


def _order_filters() -> list[Column]:
    return [
        explore.between("o_totalprice", 50_000, 400_000),
        explore.one_of("o_orderstatus", ["F", "O"]),
        explore.between("o_orderdate", low=F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))),
    ]


@registered(
    "filter_counts",
    f"SELECT count(*) AS total_rows, count(*) FILTER (WHERE {FILTER_SQL}) AS matched_rows,"
    f" count(*) FILTER (WHERE {FILTER_SQL} AND o_custkey % 3 <> 0) AS usable_rows FROM orders",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    orders = orders.withColumn("cust", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")))
    return explore.filter_counts(orders, _order_filters(), "cust")


def _groups_sql(source: str, keys: str, value: str) -> str:
    return (
        f"SELECT {keys}, count(*) AS rows, count({value}) AS count, round(sum({value}), 4) AS sum, round(avg({value}), 4) AS mean,"
        f" round(quantile_cont({value}, 0.5), 4) AS median, min({value}) AS min, max({value}) AS max FROM {source} GROUP BY {keys}"
    )


@registered("filtered_group_aggregate", _groups_sql(f"orders WHERE {FILTER_SQL}".join(["(SELECT * FROM ", ")"]), "o_orderpriority", "o_totalprice"))
def _(spark, folder):
    orders = explore.apply_filters(table(spark, folder, "orders"), _order_filters())
    return explore.grouped_aggregate(orders, ["o_orderpriority"], "o_totalprice")


@registered("group_aggregate", _groups_sql("lineitem", "l_returnflag, l_linestatus", "l_quantity"))
def _(spark, folder):
    return explore.grouped_aggregate(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


def _trend_sql(source: str, date: str, value: str, period: str) -> str:
    return (
        f"WITH g AS (SELECT date_trunc('{period}', {date}) AS start, count({value}) AS count, round(sum({value}), 4) AS sum,"
        f" round(avg({value}), 4) AS mean FROM {source} GROUP BY 1), c AS (SELECT unnest(generate_series((SELECT min(start) FROM g),"
        f" (SELECT max(start) FROM g), INTERVAL 1 {period})) AS start) SELECT CAST(c.start AS TIMESTAMP) AS period_start,"
        " coalesce(g.count, 0) AS count, g.sum, g.mean FROM c LEFT JOIN g ON c.start = g.start"
    )


@registered("date_trend", _trend_sql("events", "ts", "value", "day"))
def _(spark, folder):
    return explore.date_trend(table(spark, folder, "events"), "ts", "value", "day")


SPARSE_ORDERS = "(SELECT * FROM orders WHERE o_totalprice >= 499000)"


def _sparse_orders(spark: SparkSession, folder: str) -> DataFrame:
    return explore.apply_filters(table(spark, folder, "orders"), [explore.between("o_totalprice", low=499_000)])


@registered("date_trend_sparse", _trend_sql(SPARSE_ORDERS, "o_orderdate", "o_totalprice", "month"))
def _(spark, folder):
    return explore.date_trend(_sparse_orders(spark, folder), "o_orderdate", "o_totalprice", "month")


@registered(
    "time_extremes",
    f"WITH t AS ({_trend_sql('events', 'ts', 'value', 'day')}) SELECT (SELECT period_start FROM t ORDER BY mean DESC, period_start LIMIT 1) AS peak_period,"
    " max(mean) AS peak_value, (SELECT period_start FROM t ORDER BY mean, period_start LIMIT 1) AS trough_period, min(mean) AS trough_value FROM t",
)
def _(spark, folder):
    return explore.time_extremes(explore.date_trend(table(spark, folder, "events"), "ts", "value", "day"))


@registered(
    "trend_chart_points",
    f"SELECT period_start, count, sum, mean FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n) AS f FROM (SELECT *,"
    " CAST(floor((n - 1) * 9 / (size - 1)::DOUBLE) AS BIGINT) AS slot FROM (SELECT *, row_number() OVER (ORDER BY period_start) AS n,"
    f" count(*) OVER () AS size FROM ({_trend_sql('events', 'ts', 'value', 'day')})))) WHERE f = 1",
)
def _(spark, folder):
    return explore.chart_points(explore.date_trend(table(spark, folder, "events"), "ts", "value", "day"), 10)


@registered(
    "date_coverage",
    "WITH u AS (SELECT DISTINCT ts FROM events), g AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) AS gap FROM u)"
    " SELECT (SELECT count(*) FROM u) AS unique_observations, min(ts) AS first_date, max(ts) AS last_date,"
    " date_diff('day', min(ts), max(ts)) AS span_days,"
    " (SELECT round(quantile_cont(CAST(gap AS DOUBLE), 0.5) / 1e6, 4) FROM g WHERE gap IS NOT NULL) AS median_spacing_seconds FROM u",
)
def _(spark, folder):
    return explore.date_coverage(table(spark, folder, "events"), "ts")


@registered(
    "top_categories",
    _union(
        [
            f"SELECT * FROM (SELECT {i} AS position, '{c}' AS name, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank,"
            f" {c} AS value, count(*) AS count FROM part GROUP BY {c}) WHERE rank <= 3"
            for i, c in enumerate(["p_name", "p_brand", "p_type"])
        ]
    ),
)
def _(spark, folder):
    return explore.top_categories(table(spark, folder, "part"))


@registered(
    "category_concentration",
    "WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, p_name) AS k,"
    " sum(n) OVER (ORDER BY n DESC, p_name) AS upto, sum(n) OVER () AS total FROM c)"
    " SELECT 'p_name' AS name, (SELECT count(*) FROM c) AS category_count, k AS categories_needed,"
    " round(upto * 100.0::DOUBLE / total, 2) AS covered_pct FROM r"
    " WHERE upto >= ceil(total * CAST(0.7 AS DOUBLE)) ORDER BY k LIMIT 1",
)
def _(spark, folder):
    return explore.category_concentration(table(spark, folder, "part"), "p_name")


@registered(
    "category_shares",
    "SELECT CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, v AS value, n AS count, round(n * 100.0::DOUBLE / t, 2) AS share_pct,"
    " round(sum(n) OVER (ORDER BY n DESC, v) * 100.0::DOUBLE / t, 2) AS cumulative_pct FROM"
    " (SELECT event_type AS v, count(*) AS n, (SELECT count(*) FROM events) AS t FROM events GROUP BY event_type)"
    " ORDER BY rank LIMIT 10",
)
def _(spark, folder):
    return explore.category_shares(table(spark, folder, "events"), "event_type")


def _outliers_sql(source: str, types: dict[str, str], columns: Sequence[str]) -> str:
    return _union(
        [
            f"SELECT {i} AS position, '{c}' AS name, round(min(lo), 4) AS low_fence, round(min(hi), 4) AS high_fence,"
            " count(*) FILTER (WHERE x < lo OR x > hi) AS iqr_outliers, count(*) FILTER (WHERE abs(x - m) > 3 * s) AS z_outliers"
            f" FROM (SELECT {_as_number(c, types[c])} AS x FROM {source}), (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m, s"
            " FROM (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m, stddev_pop(x) AS s"
            f" FROM (SELECT {_as_number(c, types[c])} AS x FROM {source})))"
            for i, c in enumerate(columns)
        ]
    )


@registered("outlier_counts", _outliers_sql("events", EVENTS_TYPES, _numeric(EVENTS_TYPES)))
def _(spark, folder):
    return explore.outlier_counts(table(spark, folder, "events"))


@registered(
    "histogram",
    _union(
        [
            f"SELECT {i} AS position, '{c}' AS name, b AS bin, round(lo + b * w, 4) AS low, round(CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * w END, 4) AS high,"
            f" count(x) AS count FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, (max({c})::DOUBLE - min({c})::DOUBLE) / 10 AS w FROM orders)"
            " CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS b)"
            f" LEFT JOIN (SELECT {c}::DOUBLE AS x FROM orders) ON least(floor((x - lo) / w), 9) = b GROUP BY lo, hi, w, b"
            for i, c in enumerate(["o_custkey", "o_totalprice"])
        ]
    ),
)
def _(spark, folder):
    return explore.histogram(table(spark, folder, "orders"), ["o_custkey", "o_totalprice"])


@registered(
    "duplicate_rows",
    "SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS distinct_rows,"
    " count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows"
    " FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    return explore.duplicate_rows(rows.unionByName(rows.where("l_linenumber = 1")))


# The ways of large data, taken early ------------------------------------------------------------


@registered("duplicate_rows_looked_up", REGISTRY["duplicate_rows"].sql)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    return explore.duplicate_rows(rows.unionByName(rows.where("l_linenumber = 1")), broadcast_hashes=0)


@registered("group_aggregate_large_groups", _groups_sql("lineitem", "l_returnflag, l_linestatus", "l_quantity"))
def _(spark, folder):
    return explore.grouped_aggregate(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", group_rows=100)


@registered("describe_numeric_narrowed", describe_sql("lineitem", LINEITEM_TYPES))
def _(spark, folder):
    return profile.describe_numeric(table(spark, folder, "lineitem"), interval_rows=20)


@registered("exact_split_two_passes", f"SELECT o_orderkey, h AS split_hash, is_test FROM ({split_sql('orders', 'o_orderkey')})")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return exact_split(orders, ["o_orderkey"], candidate_rows=0).apply(orders)


@registered("relationship_spearman_buckets", REGISTRY["relationship_spearman"].sql)
def _(spark, folder):
    return correlation.relationship(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "spearman", bucket_rows=500)


@registered("date_coverage_buckets", REGISTRY["date_coverage"].sql)
def _(spark, folder):
    return explore.date_coverage(table(spark, folder, "events"), "ts", bucket_rows=100)


@registered("date_trend_hourly", _trend_sql("events", "ts", "value", "hour"))
def _(spark, folder):
    return explore.date_trend(table(spark, folder, "events"), "ts", "value", "hour")


# Awkward names and values -----------------------------------------------------------------------


@registered("group_by_x_name", _groups_sql("(SELECT o_orderpriority AS x, o_totalprice FROM orders)", "x", "o_totalprice"))
def _(spark, folder):
    return explore.grouped_aggregate(table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "x"), ["x"], "o_totalprice")


@registered("group_by_count_name", _groups_sql("(SELECT o_orderpriority AS count, o_totalprice FROM orders)", "count", "o_totalprice").replace("count(o_totalprice) AS count", "count(o_totalprice) AS count_"))
def _(spark, folder):
    return explore.grouped_aggregate(table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "count"), ["count"], "o_totalprice")


@registered("ols_reserved_names", part_coefficients_sql(fit_sql()).replace("'p_partkey'", "'predicted'").replace("'p_size'", "'is_test'"))
def _(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("predicted"), F.col("p_size").alias("is_test"), F.col("p_retailprice").alias("actual"))
    return regression.fit_linear_regression(part, "actual", ["predicted", "is_test"], ["predicted"]).coefficients()


@registered("correlation_pairs_large_values", ranked_pairs_sql(pairs_sql("part", PART_TYPES, PART_NUMERIC)))
def _(spark, folder):
    return correlation.correlation_pairs(table(spark, folder, "part").withColumn("p_retailprice", F.col("p_retailprice") * 1e200))


@registered("correlation_pairs_infinite", ranked_pairs_sql(pairs_sql("part", PART_TYPES, ["p_partkey", "p_size"])))
def _(spark, folder):
    price = F.when(F.col("p_partkey") % 7 == 0, float("inf")).otherwise(F.col("p_retailprice"))
    return correlation.correlation_pairs(table(spark, folder, "part").withColumn("p_retailprice", price))


@registered("describe_approximate", _union([f"SELECT {i} AS position, '{c}' AS name, true AS within" for i, c in enumerate(_numeric(LINEITEM_TYPES))]))
def _(spark, folder):
    """Whether each quartile of the single scan stands within a hundredth of its place."""
    rows = table(spark, folder, "lineitem")
    found = {r["name"]: r for r in profile.describe_numeric(rows, approximate=True).collect()}
    cells = []
    for name, r in found.items():
        x = col(name).cast("double")
        near = [
            (F.count_if(x < r[q] - 1e-4) <= (p + 0.01) * F.count(x)) & (F.count_if(x <= r[q] + 1e-4) >= (p - 0.01) * F.count(x))
            for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
        ]
        cells.append(F.struct(F.lit(r["position"]).alias("position"), F.lit(name).alias("name"), (near[0] & near[1] & near[2]).alias("within")))
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


# CSV lines --------------------------------------------------------------------------------------


@registered(
    "csv_orders",
    "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS cust, o_totalprice AS price,"
    " CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS priority FROM orders",
)
def _(spark, folder):
    """Padded names, missing tokens, quoted texts and rows shorter than the header."""
    cust = F.when(F.col("o_custkey") % 3 == 0, "NA").otherwise(F.col("o_custkey").cast("string"))
    priority = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))
    lines = table(spark, folder, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), cust, F.col("o_totalprice").cast("string"), priority))
    return csv.read_csv_lines(lines, " o_orderkey,cust , price,priority")


@registered("csv_long_rows", "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS long_rows FROM orders")
def _(spark, folder):
    more = F.when(F.col("o_orderkey") % 10 == 0, "more")
    return csv.long_lines(table(spark, folder, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", more)), 2)


@registered("csv_files", REGISTRY["csv_orders"].sql)
def _(spark, folder):
    """orders, written as CSV files with a header each, and read back."""
    path = f"{shared_folder(spark)}/colsight-csv-{uuid.uuid4().hex}"
    cust = F.when(F.col("o_custkey") % 3 == 0, "NA").otherwise(F.col("o_custkey").cast("string"))
    priority = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    rows = table(spark, folder, "orders").select("o_orderkey", cust.alias("cust"), F.col("o_totalprice").alias(" price"), priority.alias("priority "))
    rows.repartition(3, "o_orderkey").write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return csv.read_csv(spark, path)


# Defaults, checks and whole records -------------------------------------------------------------


@registered("ols_default_target", part_coefficients_sql(fit_sql()))
def _(spark, folder):
    return regression.fit_linear_regression(table(spark, folder, "part"), key=["p_partkey"]).coefficients()


@registered(
    "training_checks",
    f"SELECT n AS usable_rows, n >= 10 AS enough_rows, ceil(0.2::DOUBLE * n) > 0 AND ceil(0.2::DOUBLE * n) < n AS both_sides FROM (SELECT count(*) AS n FROM {USABLE_ORDERS})",
)
def _(spark, folder):
    return regression.training_checks(_gappy_orders(spark, folder), "price")


def _analysis(spark: SparkSession, folder: str):
    return analyse(table(spark, folder, "part"), "part", ["p_partkey"])


@registered(
    "analysis_record",
    f"WITH o AS ({overview_sql('part', PART_TYPES)}) SELECT o.*, CAST({len(PART_TYPES)} AS BIGINT) AS n_columns, CAST({len(PART_NUMERIC)} AS BIGINT) AS n_statistics,"
    f" (SELECT count(*) FROM ({ranked_pairs_sql(pairs_sql('part', PART_TYPES, PART_NUMERIC))})) AS n_pairs, CAST({len(PART_NUMERIC)} AS BIGINT) AS n_matrix, CAST(10 AS BIGINT) AS n_preview FROM o",
)
def _(spark, folder):
    lists = ("columns", "statistics", "pairs", "matrix", "preview")
    record = _analysis(spark, folder).record()
    return record.select(*[c for c in record.columns if c not in lists], *[F.size(c).cast("long").alias(f"n_{c}") for c in lists])


@registered(
    "model_record",
    fit_sql() + f", k AS ({METRICS_SQL.format(source='p')}) SELECT 'p_retailprice' AS target_column, train_samples, test_samples, r2, mae,"
    " CAST(2 AS BIGINT) AS n_weights, least(50, test_samples) AS n_points FROM k",
)
def _(spark, folder):
    return _part_model(spark, folder).record().select(
        "target_column", "train_samples", "test_samples", "metrics.r2", "metrics.mae",
        F.size("coefficients").cast("long").alias("n_weights"), F.size("chart_points").cast("long").alias("n_points"),
    )


@registered(
    "report_whole",
    _union(
        [
            f"SELECT * FROM ({REGISTRY['report_overview'].sql})",
            f"SELECT * FROM ({_schema_lines_sql('part', PART_TYPES)})",
            f"SELECT * FROM ({REGISTRY['report_statistics'].sql})",
            f"SELECT * FROM ({_correlation_lines_sql(ranked_pairs_sql(pairs_sql('part', PART_TYPES, PART_NUMERIC)))})",
            f"SELECT * FROM ({REGISTRY['report_regression'].sql})",
            _fixed_sql(7, ["", "---", report.FOOTER]),
        ]
    ),
)
def _(spark, folder):
    return _text_lines(_analysis(spark, folder).report(_part_model(spark, folder)))


# Sinks, written and read back -------------------------------------------------------------------


@registered("report_written", f"SELECT line AS number, text FROM (SELECT row_number() OVER (ORDER BY section, line) AS line, text FROM ({REGISTRY['report_whole'].sql}))")
def _(spark, folder):
    """The lines of the report file of ``part.csv``, in order."""
    lines = _analysis(spark, folder).report(_part_model(spark, folder))
    path = report.write_report(lines, f"{shared_folder(spark)}/colsight-report-{uuid.uuid4().hex}", "part.csv")
    if not path.endswith("/part-report"):
        raise ValueError(f"The report went to {path}.")
    # One file, whose lines keep their order.
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("number", "text")).select((F.col("number") + 1).cast("long").alias("number"), "text")


def _written_record(spark: SparkSession, record: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark)}/colsight-record-{uuid.uuid4().hex}"
    report.write_records(record, path)
    return spark.read.schema(record.schema).json(path)


@registered(
    "record_contents",
    f"SELECT position, name, count, mean, std, min, q25, median, q75, max FROM ({describe_sql('part', PART_TYPES)})",
)
def _(spark, folder):
    """The statistics of the analysis, written as JSON and read back."""
    record = _written_record(spark, _analysis(spark, folder).record())
    return record.select(F.inline("statistics")).select("position", "name", "count", "mean", "std", "min", "q25", "median", "q75", "max")


@registered("record_pairs", f"SELECT rank, col1, col2, correlation FROM ({ranked_pairs_sql(pairs_sql('part', PART_TYPES, PART_NUMERIC))})")
def _(spark, folder):
    record = _written_record(spark, _analysis(spark, folder).record())
    return record.select(F.inline("pairs")).select("rank", "col1", "col2", "correlation")


@registered("model_record_contents", fit_sql() + POINTS_SQL)
def _(spark, folder):
    record = _written_record(spark, _part_model(spark, folder).record())
    return record.select(F.inline("chart_points")).select("actual", "predicted")
