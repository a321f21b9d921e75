import pathlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.errors import DatasetError
from colsight.operators.profile import describe_numeric, profile_columns
from colsight.sources.checks import check_shape, shape
from colsight.sources.csv import clean_header, read_csv, read_csv_lines
from colsight.sources.inference import infer_types
from colsight.sources.sample import sample_table

TABLES = pathlib.Path("/root/testdata/sf0.001")


def load(spark, tmp_path, text, **kw):
    file = tmp_path / "t.csv"
    file.write_text(text)
    return read_csv(spark, str(file), **kw)


def test_header_is_trimmed(spark, tmp_path):
    df = load(spark, tmp_path, "width, height ,weight\n2,4,8\n3,9,27\n5,25,125\n")
    assert df.columns == ["width", "height", "weight"]
    assert [r["width"] for r in df.collect()] == [2, 3, 5]
    assert {f.dataType.typeName() for f in df.schema} == {"long"}


def test_types_and_missing_tokens(spark, tmp_path):
    text = (
        "i,f,b,mixed,yes,day,none,big,hex,inf,quoted\n"
        "1,1.5,True,True,Yes,2023-01-01,NA,1e5,1d,inf,\"a,\"\"b\"\"\"\n"
        "NA,N/A,false,1,No,2023-01-03,,.5,2,-inf,x\n"
        " 3,2,TRUE,,No,null,None,7.,3,1,\n"
    )
    df = load(spark, tmp_path, text)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    assert types == {
        "i": "bigint", "f": "double", "b": "boolean", "mixed": "string", "yes": "string", "day": "string",
        "none": "double", "big": "double", "hex": "string", "inf": "double", "quoted": "string",
    }
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, None, 3] and [r["f"] for r in rows] == [1.5, None, 2.0]
    assert [r["b"] for r in rows] == [True, False, True] and [r["quoted"] for r in rows] == ['a,"b"', "x", None]
    assert [r["inf"] for r in rows] == [float("inf"), float("-inf"), 1.0] and rows[2]["day"] is None
    assert [r["big"] for r in rows] == [1e5, 0.5, 7.0]


def test_ragged_rows(spark, tmp_path):
    with pytest.raises(DatasetError, match="1 rows hold more fields"):
        load(spark, tmp_path, "a,b\n1,2\n4,5,6\n")
    got = load(spark, tmp_path, "a,b\n1,2\n4\n").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, 2), (4, None)]


def test_empty_inputs_and_limits(spark, tmp_path):
    with pytest.raises(DatasetError, match="empty"):
        load(spark, tmp_path, "")
    with pytest.raises(DatasetError, match="not one row"):
        load(spark, tmp_path, "a,b\n")
    with pytest.raises(DatasetError, match="3 rows; the limit"):
        load(spark, tmp_path, "a\n1\n2\n3\n", max_rows=2)
    with pytest.raises(DatasetError, match="2 columns; the limit"):
        load(spark, tmp_path, "a,b\n1,2\n", max_columns=1)


def test_repeated_headers():
    assert clean_header(["c", "c", "c"]) == ["c", "c.1", "c.2"]
    assert clean_header(["c", "c.1", "c"]) == ["c", "c.1", "c.2"]
    assert clean_header(["a", None]) == ["a", "Unnamed: 1"]
    with pytest.raises(DatasetError, match="more than once"):
        clean_header(["a", " a"])


def test_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text(f"k,v\n{i},{i}.5\n")
    df = read_csv(spark, str(tmp_path / "*.csv"))
    assert sorted((r["k"], r["v"]) for r in df.collect()) == [(0, 0.5), (1, 1.5), (2, 2.5)]


def test_files_with_other_headers_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("price,size\n1000,3\n2000,4\n")
    (tmp_path / "b.csv").write_text("size,price\n5,3000\n")
    with pytest.raises(DatasetError, match="[ab].csv"):
        read_csv(spark, str(tmp_path / "*.csv"))
    (tmp_path / "b.csv").write_text("\ufeffprice,size\n3000,5\nprice,size\n")
    df = read_csv(spark, str(tmp_path / "*.csv"))
    assert sorted(r["price"] for r in df.collect()) == ["1000", "2000", "3000", "price"]


def test_the_first_line_of_each_file_is_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("price,size\n" + "1000,3\n" * 20)
    (tmp_path / "b.csv").write_text("size,price\n5,3000\nprice,size\n6,4000\n")
    with pytest.raises(DatasetError, match="b.csv' is not that of the first file"):
        read_csv(spark, str(tmp_path / "*.csv"))
    # The first file by name counts, not the largest.
    (tmp_path / "a.csv").write_text("price,size\n1,2\n")
    with pytest.raises(DatasetError, match="b.csv' is not that of the first file"):
        read_csv(spark, str(tmp_path / "*.csv"))


def test_files_of_several_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        for name in "ab":
            (tmp_path / f"{name}.csv").write_text("price,size\n" + "".join(f"{i},{name}\n" for i in range(300)))
        df = read_csv(spark, str(tmp_path / "*.csv"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 600 and df.dtypes == [("price", "bigint"), ("size", "string")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_lines(spark):
    lines = spark.createDataFrame([('1,NA,"a,b"',), ("2,3.5",), ("",)], "line string")
    df = read_csv_lines(lines, " k,v,t ")
    assert df.dtypes == [("k", "bigint"), ("v", "double"), ("t", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, None, "a,b"), (2, 3.5, None)]
    with pytest.raises(DatasetError, match="1 rows hold more fields"):
        read_csv_lines(spark.createDataFrame([("1,2",)], "line string"), "k")
    with pytest.raises(DatasetError, match="not one row"):
        read_csv_lines(lines.limit(0), "k")


@pytest.mark.parametrize("name", ["part", "orders", "customer"])
def test_written_tables_match_pandas(spark, tmp_path, name):
    pdf = pd.read_parquet(TABLES / f"{name}.parquet")
    number = pdf.select_dtypes("number").columns[-1]
    pdf.loc[::9, number] = None
    pdf.to_csv(tmp_path / "t.csv", index=False)
    pdf, df = pd.read_csv(tmp_path / "t.csv"), read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == list(pdf.columns) and df.count() == len(pdf)
    profile = {r["name"]: r for r in profile_columns(df, labels="pandas").collect()}
    for column in pdf.columns:
        assert profile[column]["dtype"] == str(pdf[column].dtype)
        assert profile[column]["missing_count"] == pdf[column].isna().sum()
        assert profile[column]["unique_count"] == pdf[column].nunique()
    want = pdf.describe().T.round(4)
    got = {r["name"]: r for r in describe_numeric(df).collect()}
    assert set(got) == set(want.index)
    for column, r in got.items():
        mine = [r[c] for c in ("count", "mean", "std", "min", "q25", "median", "q75", "max")]
        assert mine == pytest.approx(list(want.loc[column]), abs=1.01e-4)


def test_infer_types(spark):
    df = spark.createDataFrame([("1", "1", "x", None, "true"), ("2", "2.5", "3", None, "false")], "a string, b string, c string, d string, e string")
    got = [r["dtype"] for r in infer_types(df).orderBy("position").collect()]
    assert got == ["bigint", "double", "string", "double", "boolean"]


def test_shape_checks(spark):
    df = spark.range(5)
    assert check_shape(df, 5, 1) is df
    for arguments, message in (((4,), "5 rows; the limit"), ((None, 0), "1 columns; the limit")):
        with pytest.raises(DatasetError, match=message):
            check_shape(df, *arguments)
    with pytest.raises(DatasetError, match="not one row"):
        check_shape(df.limit(0))
    assert tuple(shape(df, 4, 3).first()) == (5, 1, True, False, True)


def test_sample_table(spark):
    df = sample_table(spark)
    assert df.count() == 120 and df.columns == ["rooms", "age", "distance", "price"]
    big = sample_table(spark, 20_000).agg(F.avg("rooms"), F.avg("age"), F.avg("distance"), F.corr("rooms", "price")).first()
    assert big[0] == pytest.approx(6.0, abs=0.1) and big[1] == pytest.approx(25.5, abs=0.5)
    assert big[2] == pytest.approx(8.0, abs=0.2) and big[3] > 0.8
