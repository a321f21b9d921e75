import random

import duckdb
import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from colsight.llm import divergence

SF = "/root/testdata/sf0.001"


def against_sql(frame, tmp_path, **settings):
    """Differences from the SQL over the frame's own rows."""
    frame.write.parquet(path := str(tmp_path / "documents"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return differences(divergence.audit(frame, **settings), connection, divergence.SQL)


def made(seed, n=240):
    random.seed(seed)
    words = ["die", "Der", "DAS", "é", "ÀB", "x1y", "", "it's", "end.", "漢字", "😀a", *(f"w{c}" for c in "abcdefghijklmnop")]
    text = lambda: " ".join(random.choices(words, weights=range(1, len(words) + 1), k=random.choice([0, 1, 5, 40])))
    rows = [(k % 7, random.choice(["en", "de", None, ""]), random.choice([f"s{k}" for k in range(9)] + [None]), text()) for k in range(n)]
    return [*rows, (None, None, None, None), (1, "xx", "only", "a b c"), (1, "yy", "one", None), (1, "yy", "two", "123"), *rows[:5]]


SCHEMA = "doc_id long, lang string, source string, text string"


@pytest.mark.parametrize("settings", [{}, {"tile": 3, "block": 2}, {"tile": 1, "block": 5}])
def test_audit_equals_sql(spark, tmp_path, settings):
    frame = spark.createDataFrame(made(3), SCHEMA).withColumn("n", F.lit(1)).withColumn("term", F.lit("x")).repartition(3)
    assert against_sql(frame, tmp_path, **settings) == []


def test_walk_equals_full_matrices():
    random.seed(1)
    rng = np.random.default_rng(1)
    for rows, to, columns in ((1, 1, 1), (5, 3, 40), (8, 8, 16), (3, 7, 0), (2, 9, 33)):
        depth = max(rows, to, columns, 2).bit_length()
        full = [np.where(rng.random((r, columns)) < 0.1, rng.integers(2, 10**9, (r, columns)), 0) for r in (rows, to)]
        full[1][:, : columns // 2] = 0
        zeros = [rng.integers(1, 10**5, r) for r in (rows, to)]
        trees = [divergence.QuadTree(*np.nonzero(m), m[np.nonzero(m)], depth) for m in full]
        p, q = (np.where(m > 0, m, z[:, None]) for m, z in zip(full, zeros))
        expected = ((p[:, None, :] - q[None, :, :]) ** 2 // q[None, :, :]).sum(axis=2)
        assert (divergence.walk(*trees, *zeros, columns, depth) == expected).all()


def test_long_texts_are_read_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = b"abc DEF, ghi-jkl " * 50 + b"z" * 40
    assert [t for terms in divergence.terms_of(text) for t in terms] == [b"abc", b"def", b"ghi", b"jkl"] * 50 + [b"z" * 40]
    assert list(divergence.terms_of(None)) == list(divergence.terms_of(b"")) == []
    long = " ".join(["alpha", "beta", "z" * 30] * 100_000)
    frame = spark.createDataFrame([(1, "en", f"s{k % 2}", long if k == 1 else "alpha gamma") for k in range(6)], SCHEMA)
    assert against_sql(frame, tmp_path) == []


def test_counts_are_passed_on_when_many(spark, tmp_path, monkeypatch):
    batches = spark.createDataFrame([("en", "s", b"a b c a"), ("en", "t", b"a d"), ("en", "s", b"a b")], "lang string, source string, text binary").toArrow().to_batches()
    monkeypatch.setattr(divergence, "HELD", 2)
    rows = [r for batch in divergence._count(iter(batches)) for r in batch.to_pylist()]
    assert sum(r["n"] for r in rows if r["term"] == "a") == 4 and sum(r["docs"] for r in rows if r["term"] == "a") == 3


def test_query_agrees_with_sql_on_documents(spark):
    assert differences(divergence.op13_source_divergence(spark, SF), connect(SF), divergence.SQL) == []


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
