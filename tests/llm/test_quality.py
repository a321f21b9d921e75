import math
import random
import re

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from colsight.llm import quality

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    random.seed(2)
    texts = {k: "".join(random.choices(["a", "b ", "c\n", "é", " ", "\t", "\n", "#", "$|", "\x0b", "\xa0", "\U0001f600", "a a b "], k=random.randint(0, 30))) for k in range(400)}
    texts |= {1000: None, 1001: "", 1002: "x y z " * 4000, 1003: "a a a a", 1004: "a b", 1005: "q\r\nq\r\nq"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("w", F.lit(1))
    for r in quality.statistics(docs, ("doc_id",)).collect():
        found = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
        assert found == (brute(texts[r.doc_id]) if r.doc_id != 1002 else (12000, 12000, 0, 0, 12000)), repr(texts[r.doc_id])


def test_query_agrees_with_sql_on_documents(spark):
    assert differences(quality.op4_risk_rules(spark, SF), connect(SF), quality.SQL) == []


def test_tail_is_the_binomial_distribution(spark):
    rows = [(n, r) for n in (1, 5, 40, 900) for r in (0, 1, 3, 20) if r <= n]
    frame = spark.createDataFrame(rows, "n long, r long").withColumn("p", quality.tail(F.col("n"), F.col("r"), 0.1))
    for row in frame.collect():
        exact = sum(math.comb(row.n, i) * 0.1**i * 0.9 ** (row.n - i) for i in range(row.r + 1))
        assert row.p == 1.0 if row.r > row.n * 0.1 else row.p == pytest.approx(exact, rel=1e-9)


def stats_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def test_cutoffs_hold_by_stratum_and_reject_only_beyond_them(spark):
    """5,000 good documents a language; in one of them 1 in 20 is full of symbols, so its cutoff stays above them."""
    rows = [(k, "en" if k % 2 else None, 100, 500, 1, 0, 0) for k in range(10_000)]
    rows = [(*r[:4], 40, *r[5:]) if r[1] is None and r[0] % 40 == 0 else r for r in rows]
    rows += [(20_000, "en", 100, 500, 40, 0, 0), (20_001, None, 100, 500, 40, 0, 0), (20_002, "xx", 100, 500, 400, 0, 0), (20_003, "en", 49, 245, 0, 0, 0), (None, "en", 100, 500, 1, 0, 51)]
    labels = spark.createDataFrame([(k, 1) for k in range(10_000)] + [(20_000, 0), (20_000, 1), (20_001, None), (None, 1)], "doc_id long, quality int")
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(stats_of(spark, rows), labels).collect()}
    assert kept[20_000] == (False, False) and kept[20_001] == (False, True) and kept[20_002] == (False, True)
    assert kept[20_003] == (True, False) and kept[None] == (True, False)
    assert sum(not kept[k][1] for k in range(10_000)) == 0


def test_few_labels_give_no_cutoffs_and_empty_tables_pass(spark):
    rows = [(k, "en", 100, 5000, 400, 50, 40) for k in range(20)]
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert all(r.kept for r in quality.judge(stats_of(spark, rows), labels).collect())
    assert all(r.kept for r in quality.judge(stats_of(spark, rows), labels.limit(0)).collect())
    assert quality.judge(stats_of(spark, []), labels).count() == 0
