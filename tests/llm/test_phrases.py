import random

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from colsight.llm import phrases
from colsight.llm.common import stored

SF = "/root/testdata/sf0.001"


def brute(docs, items, window, slop):
    """(n_words, hit words, items met) of each document, by trying every window at every place."""
    lower = lambda t: phrases.words_of(t.encode()) if t else []
    windows = []
    for item_id, text in items:
        words = lower(text)
        windows += [(item_id, words[k : k + window]) for k in range(max(len(words) - window, 0) + 1 if words else 0)]
    result = []
    for _, text in docs:
        words, hit, met = lower(text), set(), set()
        for item_id, asked in windows:
            for at in range(len(words) - len(asked) + 1):
                if all(any(0 <= at + k + d < len(words) and words[at + k + d] == w for d in range(-slop, slop + 1)) for k, w in enumerate(asked)):
                    hit |= set(range(at, at + len(asked)))
                    met.add(item_id)
        result.append((len(words), sorted(hit), sorted(str(m) for m in met if m is not None)))
    return sorted(result, key=repr)


def found(frame):
    return sorted(((r.n_words, [k for s, e in zip(r.starts, r.ends) for k in range(s, e)], list(r.items)) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(("segment_words", "block_bytes"), [(1 << 20, 1 << 20), (30, 60)])
def test_matches_equal_brute_force(spark, segment_words, block_bytes):
    random.seed(6)
    text = lambda n: " ".join(random.choice(["a", "B", "c", "d-e", "é", "7"]) for _ in range(n))
    docs = [(k % 30, text(random.randint(0, 40))) for k in range(60)] + [(None, None), (None, ""), (1, "!!"), (2, text(400))]
    items = [(k % 12, text(random.choice([1, 2, 3, 4, 9]))) for k in range(14)] + [(None, "a B c"), (3, None), (4, " ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).repartition(3)
    index = stored(phrases.build_index(frame, segment_words), "test-index")
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    assert found(phrases.match(index, asked, window=4, block_bytes=block_bytes)) == brute(docs, items, 4, 0)


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity_matches(spark, slop):
    random.seed(slop)
    docs = [(k, " ".join(random.choice("abcdefgh") for _ in range(30))) for k in range(40)]
    items = [(k, " ".join(random.sample("abcdefgh", 3))) for k in range(4)]
    index = phrases.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.doc_id: set(r.items) for r in phrases.match(index, spark.createDataFrame(items, "item_id long, text string"), window=3, slop=slop).collect()}
    exact = brute(docs, items, 3, slop)
    assert sorted(map(sorted, rows.values())) == sorted(m for _, _, m in exact)


def test_query_agrees_with_sql_on_documents(spark):
    assert differences(phrases.op7_phrase_index(spark, SF), connect(SF), phrases.SQL) == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert phrases.match(phrases.build_index(docs.limit(0)), items).count() == 0
    (row,) = phrases.digest(phrases.match(phrases.build_index(docs), items.limit(0))).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
    assert phrases.clean(docs, items).count() == 0 and phrases.clean(docs, items.limit(0)).count() == 1
