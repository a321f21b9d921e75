import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colsight.llm import neardup

SF = "/root/testdata/sf0.001"


def brute_classes(rows, epsilon=neardup.EPSILON, threshold=0.8):
    """Class by row number: every pair of texts that shares a shingle is compared."""
    features = []
    for _, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(5, len(words))
        features.append(Counter((n, *words[k : k + n]) for k in range(len(words) - n + 1)) if n else Counter())
    df = Counter(s for f in features for s in f)
    n_docs = sum(1 for f in features if f)
    weight = lambda s: 1 - math.log(max(epsilon, df[s] / n_docs))
    weighted = [{s: c * weight(s) for s, c in f.items()} for f in features]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k] = parent[parent[k]]
        return k

    by_text = {}
    for k, (_, text) in enumerate(rows):
        if text is not None and by_text.setdefault(text, k) != k:
            parent[root(k)] = root(by_text[text])
    holders = defaultdict(list)
    for k in by_text.values():
        for s in weighted[k]:
            holders[s].append(k)
    pairs = {(a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[:i]}
    margin = 1.0
    for a, b in pairs:
        shared = sum(min(w, weighted[b][s]) for s, w in weighted[a].items() if s in weighted[b])
        sim = shared / (sum(weighted[a].values()) + sum(weighted[b].values()) - shared)
        margin = min(margin, abs(sim - threshold))
        if sim >= threshold:
            parent[root(a)] = root(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[root(k)].append(k)
    classes = {}
    for of in members.values():
        known = [rows[k][0] for k in of if rows[k][0] is not None]
        for k in of:
            classes[k] = min(known) if known else None
    return classes


def found_classes(frame):
    return sorted(((r.doc_id, r.class_id) for r in frame.collect()), key=repr)


def test_classes_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = sorted(((rows[k][0], c) for k, c in brute_classes(rows).items()), key=repr)
    assert found_classes(neardup.op10_minhash_neardup(spark, SF)) == expected
    assert any(a != b for a, b in expected)


def words(*numbers):
    return " ".join(f"w{n}" for n in numbers)


@pytest.mark.parametrize("bounded", [2, 1000])
def test_chains_and_outsiders_of_a_bucket_are_linked(spark, monkeypatch, bounded):
    monkeypatch.setattr(neardup, "BOUNDED", bounded)
    # One key for all texts: leader, border members and outsiders are all compared.
    base = list(range(100))
    texts = [words(*base[: 100 - k], *range(1000 + k, 1000 + 2 * k)) for k in range(0, 40, 2)]
    texts += [words(*range(5000 + 200 * k, 5100 + 200 * k)) for k in range(12)]
    texts += [words(*range(5000 + 200 * k, 5099 + 200 * k), 9) for k in range(12)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = spark.sparkContext.broadcast(neardup.Weights(*neardup.frequent_shingles(docs)))
    signed = neardup.sign(docs, weights).withColumn("keys", F.array(F.lit(7).cast("long")))
    labels = {bytes(r.tid): bytes(r.label) for r in neardup.link(signed, docs, weights, pivots=2).collect()}
    tids = {r.doc_id: bytes(r.tid) for r in signed.collect()}
    of = {k: labels.get(tids[k], tids[k]) for k, _ in rows}
    brute = brute_classes(rows)
    for a in of:
        for b in of:
            assert (of[a] == of[b]) == (brute[a] == brute[b]), (a, b)


def test_nulls_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "  "), (6, "a b"), (7, "A, b!"), (7, "a b"), (None, "a b"), (9, "c"), (None, None), (8, words(*range(9)) + " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit(1)).withColumn("tid", F.lit(2))
    found = found_classes(neardup.near_duplicates(docs))
    assert found == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (7, 6), (None, 6), (9, 9), (None, None), (8, 8)], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 0


@pytest.mark.parametrize("size", [5, 400])
def test_frequent_shingles_are_exact(spark, size):
    rows = [(k, words(*range(8), *range(100 + 20 * k, 110 + 20 * k)) if k % 3 else words(*range(900, 912))) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shingles, counts, n = neardup.frequent_shingles(docs, epsilon=0.05, chunk=300, proposals=7)
    assert n == size
    df = Counter(s for _, t in rows for s in {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    assert sorted(counts.tolist()) == sorted(c for c in df.values() if c >= 0.05 * size)
    assert len(set(shingles.tolist())) == len(shingles)


def test_bounds_of_a_large_bucket_do_not_hold_in_a_small_one(spark, monkeypatch):
    """x lies in a large bucket without y, and both in a small one that another text leads."""
    monkeypatch.setattr(neardup, "BOUNDED", 4)
    tid = lambda text: hashlib.md5(text.encode()).digest()
    x, y = words(*range(100)), words(*range(99), 9999)
    lead = next(t for k in range(1000) if tid(t := words(*range(20000 + 50 * k, 20040 + 50 * k))) < min(tid(x), tid(y)))
    others = [words(*range(1000 * k, 1000 * k + 60)) for k in range(1, 7)]
    rows = list(enumerate([x, y, lead, *others]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = spark.sparkContext.broadcast(neardup.Weights(*neardup.frequent_shingles(docs)))
    keys = F.when(F.col("doc_id") == 0, F.array(F.lit(7), F.lit(8))).when(F.col("doc_id") < 3, F.array(F.lit(8))).otherwise(F.array(F.lit(7)))
    signed = neardup.sign(docs, weights).withColumn("keys", keys.cast("array<bigint>"))
    labels = {bytes(r.tid): bytes(r.label) for r in neardup.link(signed, docs, weights).collect()}
    assert set(labels) == {tid(x), tid(y)} and len(set(labels.values())) == 1


def test_a_shared_passage_alone_joins_nothing_and_near_copies_are_found(spark, monkeypatch):
    """One bucket of texts that share half of their words; each has one near copy."""
    monkeypatch.setattr(neardup, "BOUNDED", 4)
    passage = range(60)
    texts = [words(*passage, *range(1000 * k, 1000 * k + 60)) for k in range(1, 30)]
    texts += [words(*passage, *range(1000 * k, 1000 * k + 58), 7, 7) for k in range(1, 30)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = spark.sparkContext.broadcast(neardup.Weights(*neardup.frequent_shingles(docs)))
    signed = neardup.sign(docs, weights).withColumn("keys", F.array(F.lit(7).cast("long")))
    labels = {bytes(r.tid): bytes(r.label) for r in neardup.link(signed, docs, weights, pivots=3).collect()}
    tids = {r.doc_id: bytes(r.tid) for r in signed.collect()}
    of = {k: labels.get(tids[k], tids[k]) for k, _ in rows}
    brute = brute_classes(rows)
    assert len(set(brute.values())) == 29
    assert all((of[a] == of[b]) == (brute[a] == brute[b]) for a in of for b in of)
