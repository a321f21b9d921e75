import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colsight.llm import components as components_module
from colsight.llm import simhash
from colsight.llm.common import stored
from colsight.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def print_of(text):
    """The contract, bit by bit."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    listed = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in listed]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows, distance=3):
    prints = [print_of(text) for _, text in rows]
    names = list(range(len(rows)))

    def root(k):
        while names[k] != k:
            k = names[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                names[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return sorted(((d, f"{p:016x}", least.get(root(k))) for k, (d, p) in enumerate(zip((r[0] for r in rows), prints))), key=repr)


def found(frame):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in frame.collect()), key=repr)


def test_equals_brute_force(spark):
    random.seed(5)
    words = [f"{a}{b}" for a in "abcdéf" for b in "XYZ漢"]
    text = lambda n: " \t\n"[n % 3].join(random.choices(words, k=n))
    rows = [(k, text(random.choice([0, 1, 2, 3, 4, 30]))) for k in range(60)]
    for k in range(60, 120):  # copies that drift
        w = random.choice(rows)[1].split()
        rows.append((k % 100, " ".join([*w[:-1], *random.choices(words, k=1)]) if w else "  "))
    rows += [(None, None), (None, "null id alone"), (None, "null id alone"), (3, rows[3][1]), (7, rows[3][1])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("x")).withColumn("value", F.lit(1)).repartition(3)
    assert found(simhash.near_duplicates(frame)) == brute(rows)


def test_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    query = simhash.op12_gray_simhash(spark, SF)
    assert sorted(map(tuple, query.select("doc_id", "fingerprint", "component_id").collect()), key=repr) == brute(rows)


def test_long_texts_are_read_in_slices(monkeypatch):
    random.seed(2)
    text = " ".join(random.choices(["Alpha", "b", "c" * 50, "d\te", "é"], k=400))
    whole = simhash.fingerprint(text.encode())
    assert whole & (1 << 64) - 1 == print_of(text)
    monkeypatch.setattr(simhash, "HASHES", 7)
    for size in (1, 10, 64, 1000):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert simhash.fingerprint(text.encode()) == whole
        assert simhash.fingerprint(b"one two") & (1 << 64) - 1 == print_of("one two")
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def nearby(rng, n, centres, flips):
    """Fingerprints around few centres."""
    fp = rng.choice(rng.integers(0, 1 << 63, centres, np.uint64) * np.uint64(2) + np.uint64(1), n)
    for _ in range(flips):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64))
    return np.unique(fp)


def classes(n, pairs):
    names = list(range(n))
    for a, b in pairs:
        while names[a] != a:
            a = names[a]
        while names[b] != b:
            b = names[b]
        names[max(a, b)] = min(a, b)
    root = []
    for k in range(n):
        root.append(k if names[k] == k else root[names[k]])
    return root


@pytest.mark.parametrize("searches", [1 << 20, 64])
def test_index_finds_all_links(monkeypatch, searches):
    monkeypatch.setattr(simhash, "SEARCHES", searches)
    rng = np.random.default_rng(1)
    for n, flips in ((1, 0), (2, 1), (9, 2), (600, 2), (600, 5)):
        fp = nearby(rng, n, 3, flips)
        groups = np.sort(rng.integers(0, 3, len(fp)))
        index = simhash.GrayIndex(groups, fp)
        pairs = {(int(i), int(j)) for a, b in index.links(3) for i, j in zip(a, b)}
        near = np.bitwise_count(index.fp[:, None] ^ index.fp[None, :]) <= 3
        near &= index.groups[:, None] == index.groups[None, :]
        assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
        a, b = index.stars(3)
        at = {int(f): k for k, f in enumerate(index.fp)} if not (np.diff(np.sort(index.fp)) == 0).any() else None
        assert classes(len(fp), [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]) == classes(len(fp), pairs)


@pytest.mark.parametrize("group", [1 << 16, 40, 3])
def test_crowded_values_are_dealt_again(spark, group):
    fp = nearby(np.random.default_rng(4), 500, 2, 4)
    frame = spark.createDataFrame([(int(f),) for f in fp.view(np.int64)], "fp long")
    dealt = simhash.deal(frame, 3, group)
    roots = {r.node: r.root for r in components(simhash.link(dealt)).collect()}
    near = np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1)
    expected = classes(len(fp), zip(*np.nonzero(near)))
    signed = fp.view(np.int64).tolist()
    named = [roots.get(f, f) for f in signed]
    assert len(set(zip(expected, named))) == len(set(expected)) == len(set(named))
    if group == 3:
        assert dealt.select("mask").distinct().count() > 4


def test_gray_neighbours_differ_by_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    codes ^= codes >> np.uint64(1)
    assert (simhash.gray_rank(codes) == np.arange(256)).all()


def test_components(spark):
    random.seed(3)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(0, k) for k in range(1, 60)]
    loose = [(random.randint(200, 260), random.randint(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in [*chain, *star, *loose] if a != b]
    rows = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = classes(300, edges)
    assert set(rows) == {x for e in edges for x in e}
    assert len({(expected[n], r) for n, r in rows.items()}) == len(set(rows.values())) == len({expected[n] for n in rows})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_few_edges_are_found_in_one_task(spark, monkeypatch):
    """A long path: rounds of contraction and the one task agree, and few edges take no rounds."""
    edges = [(f"n{k}".encode(), f"n{k + 1}".encode()) for k in range(200) if k % 50 != 9]
    frame = spark.createDataFrame(edges, "a binary, b binary")

    def parts(**settings):
        found = {}
        for r in components(frame, **settings).collect():
            found.setdefault(bytes(r.root), set()).add(bytes(r.node))
        return sorted(map(sorted, found.values()))

    rounds = parts(small=0)
    assert len(rounds) == 5 and sum(map(len, rounds)) == 201
    assert parts(small=100) == rounds
    tables = []
    monkeypatch.setattr(components_module, "stored", lambda frame, name: tables.append(name) or stored(frame, name))
    assert parts() == rounds and len(tables) == 2
