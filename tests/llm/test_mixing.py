import random
from collections import Counter

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from colsight.llm import mixing

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while len(target) < len(sizes):
        free = [s for s in sizes if s not in target]
        rest, whole = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / whole > ceiling * sizes[s]]
        target |= {s: ceiling * sizes[s] for s in over} if over else {s: rest * weight[s] / whole for s in free}
    return target


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("row", F.lit(None).cast("string"))


@pytest.mark.parametrize(("leaf", "fan"), [(200, 2), (200, 1024), (10**6, 1024)])
def test_sources_come_near_their_targets_at_any_depth(spark, leaf, fan):
    random.seed(8)
    rows = [(k, random.choice(["a"] * 8 + ["b", "c", None, "é"]), random.choice([0, 1, 5, 40, 90])) for k in range(900)]
    found = mixing.mix(sized(spark, rows), block=4, leaf=leaf, fan=fan).collect()
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    target, taken = brute_targets(sizes), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.passes * r.size + r.wrap_end + r.cut_end - r.cut and 0 <= r.cut <= r.cut_end <= r.size
        taken[r.source] += r.taken
    assert len(found) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 8 + 0.02 * target[s] for s in sizes)
    again = mixing.mix(sized(spark, rows).repartition(7), block=4, leaf=leaf, fan=fan).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)


def test_apportionment_is_sainte_lague(spark):
    random.seed(3)
    for _ in range(4):
        votes = [random.choice([0, 1, 7, 50, 333, 1000]) for _ in range(9)]
        house = random.randint(0, sum(votes) // 20 + 1)
        parties = [("g", k, float(v), house, 3 * v) for k, v in enumerate(votes)]
        frame = spark.createDataFrame(parties, "g string, party int, votes double, house long, most long")
        seats = {r.party: r.seats for r in mixing.apportion(frame, ["g"], ["party"], []).collect()}
        quotients = sorted(((v / (2 * k + 1), -p) for p, v in enumerate(votes) for k in range(3 * v)), reverse=True)[:house]
        assert seats == {p: sum(-q[1] == p for q in quotients) for p in range(len(votes))}


def test_query_agrees_with_sql_on_documents(spark):
    assert differences(mixing.op9_mix_sources(spark, SF), connect(SF), mixing.SQL) == []


def test_copies_hold_what_is_taken(spark):
    docs = spark.createDataFrame([(k, f"w{k} x  y\nz q{k} r", "s" if k % 5 else None, 9, "m") for k in range(60)] + [(99, None, "s", 0, "m"), (98, "  ", "s", 2, "m")], "doc_id long, text string, source string, n_chars long, size string")
    rows = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    mixed = mixing.mix(rows, weights=(1, 3), block=2).cache()
    out = mixing.copies(mixed, docs.columns)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text) and r.size == "m"
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, None, 3), (None, None, 3), (1, "a", 0), (1, "a", 0), (2, "b", 7)]
    found = mixing.mix(sized(spark, rows)).collect()
    assert sum(r.taken for r in found) == 13 and len(found) == 5
    assert mixing.mix(sized(spark, []).limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(sized(spark, [(1, "a", 0)])).collect()} == {0}
