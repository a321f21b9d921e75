import math
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from colsight.llm import ngrams

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Brute:
    """The same model from dictionaries, without quantisation."""

    def __init__(self, texts, least):
        runs = [tokens(t) for t in texts]
        grams = [Counter(tuple(r[k : k + n]) for r in runs for k in range(len(r) - n + 1)) for n in (1, 2, 3)]
        self.n, self.v, self.c = sum(grams[0].values()), len(grams[0]), grams[0]
        self.one = {g: c for g, c in grams[0].items() if c >= least}
        self.two = {g: c for g, c in grams[1].items() if c >= least}
        self.three = {g: c for g, c in grams[2].items() if c >= least}
        self.back = {}
        for table, lower in ((self.two, lambda g: self.p1(g[1:])), (self.three, self.p2)):
            sums = {}
            for g in table:
                high, low = sums.get(g[:-1], (0, 0))
                sums[g[:-1]] = high + self.kept(g), low + lower(g[-2:])
            self.back |= {h: math.log10(max(1 - high, 1e-6) / max(1 - low, 1e-6)) for h, (high, low) in sums.items()}

    def p1(self, g):
        return (self.c.get(g, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))

    def kept(self, g):
        return (self.two[g] - 0.5) / self.one[g[:1]] if len(g) == 2 else (self.three[g] - 0.5) / self.two[g[:2]]

    def p2(self, g):
        return self.kept(g) if g in self.two else 10 ** (self.back.get(g[:1], 0) + math.log10(self.p1(g[1:])))

    def score(self, text):
        run, total = tokens(text), 0.0
        for k in range(len(run)):
            g3, g2 = tuple(run[max(0, k - 2) : k + 1]), tuple(run[max(0, k - 1) : k + 1])
            if len(g3) == 3 and g3 in self.three:
                total += math.log10(self.kept(g3))
            elif len(g2) == 2:
                total += (self.back.get(g3[:2], 0) if len(g3) == 3 else 0) + math.log10(self.p2(g2))
            else:
                total += math.log10(self.p1(g2))
        return total


@pytest.mark.parametrize(("levels", "a_token"), [(256, 0.02), (1 << 20, 1e-5)])
def test_scores_of_documents_equal_brute_force_but_for_quantisation(spark, monkeypatch, levels, a_token):
    monkeypatch.setattr(ngrams, "LEVELS", levels)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    brute = Brute([t for k, t in texts.items() if not held[k]], 2)
    rows = ngrams.op2_trie_scores(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        run = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(run), brute.n)
        assert r.n_known == sum((t,) in brute.c for t in run)
        assert r.base_score == pytest.approx(sum(math.log10(brute.p1((t,))) for t in run), rel=1e-9)
        assert r.score == pytest.approx(brute.score(texts[r.doc_id]), abs=a_token * (len(run) + 5))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_elias_fano_keeps_and_finds_values():
    random = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (50, 3), (2000, 10**6), (3000, 2**45)):
        values = np.sort(random.integers(0, top + 1, n))
        coded = ngrams.EliasFano(ngrams.EliasFano.encode(values, "x"), "x")
        assert np.array_equal(coded.get(np.arange(n)), values)
        asked = np.concatenate([values, random.integers(0, top + 2, 50)])
        begin, end = random.integers(0, n + 1, len(asked)), random.integers(0, n + 1, len(asked))
        found = coded.find(asked, begin, end)
        for v, b, e, place in zip(asked, begin, end, found):
            assert (place >= 0) == (v in values[b:e])
            if place >= 0:
                assert b <= place < e and values[place] == v


def test_successors_in_a_crowded_bucket_are_found():
    """Many low values beside a far one: nearly all share one high part."""
    values = np.append(np.arange(0, 60_000, 2), 10**12)
    coded = ngrams.EliasFano(ngrams.EliasFano.encode(values, "x"), "x")
    asked = np.arange(60_000)
    found = coded.find(asked, np.zeros(60_000, np.int64), np.full(60_000, len(values)))
    assert np.array_equal(found, np.where(asked % 2, -1, asked // 2))
    assert list(coded.find(asked[:4], np.full(4, 1), np.full(4, 2))) == [-1, -1, 1, -1]


def test_levels_are_compact():
    random = np.random.default_rng(1)
    keys = np.unique(random.integers(0, 1000, 60_000) << 32 | random.integers(0, 1000, 60_000))
    counts = ngrams.Counts(10**6, 1000, np.arange(1000, dtype=np.uint64), np.full(1000, 500), keys, np.full(len(keys), 3), np.zeros(0, np.int64), np.zeros(0, np.int64))
    block = ngrams.build_trie(counts)
    assert len(block) < 5 * len(keys)
    trie = ngrams.Trie(block)
    asked = random.integers(0, 1000, (2, 5000))
    found = trie.follow(0, asked[0], asked[1])
    known = np.isin(asked[0] << 32 | asked[1], keys)
    assert np.array_equal(found >= 0, known) and np.array_equal(keys[found[known]], (asked[0] << 32 | asked[1])[known])


def test_nulls_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "A a b"), (1, None), (None, ""), (2, "zz"), (None, "a b")], "doc_id long, text string")
    counts, words = ngrams.count_ngrams(docs.where("doc_id = 1"), share=0.9)
    assert (counts.n_tokens, counts.n_types) == (5, 3)
    rows = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in ngrams.score(docs, counts, words).collect())
    p = lambda c: math.log10((c + 0.5) / 7)
    assert rows == sorted([(4, 4, round(2 * p(2) + p(1) + p(2), 6)), (1, 1, round(p(2), 6)), (1, 1, round(p(2), 6)), (2, 1, round(p(0) + p(2), 6)), (3, 3, round(2 * p(2) + p(1), 6))])
    counts, words = ngrams.count_ngrams(docs.limit(0))
    assert ngrams.score(docs.limit(0), counts, words).count() == 0
    assert {r.n_known for r in ngrams.score(docs, counts, words).collect()} == {0}


def test_what_is_kept_does_not_depend_on_the_size_of_the_corpus(spark):
    """Two million other tokens and many parts, some words spread over several: a pair seen twice still counts."""
    few = ["p q r", "p q s", "x p q r", "the p q", None, ""] + [f"the w{k % 7} of the w{k % 11}" for k in range(60)]
    many = " ".join(["z"] * 2_300_000)
    train = spark.createDataFrame([(t,) for t in few + [many]], "text string").repartition(3)
    docs = spark.createDataFrame([*enumerate(few), (70, "p q r"), (71, "q"), (72, "new p q of the w3")], "doc_id long, text string")
    brute = Brute(few + [many], 2)
    counts, words = ngrams.count_ngrams(train, part_tokens=200_000)
    assert counts.parts.n > 10 and len(counts.parts.hot)
    rows = ngrams.score(docs, counts, words).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(brute.score(texts[r.doc_id]), abs=1e-4 * (r.n_tokens + 5))
    counts, words = ngrams.count_ngrams(train.where("text is null or length(text) < 1000"), part_tokens=20, share=0.2)
    assert counts.parts.n > 10 and len(counts.parts.hot) > 1
    brute = Brute(few, 2)
    for r in ngrams.score(docs, counts, words).collect():
        assert r.score == pytest.approx(brute.score(texts[r.doc_id]), abs=1e-4 * (r.n_tokens + 5))


def test_a_pair_in_half_of_the_tokens_is_spread(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK", 100)
    texts = [" ".join(f"of the w{(k * j) % 37}" for j in range(20)) for k in range(120)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    docs = spark.createDataFrame([*enumerate(texts), (200, "of the w3 of the new")], "doc_id long, text string")
    counts, words = ngrams.count_ngrams(train, part_tokens=300)
    brute = Brute(texts, 2)
    parts = counts.parts
    pair = parts.pair_spreads(*(np.array([ngrams.Hashes()[w]], np.int64) for w in (b"of", b"the")))[0]
    assert parts.n > 20 and pair > 6
    for training in (True, False):
        blocks = ngrams.blocks_of(train.selectExpr("cast(text as binary) AS text"), parts, counts.frequent, training)
        rows = [r["sum(n)"] for r in blocks.groupBy("part").sum("n").collect()]
        assert max(rows) < sum(rows) / 4
    for r in ngrams.score(docs, counts, words).collect():
        text = "of the w3 of the new" if r.doc_id == 200 else texts[r.doc_id]
        assert r.score == pytest.approx(brute.score(text), abs=1e-4 * (r.n_tokens + 5))


def test_frequent_words_are_bounded_and_places_are_found(spark):
    words = spark.createDataFrame([(k, 1 + 1000 // k) for k in range(1, 2000)], "hash long, n long")
    keys, n = ngrams.frequent_words(words, 100)
    assert 50 < len(keys) <= 100 and n.min() > 1 and list(keys) == sorted(keys)
    assert len(ngrams.frequent_words(words, 0)[0]) == 0
    asked = np.array([-5, 1, 3, 5000])
    assert list(ngrams._places(asked, keys)) == [-1, 0, 2, -1]


def blocks_peak(module, training):
    """Bytes a token that a task holds at most while it makes blocks of a chunk."""
    texts = [" ".join(f"w{(k * k + 7 * j) % 3001}" for j in range(500)).encode() for k in range(200)]
    parts = module.Parts(8, np.zeros(0, np.int64), np.zeros(0, np.int64))
    frame, sent = SimpleNamespace(mapInArrow=lambda f, schema: f), SimpleNamespace(value=np.zeros(0, np.int64))
    blocks = module.blocks_of(frame, parts, sent, training)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    list(blocks(iter([batch.slice(0, 1)])))  # imports
    tracemalloc.start()
    n = sum(1 for _ in blocks(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / (501 * len(texts))
    tracemalloc.stop()
    assert n == 8
    return peak


@pytest.mark.parametrize(("training", "most"), [(True, 115), (False, 150)])
def test_blocks_are_made_of_narrow_columns(training, most):
    assert blocks_peak(ngrams, training) < most


def test_words_are_hashed_within_texts_as_alone():
    words = ["a", "Ab", "é漢", "x" * 7, "x" * 8, "x" * 9, "y" * 16, "y" * 17, "z" * 63, "z" * 64, "z" * 65, "z" * 5000, "\0", "\0\0", "a\0"]
    texts = ["", " \t", *words, " ".join(words), "\x0b".join(reversed(words)) + "\r\n", "", "a", ""]
    found, begins = ngrams._numbered([t.encode() for t in texts])
    alone = ngrams.Hashes()
    runs = [[ngrams.END if w is None else alone[w.encode()] for w in tokens(t)] for t in texts]
    assert found.tolist() == [h for run in runs for h in run]
    assert begins.tolist() == [sum(map(len, runs[:k])) for k in range(len(runs))]
    assert len(set(found.tolist())) == len(words) + 1


def counted(module, texts):
    """What is counted in one part, and the bytes a token held at most."""
    made = []
    frame, sent = SimpleNamespace(mapInArrow=lambda f, schema: f), SimpleNamespace(value=np.zeros(0, np.int64))
    parts = module.Parts(1, np.zeros(0, np.int64), np.zeros(0, np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    blocks = pa.Table.from_batches(module.blocks_of(frame, parts, sent, True)(iter([batch])))

    class Grouped:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, f, schema):
            made.append(f)
            raise InterruptedError

    with pytest.raises(InterruptedError):
        module.count_grams(SimpleNamespace(mapInArrow=lambda f, schema: Grouped()), parts, sent)
    tracemalloc.start()
    rows = made[0](blocks)
    peak = tracemalloc.get_traced_memory()[1] / sum(blocks["n"].to_pylist())
    tracemalloc.stop()
    return rows, peak


def test_a_part_is_counted_in_slices(monkeypatch):
    texts = [" ".join(f"w{(k * k + 7 * j * j) % 3001}" for j in range(500)).encode() for k in range(100)] * 2
    monkeypatch.setattr(ngrams, "CHUNK", 20_000)
    expected, _ = counted(ngrams, texts)
    monkeypatch.setattr(ngrams, "SLICE", 10_000, raising=False)
    rows, peak = counted(ngrams, texts)
    of = lambda t: sorted(map(str, t.to_pylist()))
    assert of(rows) == of(expected) and rows.num_rows > 1000
    assert peak < 60, peak
