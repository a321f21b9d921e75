import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from colsight.llm import collocations

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, lang string, text string"


def brute(rows, min_count, subsumed, top):
    """The contract, phrase by phrase."""
    counts, words = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts[lang].update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    result = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in candidates.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(100 * b >= subsumed * a for q, b in candidates.items() if inside(q)):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(result)


def made(seed):
    random.seed(seed)
    words = ["New", "york", "CITY", "of", "é", "x-1", "the", "the", "漢", "a"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]
    text = lambda: "".join(random.choice(words) + random.choice(marks) for _ in range(random.choice([0, 1, 9, 60])))
    rows = [(k % 5, random.choice(["en", "en", "de", None, "und", ""]), text()) for k in range(150)]
    return [*rows, (None, None, None), (1, "xx", ""), (1, "fr", "only once"), (7, "en", "the the the the the " * 40), *rows[:9]]


@pytest.mark.parametrize(("chunk", "bits"), [(1 << 21, 1 << 28), (37, 1 << 28), (400, 1 << 16)])
def test_equals_brute_force(spark, monkeypatch, chunk, bits):
    monkeypatch.setattr(collocations, "MAX_BITS", bits)
    rows = made(4)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("x")).repartition(3)
    found = collocations.collocations(frame, top=60, min_count=5, chunk=chunk)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 80, 60)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("limit", [5, 16, 40, 1000])
def test_cut_texts_have_the_phrases_of_the_whole(limit):
    random.seed(limit)
    for _ in range(60):
        text = "".join(random.choice(["aa", "b", "cdefghijklmnop", " ", " ", "  ", "\t", ". "]) for _ in range(random.randint(0, 80))).encode()
        whole, parts = Counter(), Counter()
        for count, given in ((whole, [(text, 0)]), (parts, collocations.cut(text, limit))):
            for part, counted in given:
                chunk = collocations.Chunk("en", part, counted)
                listed = chunk.words().to_pylist()[::2]
                for size in range(1, 5):
                    count.update(tuple(listed[i : i + size]) for i in np.flatnonzero(chunk.phrases(size)))
        assert whole == parts


def test_hashes_depend_on_the_word_alone():
    by = collocations.Hash(collocations.BASES[0])
    chunk = collocations.Chunk("en", b"ab ba ab  abc ab\tba", 0)
    h = chunk.hashes(by)
    assert h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 3
    assert (collocations.Chunk("de", b"ab", 0).hashes(by) != h[:1]).all()


def test_collisions_of_the_first_hash_are_told_apart():
    first, second = np.array([7, 7, 7, 3, 7], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    found = sorted((int(first[i]), int(second[i]), int(n)) for at, ns in collocations._same(first, second) for i, n in zip(at, ns))
    assert found == [(3, 1, 1), (7, 1, 2), (7, 2, 2)]


def test_bitmaps_leave_nothing_out(spark, monkeypatch):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000, np.int64) * np.where(rng.random(5000) < 0.5, 1, -1)
    frame = spark.createDataFrame(pa.table({"h": h}))
    for bits in (1 << 28, 1 << 16):
        monkeypatch.setattr(collocations, "MAX_BITS", bits)
        sent = collocations.bitmap(frame)
        assert sent.value.has(h.view(np.uint64)).all()
        assert sent.value.has(rng.integers(0, 1 << 63, 5000, np.uint64)).mean() < 0.05


def test_query_agrees_with_sql_on_documents(spark):
    frame = collocations.op11_phrase_stripes(spark, SF)
    assert frame.count() > 100
    assert differences(frame, connect(SF), collocations.SQL) == []


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hashes_hold_the_powers_of_a_block_and_no_more():
    """A chunk of many blocks; a word longer than a block is hashed as any other."""
    by = collocations.Hash(collocations.BASES[0])
    text = b"ab cd\tx" * (8 * collocations.BLOCK // 7) + b" ab"
    found = collocations.Chunk("en", text, 0).hashes(by)
    assert found[0] == found[-1] and len(set(found.tolist())) == 4  # ab, cd, xab, x
    assert len(by.powers) + len(by.inverses) <= 2 * collocations.BLOCK
    long = b"y" * (collocations.BLOCK + 5)
    found = collocations.Chunk("en", b"ab " + long + b" cd " + long, 0).hashes(by)
    assert found[1] == found[3] and found[0] == collocations.Chunk("en", b"ab", 0).hashes(by)[0]


def test_a_task_sends_no_more_rows_than_words(spark):
    """However many phrases are frequent: a row a word with all that follows it, and one for all words; each phrase once."""
    random.seed(2)
    text = " ".join(random.choice("abcdefghijkl") for _ in range(20_000)).encode()
    frame, every = SimpleNamespace(made=None), SimpleNamespace(value=SimpleNamespace(has=lambda h: np.ones(len(h), bool)))
    frame.mapInArrow = lambda build, schema: setattr(frame, "made", build) or MagicMock()
    collocations.mine_stripes(frame, [every] * 3, 1 << 21)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text], pa.binary())], names=["lang", "text"])
    rows = [row for made in frame.made(iter([batch])) for row in made.to_pylist()]
    assert len(rows) == 13
    words = text.decode().split()
    counts = Counter(tuple(words[i : i + size]) for size in range(1, 5) for i in range(len(words) - size + 1))
    assert sum(len(row["ns"]) for row in rows) == len(counts) + 1
    sent = {(word, *(rest or "").split()): n for _, word, nexts, ns in map(dict.values, rows) for rest, n in zip(nexts, ns) if word}
    assert sent == counts


def test_words_of_languages_are_told_apart_by_hashes():
    """'ie' differs from 'de' by as much as 'en' from 'es'."""
    by = collocations.Hash(collocations.BASES[0])
    hashes = lambda lang, word: int(collocations.Chunk(lang, word, 0).hashes(by)[0])
    assert hashes("es", b"de") != hashes("en", b"ie")


def sent(monkeypatch, texts, min_count):
    """Entries of the last pass's stripes that tasks send, a task a list of texts."""
    found = []
    mine = collocations.mine_stripes

    def watched(frame, *rest):
        seen = SimpleNamespace(mapInArrow=lambda build, schema: found.append(frame.mapInArrow(build, schema).collect()) or MagicMock())
        mine(seen, *rest)
        return mine(frame, *rest)

    monkeypatch.setattr(collocations, "mine_stripes", watched)
    rows = collocations.collocations(texts, top=10_000, min_count=min_count).collect()
    return rows, sum(len(row.ns) for row in found[0] if row.word)


def test_a_phrase_is_named_once_however_many_tasks_hold_it(spark, monkeypatch):
    """Entries grow with the frequent phrases, not with those times the tasks."""
    random.seed(3)
    rows = [(k, "en", " ".join(random.choice("abcdefghij") for _ in range(300)) + f" {k}") for k in range(64)]
    texts = spark.createDataFrame(rows, SCHEMA).repartition(16)
    found, entries = sent(monkeypatch, texts, 10)
    assert sorted(map(tuple, found)) == brute(rows, 10, 80, 10_000)
    counts = Counter(tuple(w[i : i + m]) for _, _, text in rows for w in [text.split()] for m in range(1, 5) for i in range(len(w) - m + 1))
    frequent = sum(n >= 10 for n in counts.values())
    assert frequent <= entries < 1.5 * frequent


def test_collisions_of_the_first_hash_are_counted_apart():
    h, g = np.array([7, 3, 7, 7, 7], np.uint64), np.array([2, 1, 1, 2, 1], np.uint64)
    n, marks, word = np.array([1, 2, 3, 4, 5]), np.array([9, 8, 7, 6, 5]), h + np.uint64(1)
    found = [tuple(map(int, row)) for row in zip(*collocations._summed(h, g, n, marks, word))]
    assert found == [(3, 1, 2, 8, 4), (7, 1, 8, 5, 8), (7, 2, 5, 6, 8)]
