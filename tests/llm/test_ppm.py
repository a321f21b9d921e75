import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsight.llm import ppm

SF = "/root/testdata/sf0.001"


def followers(texts, order):
    counts = defaultdict(lambda: defaultdict(int))
    for text in texts:
        for n in range(order + 1):
            for k in range(len(text) - n):
                counts[text[k : k + n]][text[k + n]] += 1
    return {c: dict(f) for c, f in counts.items()}


def brute_bits(tree, alphabet, kept, text, order):
    """Bits by the definition: escape by method C and rule out what longer contexts had, byte by byte."""
    total = 0.0
    for k, byte in enumerate(text):
        n = min(k, order)
        while n and not (text[k - n : k] in kept and all(text[k - m : k] in kept for m in range(1, n))):
            n -= 1
        out, context = set(), text[k - n : k]
        while context not in tree and context:
            context = context[1:]
        while True:
            seen = {b: c for b, c in tree.get(context, {}).items() if b not in out}
            if byte in seen:
                total += math.log2((sum(seen.values()) + len(seen)) / seen[byte])
                break
            if seen:
                total += math.log2((sum(seen.values()) + len(seen)) / len(seen))
            out |= set(seen)
            if not context:
                total += math.log2(256 - len(out))
                break
            context = context[1:]
    return total


@pytest.mark.parametrize("cells", [10**6, 900])
def test_code_lengths_equal_brute_force(cells):
    random.seed(1)
    make = lambda letters, n: bytes(random.choice(letters) for _ in range(n))
    texts = {"x": [make(b"aab ", 60) for _ in range(5)], "y": [make(b"abcc", 50) for _ in range(5)]}
    trees = {lang: followers(t, 3) for lang, t in texts.items()}
    model = ppm.build(trees, 3, cells)
    alphabet = sorted({b for ts in texts.values() for t in ts for b in t})
    kept = set()
    stack = [(b"", 0)]
    while stack:
        context, node = stack.pop()
        kept.add(context)
        for code, further in enumerate(model.child[node]):
            if further:
                stack.append((bytes([alphabet[code]]) + context, further))
    asked = [make(b"abc z", 40), b"", b"a", b"\xff\xfe", make(b"ab", 300)]
    found = ppm.code_lengths(model, asked)
    for row, text in zip(found, asked):
        for at, lang in enumerate(model.languages):
            assert row[at] == pytest.approx(brute_bits(trees[lang], alphabet, kept, text, 3), rel=1e-5, abs=1e-6)


def test_long_texts_in_slices_score_as_whole(monkeypatch):
    tree = {"x": followers([b"abcabcabd" * 30], 3), "y": followers([b"bca" * 50], 3)}
    model = ppm.build(tree, 3, 10**6)
    texts = [b"abcabd" * 50, b"x", b"ab" * 7]
    whole = ppm.code_lengths(model, texts)
    monkeypatch.setattr(ppm, "SLICE", 17)
    assert np.allclose(ppm.code_lengths(model, texts), whole)


def test_held_out_accuracy_on_documents(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = ppm.op5_ppm_language(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and truth[r.doc_id].lang]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in out) >= 0.97 * len(out)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", truth[r.doc_id].text or "")) for r in rows)


def test_nulls_no_letters_clashing_names_and_empty_tables(spark):
    rows = [(k, "the quick brown fox " * 5, "en", "p") for k in range(20)] + [(100 + k, "der schnelle braune fuchs " * 5, "de", "p") for k in range(20)]
    rows += [(1, None, "en", "p"), (None, "der fuchs und der braune", None, "p"), (7, "123 !?", "de", "p"), (7, "", "de", "p"), (8, "the quick fox the brown fox é\U0001f600", None, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = ppm.fit(docs)
    found = ppm.predict(docs.where("doc_id IS NULL OR doc_id < 10"), model, docs.columns)
    by_text = {r.row.text: (r.lang_pred, r.row.lang_pred) for r in found.collect()}
    assert by_text[None] == ("und", "p") and by_text["123 !?"][0] == "und" and by_text[""][0] == "und"
    assert by_text["der fuchs und der braune"][0] == "de" and by_text["the quick fox the brown fox é\U0001f600"][0] == "en"
    nothing = ppm.fit(docs.limit(0))
    assert nothing.languages == [] and {r.lang_pred for r in ppm.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert ppm.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text of a language " * 10).alias("text"), F.lit("x").alias("lang"))
    model = ppm.fit(docs, fit_bytes=20_000)
    assert model.languages == ["x"]


def test_one_long_document_is_learned_within_the_bound(spark):
    random.seed(9)
    words = ["der", "schnelle", "fuchs", "springt", "weit", "hinaus"]
    long = " ".join(random.choices(words, k=350_000))
    docs = spark.createDataFrame([(1, long, "de"), (1, "the quick brown fox jumps " * 9, "en"), (None, "le renard brun saute vite " * 9, "fr")], "doc_id long, text string, lang string")
    model = ppm.fit(docs, fit_bytes=20_000)
    assert model.languages == ["de", "en", "fr"]
    asked = spark.createDataFrame([("der schnelle fuchs",), ("the brown fox",), ("le renard saute",)], "text string")
    assert [r.lang_pred for r in ppm.predict(asked, model, ["text"]).collect()] == ["de", "en", "fr"]


def test_counts_of_tasks_do_not_grow_with_the_partitions(spark):
    texts = [(lang, f"{word} {k % 5} und so weiter") for lang in ("de", "en", "fr") for k, word in enumerate(["haus", "baum"] * 60)]
    wanted = Counter((lang, gram) for lang, text in texts for gram in ppm._grams(text.encode(), 4))
    sample = spark.createDataFrame(texts, "lang string, text string").repartition(40)
    assert ppm.count_in_tasks(sample, 4, 1).count() == len(wanted)
    for parts in (1, 7):
        rows = ppm.count_followers(sample, 4, parts).collect()
        assert {(lang, bytes(gram)): n for lang, gram, n in rows} == wanted
