from collections import Counter

import corpus_pipeline
import pytest
from oracle import connect
from pyspark.sql import functions as F
from test_neardup import brute_classes
from test_tokens import expected

from colsight.llm import phrases

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EXTRA = [(900001, None, "en", "src0", 0), (900002, "123 456 !!", "en", "src0", 10), (900003, "", None, None, None), (900004, "12 ...", None, "x", 6)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, as the pipeline runs them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(EXTRA, docs.schema))
    seen, folder = {}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect(), out.collect(), out.columns, f"{folder}/{name}"
        docs = out
    return seen


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(stages[name][2] == COLUMNS for name, _ in corpus_pipeline.STAGES[:-1])


def test_language_id_drops_documents_without_letters(stages):
    before, after, _, _ = stages["language_id"]
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if any(c.isalpha() for c in r.text or ""))


def test_one_document_of_each_class_stays(stages):
    before, after, _, _ = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before]
    assert sorted(r.doc_id for r in after) == sorted(set(brute_classes(rows).values()))
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) < len(before)


def test_contaminated_documents_go(stages):
    before, after, _, _ = stages["decontamination"]
    connection = connect(SF)
    connection.execute("CREATE OR REPLACE TEMP TABLE before (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO before VALUES (?, ?)", [(r.doc_id, r.text) for r in before])
    hit = {r[0] for r in connection.execute(phrases.SQL.replace("FROM documents", "FROM before")).fetchall() if r[5]}
    assert hit and sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id not in hit)


def test_sources_come_near_their_targets(stages):
    before, after, _, _ = stages["mixing"]
    size = Counter()
    for r in before:
        size[r.source] += len(r.text.split())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    target, free = {}, set(size)
    while free:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        if not (over := {s for s in free if share[s] > 3 * size[s]}):
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    taken, of_doc = Counter(), Counter()
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        taken[r.source] += len(r.text.split())
        of_doc[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or set(r.text.split()) <= set(texts[r.doc_id].split())
    assert all(abs(taken[s] - target[s]) <= max(64, 0.02 * target[s]) for s in size)
    assert all(n <= 3 * len(texts[k].split()) for k, n in of_doc.items())


def test_token_files_hold_the_mix(stages):
    before, after, _, _ = stages["token_files"]
    rows = sorted(((r.doc_id, r.text) for r in before))
    assert sorted(tuple(r) for r in after) == sorted(expected(rows))


def test_run_gives_the_same_rows_again(spark):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_other_columns_of_any_name_and_long_texts_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = docs.limit(1).withColumns({"doc_id": F.lit(900009).cast("long"), "text": F.repeat(F.lit("some words of a long text, "), 40_000)})
    docs = docs.unionByName(long)
    clashing = ["row", "size", "tid", "h", "k", "keys", "label", "id", "digest", "lang_pred", "score", "ids", "start"]
    docs = docs.select("*", *[F.lit(f"<{name}>").alias(name) for name in clashing])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert out.where(" OR ".join(f"`{c}` <> '<{c}>' OR `{c}` IS NULL" for c in clashing)).count() == 0 < out.count()
            # The mix may take a part of it.
            assert name == "mixing" or out.where("length(text) > 1000000").count() == 1
        docs = out


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
