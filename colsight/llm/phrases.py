"""Benchmark decontamination by a positional inverted index over the training tokens.

The index is cut by documents: each row is a segment of about `segment_words` tokens with its own dictionary and the
positions of every term, so no term, however frequent, meets in one place, and building it needs no shuffle. Test
items become windows of consecutive words; a segment is asked for a window from its rarest term on: that term's
positions, shifted by its offset, are cut down by each further term's positions. With `slop` 0 what remains are
exact phrases; otherwise each term may stand up to `slop` positions from its place. Items are asked in blocks of
bounded bytes, so what is sent to the executors never grows with the test set.

Defined cases: null and empty texts have no words; an item without words has no window; items that share an item_id
count as one, and a null item_id marks words but is not listed; each row of documents is judged by itself, whatever
its doc_id; empty tables give empty or clean results. Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.common import stored, table

WINDOW = 10
SEGMENT_WORDS = 1 << 20
#: Bytes of test items asked at once.
BLOCK_BYTES = 16 << 20
#: Unused positions between the documents of a segment; `slop` stays below.
GAP = 64
#: Bytes that are no part of a word become spaces, A-Z becomes a-z, bytes of non-ASCII characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "segment bigint, doc_ids array<{id}>, n_words array<int>, terms binary, counts binary, postings binary"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


def _packed(numbers: np.ndarray) -> bytes:
    """Four planes of bytes: small numbers leave three that compress to nothing."""
    return np.ascontiguousarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the documents' (doc_id, text) words. To be stored before it is asked: a segment's number comes from
    the task that makes it."""

    def segment(number: int, ids: list[Any], texts: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, texts), np.int32, len(texts))
        words = [w for text in texts for w in text]
        lookup = {w: k for k, w in enumerate(dict.fromkeys(words))}
        codes = np.fromiter(map(lookup.__getitem__, words), np.int32, len(words))
        counts = np.bincount(codes, minlength=len(lookup)).astype(np.int32)
        places = np.arange(len(words), dtype=np.int32) + np.repeat(np.arange(len(texts), dtype=np.int32) * GAP, sizes)
        listed = places[np.argsort(codes, kind="stable")]
        steps = np.diff(listed, prepend=np.int32(0))
        firsts = (np.cumsum(counts) - counts)[: len(lookup)]
        steps[firsts] = listed[firsts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(kind)),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([b" ".join(lookup)], pa.binary()),
                pa.array([_packed(counts)], pa.binary()),
                pa.array([_packed(steps)], pa.binary()),
            ],
            names=["segment", "doc_ids", "n_words", "terms", "counts", "postings"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId() << 32, 0
        ids: list[Any] = []
        texts: list[list[bytes]] = []
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(words_of(text.as_py()))
                total += len(texts[-1])
                if total >= segment_words or len(ids) >= segment_words:
                    yield segment(number, ids, texts, kind)
                    number, total, ids, texts = number + 1, 0, [], []
        if ids:
            yield segment(number, ids, texts, kind)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, INDEX.format(id=kind))


class Windows:
    """The distinct windows of a block of items, by length, and the items that each stands for."""

    def __init__(self, items: list[tuple[Any, bytes]], window: int) -> None:
        found: dict[tuple[bytes, ...], set[int]] = {}
        self.item_ids = [None if k is None else str(k) for k, _ in items]
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            for at in range(max(len(words) - window, 0) + 1 if words else 0):
                found.setdefault(tuple(words[at : at + window]), set()).add(k)
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for words in found for w in words))}
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for words in found:
            by_length.setdefault(len(words), []).append(words)
        self.groups = [
            (np.array([[self.vocabulary[w] for w in words] for words in group], np.int32), [sorted(found[words]) for words in group])
            for _, group in sorted(by_length.items())
        ]


def _occurrences(terms: np.ndarray, positions: Any, counts: np.ndarray, slop: int) -> np.ndarray:
    """Starts of a window in a segment, from its rarest term on."""
    starts = None
    for at in np.argsort(counts[terms], kind="stable").tolist():
        listed = positions(terms[at])
        if starts is None:
            starts = np.unique(listed - at + np.arange(-slop, slop + 1)[:, None]) if slop else listed - at
            continue
        near = np.searchsorted(listed, starts + (at - slop))
        within = near < len(listed)
        starts, near = starts[within], near[within]
        starts = starts[listed[near] <= starts + (at + slop)]
        if not len(starts):
            break
    return starts


def match(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, items (sorted ids of the items met), and the runs of hit words as
    `starts` and `ends` (word numbers, end exclusive)."""
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    spark = index.sparkSession
    items = items.select("item_id", F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    kind = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    schema = f"segment bigint, doc_no int, doc_id {kind}, n_words int, items array<string>, starts array<int>, ends array<int>"

    def asked(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()  # bounded by block_bytes
        sent = spark.sparkContext.broadcast(Windows([(r[0], bytes(r[1])) for r in rows if r[1]], window))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    yield _ask(batch.slice(k, 1), windows, slop)

        return index.mapInArrow(ask, schema)

    found = asked(0)
    if n_blocks == 1:
        return found.drop("segment", "doc_no")
    for block in range(1, n_blocks):
        found = found.unionByName(asked(block))
    runs = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    merged = F.aggregate(
        runs,
        F.array().cast("array<struct<starts:int,ends:int>>"),
        lambda done, run: F.when((F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= run["starts"]), F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["ends"], run["ends"]).alias("ends"))),
        )).otherwise(F.concat(done, F.array(run))),
    )
    return (
        found.groupBy("segment", "doc_no")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            merged.alias("runs"),
        )
        .select("doc_id", "n_words", "items", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"))
    )


def _ask(row: pa.RecordBatch, windows: Windows, slop: int) -> pa.RecordBatch:
    segment, n_words = row.column(0)[0].as_py(), np.asarray(row.column(2)[0].values)
    counts, steps = _unpacked(row.column(4)[0].as_py()), _unpacked(row.column(5)[0].as_py())
    terms = row.column(3)[0].as_py().split(b" ") if len(counts) else []
    ends = np.cumsum(counts)
    # Test terms by their number here; absent ones point at an empty list behind the last.
    here = np.full(len(windows.vocabulary), len(counts), np.int64)
    for k, term in enumerate(terms):
        if (at := windows.vocabulary.get(term)) is not None:
            here[at] = k
    counts = np.append(counts, 0)
    width = n_words + GAP
    firsts = np.cumsum(width, dtype=np.int64) - width
    marks = np.zeros(int(firsts[-1] + width[-1]) + 1 if len(firsts) else 1, np.int32)
    met: dict[int, set[str]] = {}
    positions = lambda t: np.cumsum(steps[ends[t] - counts[t] : ends[t]])
    for group, owners in windows.groups:
        local, length = here[group], group.shape[1]
        for k in np.flatnonzero(counts[local].min(axis=1) > 0).tolist():
            starts = _occurrences(local[k], positions, counts, slop)
            docs = np.searchsorted(firsts, starts, "right") - 1
            fits = (docs >= 0) & (starts >= 0)
            fits[fits] = starts[fits] - firsts[docs[fits]] + length <= n_words[docs[fits]]
            starts, docs = starts[fits], docs[fits]
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + length, -1)
            for doc in set(docs.tolist()):
                met.setdefault(doc, set()).update(i for o in owners[k] if (i := windows.item_ids[o]) is not None)
    hit = np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=np.int8(0))
    run_starts, run_ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    run_docs = np.searchsorted(firsts, run_starts, "right") - 1
    cuts = pa.array(np.searchsorted(run_docs, np.arange(len(n_words) + 1)).astype(np.int32))
    run_list = lambda x: pa.ListArray.from_arrays(cuts, pa.array((x - firsts[run_docs]).astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(n_words), segment)),
            pa.array(np.arange(len(n_words), dtype=np.int32)),
            row.column(1)[0].values,
            pa.array(n_words, pa.int32()),
            pa.array([sorted(met.get(k, ())) for k in range(len(n_words))], pa.list_(pa.string())),
            run_list(run_starts),
            run_list(run_ends),
        ],
        names=["segment", "doc_no", "doc_id", "n_words", "items", "starts", "ends"],
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of an item."""
    key = F.struct(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"))
    index = stored(build_index(docs.select(key.alias("doc_id"), "text")), "phrase-index", compression="zstd")
    hit = match(index, items, window).where(F.size("starts") > 0).select("doc_id.*").distinct()
    same = docs["doc_id"].eqNullSafe(hit["id"]) & (F.md5(docs["text"].cast("binary")) == hit["digest"])
    return docs.join(hit, same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    index = stored(build_index(table(spark, folder, "documents", ["doc_id", "text"])), "phrase-index", compression="zstd")
    return digest(match(index, table(spark, folder, "benchmark", ["item_id", "text"])))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
gram AS (
  SELECT r, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS g
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)
),
hit AS (SELECT r, i, l, item_id FROM gram JOIN win USING (l, g)),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
met AS (SELECT r, count(item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN met USING (r)
"""
