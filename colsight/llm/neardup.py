"""Near-duplicate documents: consistent weighted sampling over TF-IDF word shingles, banded and verified.

Shingles are five lower-case words (a shorter text is one shingle). A shingle weighs its count in the document times
1 + ln(1 / max(df / N, EPSILON)): below a share EPSILON of the documents all are equally rare, so only the shingles
above it need counting, and there are at most (mean shingles of a document) / EPSILON of those. They are found
exactly: such a shingle has that share in at least one chunk of documents, so each chunk proposes its own, and a
second pass counts the proposals over all documents, in blocks of bounded size.

Each distinct text gets BANDS keys of ROWS consistent weighted samples (a shingle and its quantised weight). The
samples' random variables come from a table of 65,536 draws, addressed by a hash of shingle and sample. Texts that
share a key form a bucket. A bucket's first text leads: every member is compared with it. Members outside the
leader's class so far then become pivots, 32, 256, ... at a time, compared with all members of other classes that three
bounds leave open, until no outsider is left: the triangle inequality of the Jaccard distance, what the shingles
that no other text of large buckets has take away from a text's similarity to any other, and the lesser weights of both
in each of PARTS parts of all shingles, which tell apart texts that share a passage and differ in the rest. So every pair of a bucket is
compared, already in one class, or shown to differ, without writing all pairs, and nothing of a bucket meets in one
task. Pairs of weighted Jaccard similarity THRESHOLD or more are links; classes are the connected components.

Defined cases: equal texts, empty ones too, are one class; a null text is alone in its class; other texts without
words are linked to equal texts only; a class is named by its smallest doc_id (null only if all are null), rows that
share a doc_id are judged by their texts; an empty table gives an empty result. Columns besides doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsight.llm.common import stored, table
from colsight.llm.components import components
from colsight.llm.phrases import words_of

SHINGLE = 5
THRESHOLD = 0.8
EPSILON = 0.01
BANDS, ROWS = 16, 4
#: Pivots of a bucket in the first round after its leader; eight times as many in each further round.
PIVOTS = 32
#: Parts of all shingles, by their first bits, over which the weights of texts are summed for a bound: time only.
PARTS, PART_SHIFT = 128, 57
#: Texts of buckets of so many get bounds on their similarities before pairs are compared: time only, never the result.
BOUNDED = 32
#: Shingles of a chunk, and proposals counted in one pass: memory only, never the result.
CHUNK = 2_000_000
PROPOSALS = 2_000_000
#: Words whose hash a task remembers.
CACHE_WORDS = 300_000
DRAWS = 1 << 16


class Shingler:
    """Sorted distinct shingle hashes of texts, with counts."""

    def __init__(self) -> None:
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.cache: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        if unknown := [w for w in set(words) if w not in self.cache]:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
                unknown = list(set(words))
            self.cache.update(zip(unknown, map(self.hash, unknown)))
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words = self.words(words_of(text))
        n = min(SHINGLE, len(words))
        if not n:
            return words, words.astype(np.int64)
        mixed = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed, return_counts=True)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[bytes]:
    for batch in batches:
        for value in batch.column(column):
            if (text := value.as_py()) is not None:
                yield text


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def frequent_shingles(docs: DataFrame, epsilon: float = EPSILON, chunk: int = CHUNK, proposals: int = PROPOSALS) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles of a share `epsilon` or more of the documents with words, sorted, with their exact document
    counts, and the number of such documents."""
    texts = docs.select(F.col("text").cast("binary").alias("text"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, n_docs = Shingler(), [], 0, 0

        def frequent() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            named = shingles[counts >= epsilon * len(held)]
            return pa.RecordBatch.from_arrays([_longs(named), pa.array(np.zeros(len(named), np.int64))], names=["shingle", "n"])

        for text in _texts(batches, 0):
            shingles, _ = shingler(text)
            if not len(shingles):
                continue
            held.append(shingles)
            size, n_docs = size + len(shingles), n_docs + 1
            if size >= chunk and len(held) >= 3 / epsilon:
                yield frequent()
                held, size = [], 0
        yield frequent()
        # The number of documents, under a shingle that stands for none.
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n_docs], pa.int64())], names=["shingle", "n"])

    proposed = stored(texts.mapInArrow(propose, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")), "neardup-proposed")
    n_docs = proposed.where(F.col("shingle").isNull()).agg(F.sum("n")).first()[0] or 0
    named = proposed.where(F.col("shingle").isNotNull())
    n_blocks = -(-named.count() // proposals) or 1
    found: list[tuple[int, int]] = []
    for block in range(n_blocks):
        mine = named.where(F.pmod(F.xxhash64("shingle"), F.lit(n_blocks)) == block).select("shingle").toArrow()["shingle"]  # about `proposals`
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(np.asarray(mine).astype(np.int64).view(np.uint64)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, known = Shingler(), sent.value  # noqa: B023
            counts = np.zeros(len(known) + 1, np.int64)
            for text in _texts(batches, 0):
                shingles, _ = shingler(text)
                if len(known):
                    at = np.searchsorted(known, shingles)
                    counts[at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == shingles)]] += 1
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([_longs(known[met]), pa.array(counts[met])], names=["shingle", "n"])

        counted = texts.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
        found += [tuple(r) for r in counted.where(F.col("n") >= epsilon * n_docs).collect()]
        sent.destroy()
    order = np.array([s for s, _ in found], np.int64).view(np.uint64)
    counts = np.array([n for _, n in found], np.int64)
    by = np.argsort(order)
    return order[by], counts[by], n_docs


class Weights:
    """Shingle weights by inverse document frequency."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, n_docs: int, epsilon: float = EPSILON) -> None:
        self.frequent = frequent
        self.rare = 1 - np.log(max(epsilon, 1 / max(1, n_docs)))
        self.idf = np.minimum(self.rare, 1 - np.log(counts / max(1, n_docs)))

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = counts * self.rare
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, shingles), len(self.frequent) - 1)
            known = self.frequent[at] == shingles
            weights[known] = counts[known] * self.idf[at[known]]
        return weights


class Sampler:
    """Band keys of weighted shingles."""

    def __init__(self, rare: float, bands: int = BANDS, rows: int = ROWS) -> None:
        random = np.random.Generator(np.random.PCG64(20))
        self.r, self.log_c = random.gamma(2, 1, DRAWS), np.log(random.gamma(2, 1, DRAWS))
        self.beta = random.random(DRAWS)
        self.factors = random.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shape = bands, rows
        self.rare = rare
        self.log_a, self.t = (x.astype(y) for x, y in zip(self.draw(np.arange(DRAWS), np.log(rare)), (np.float32, np.int32)))

    def draw(self, at: np.ndarray, log_weight: Any) -> tuple[np.ndarray, np.ndarray]:
        r, beta = self.r[at], self.beta[at]
        t = np.floor(log_weight / r + beta)
        return self.log_c[at] - r * (t - beta) - r, t

    def keys(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        bands, rows = self.shape
        best = np.full(bands * rows, np.inf, np.float32)
        chosen, level = np.zeros(bands * rows, np.uint64), np.zeros(bands * rows, np.int32)
        k = np.arange(bands * rows)
        for begin in range(0, len(shingles), 2048):
            part, weight = shingles[begin : begin + 2048], weights[begin : begin + 2048]
            at = ((part * self.factors[:, None]) >> np.uint64(48)).astype(np.int32)
            log_a = self.log_a[at]
            other = np.flatnonzero(weight != self.rare)
            if len(other):
                log_a[:, other] = self.draw(at[:, other], np.log(weight[other]))[0]
            first = log_a.argmin(axis=1)
            least = log_a[k, first]
            t = self.draw(at[k, first], np.log(weight[first]))[1].astype(np.int32)
            won = least < best
            best[won], chosen[won], level[won] = least[won], part[first[won]], t[won]
        mixed = (chosen ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).reshape(bands, rows)
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for row in range(rows):
            key = (key ^ mixed[:, row]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
        return key


def sign(docs: DataFrame, sent: Broadcast, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, tid, keys): the text's digest, null for a null text, and its band keys. sent: Weights."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, shingler = sent.value, Shingler()
        sampler = Sampler(weigh.rare, bands, rows)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tids = [None if t is None else hashlib.md5(t).digest() for t in texts]
            keys = []
            for text in texts:
                shingles, counts = shingler(text)
                keys.append(sampler.keys(shingles, weigh(shingles, counts)).view(np.int64) if len(shingles) else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in keys])), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tids, pa.binary()), lists], names=["doc_id", "tid", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, tid binary, keys array<bigint>"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(signed, schema)


def similarities(pairs: DataFrame, texts: DataFrame, sent: Broadcast) -> DataFrame:
    """(a, b, sim) of pairs (a, b): weighted Jaccard similarity of the texts (tid, text). sent: Weights."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, shingler = sent.value, Shingler()

        def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            shingles, counts = shingler(text)
            return shingles, weigh(shingles, counts)

        last, theirs = None, None
        for batch in batches:
            sims = []
            for ta, b, tb in zip(batch.column(1), batch.column(2), batch.column(3)):
                if (b := b.as_py()) != last:
                    last, theirs = b, features(tb.as_py())
                mine, weight = features(ta.as_py())
                at = np.minimum(np.searchsorted(theirs[0], mine), len(theirs[0]) - 1)
                both = theirs[0][at] == mine
                shared = np.minimum(weight[both], theirs[1][at[both]]).sum()
                sims.append(shared / (weight.sum() + theirs[1].sum() - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    rows = (
        pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("tid").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "ta", "b", "tb")
    )
    return rows.mapInArrow(compare, "a binary, b binary, sim double")


def own_weights(texts: DataFrame, sent: Broadcast) -> DataFrame:
    """(tid, w, u, sums) of texts (tid, text) with words: their weight, that of the shingles no other of them has, and
    their weight by PARTS parts of all shingles. What two texts share is in no part more than the lesser of their sums.
    sent: Weights."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]:
        weigh, shingler = sent.value, Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [shingler(t) for t in part.column(1).to_pylist()]
                yield part.column(0), [f[0] for f in found], [weigh(*f) for f in found]

    def weigh_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tids, shingles, ws in weighed(batches):
            tids = tids.take(pa.array(np.repeat(np.arange(len(ws)), [len(w) for w in ws])))
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(shingles)), tids, pa.array(np.concatenate(ws))], names=["shingle", "tid", "own"])

    def sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tids, shingles, ws in weighed(batches):
            sums = [np.bincount((h >> np.uint64(PART_SHIFT)).astype(np.int64), w, PARTS) for h, w in zip(shingles, ws)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ws) + 1, dtype=np.int32) * PARTS), pa.array(np.concatenate(sums).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([tids, pa.array([w.sum() for w in ws], pa.float64()), lists], names=["tid", "w", "sums"])

    rows = texts.mapInArrow(weigh_all, "shingle bigint, tid binary, own double")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("tid", "own"))).where("n = 1")
    own = alone.groupBy("tid").agg(F.sum("own").alias("u"))
    sums = texts.mapInArrow(sum_parts, "tid binary, w double, sums array<float>")
    return sums.join(own, "tid", "left").select("tid", "w", F.coalesce("u", F.lit(0.0)).alias("u"), "sums")


def _connected(edges: DataFrame) -> DataFrame:
    """(tid, label) of all texts with edges (a, b); one label a connected component."""
    return components(edges).select(F.col("node").alias("tid"), F.col("root").alias("label"))


def _label(frame: DataFrame, labels: DataFrame, tid: str, name: str) -> DataFrame:
    """Adds the class so far of the text in column `tid`; a text without links is its own."""
    of = labels.select(F.col("tid").alias(tid), F.col("label").alias(name))
    return frame.join(of, tid, "left").withColumn(name, F.coalesce(name, tid))


def link(signed: DataFrame, docs: DataFrame, sent: Broadcast, threshold: float = THRESHOLD, pivots: int = PIVOTS) -> DataFrame:
    """(tid, label) of all texts with links, from signed (doc_id, tid, keys) and docs (doc_id, text). sent: Weights."""
    distinct = signed.where(F.col("tid").isNotNull() & (F.size("keys") > 0)).groupBy("tid").agg(F.first("keys").alias("keys"))
    listed = distinct.select("tid", F.explode("keys").alias("key"))
    leads = listed.groupBy("key").agg(F.min("tid").alias("lead"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = stored(listed.join(leads, "key"), "neardup-members")

    needed = members.select("tid").distinct()
    # One row a text, chosen by doc_id before the texts move.
    chosen = signed.join(needed, "tid", "left_semi").groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    found = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tid"), F.col("text").cast("binary").alias("text")
    )
    same = (found["tid"] == chosen["tid"]) & found["doc_id"].eqNullSafe(chosen["doc_id"])
    texts = stored(found.join(chosen, same, "left_semi").select("tid", "text").dropDuplicates(["tid"]), "neardup-texts", compression="zstd")

    led = members.where(F.col("tid") != F.col("lead")).select(F.col("tid").alias("a"), F.col("lead").alias("b")).distinct()
    sims = stored(similarities(led, texts, sent), "neardup-sims")
    edges = sims.where(F.col("sim") >= threshold).select("a", "b")
    labels = _connected(edges)

    to_lead = sims.select(F.col("a").alias("tid"), F.col("b").alias("lead"), "sim")
    rest = members.where((F.col("tid") != F.col("lead")) & (F.col("n") > 2)).drop("n").join(to_lead, ["tid", "lead"])
    outside = stored(_outside(rest, labels), "neardup-outside")
    # The bounds count what texts of large open buckets share, so they hold between rows of those buckets only.
    large = members.where(F.col("n") >= BOUNDED).join(outside.select("key").distinct(), "key", "left_semi").select("key", "tid")
    open_ = large.select("tid").distinct()
    own = own_weights(texts.join(open_, "tid", "left_semi"), sent)
    bounds = stored(large.join(own, "tid").select("key", "tid", "w", "u", "sums"), "neardup-bounds")
    rest = stored(_bounded(rest, bounds).join(distinct, "tid"), "neardup-rest")
    # A text that no other of its large bucket can be so similar to needs no turn there.
    able = F.coalesce(F.col("u") <= (1 - threshold) * F.col("w") + 1e-9, F.lit(True))
    outside = stored(_bounded(outside, bounds).where(able).drop("w", "u", "sums"), "neardup-outside")
    while outside.limit(1).count():
        turn = W.partitionBy("key").orderBy("tid")
        now = outside.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= pivots).drop("turn")
        now = stored(_label(_bounded(now, bounds), labels, "tid", "label"), "neardup-pivots")
        turns = now.groupBy("tid").agg(F.collect_set("key").alias("turns"))  # at most a key a band
        pivot = now.join(turns, "tid").select("key", "turns", *(F.col(c).alias(f"p_{c}") for c in ("tid", "sim", "label", "w", "u", "sums")))
        apart = (F.col("label") != F.col("p_label")) & (F.abs(F.col("sim") - F.col("p_sim")) <= 1 - threshold + 1e-9)
        shared = F.least(F.col("w") - F.col("u"), F.col("p_w") - F.col("p_u"))
        union = F.greatest(F.col("w") + F.col("p_u"), F.col("p_w") + F.col("u"))
        near = F.coalesce(shared >= (threshold - 1e-9) * union, F.lit(True))
        by_part = F.aggregate(F.zip_with("sums", "p_sums", lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda x, y: x + y)
        # Sums are rounded to single precision.
        likely = F.coalesce(by_part >= (threshold / (1 + threshold) - 1e-5) * (F.col("w") + F.col("p_w")), F.lit(True))
        # Of the buckets that offer a pair in this round, the one with the least key writes it.
        first = F.array_min(F.array_intersect("keys", "turns")) == F.col("key")
        pairs = (
            _label(rest.where(able), labels, "tid", "label")
            .join(pivot, "key")
            .where(apart & near & first & likely)
            .select(F.greatest("tid", "p_tid").alias("a"), F.least("tid", "p_tid").alias("b"))
            .distinct()
        )
        more = stored(similarities(pairs, texts, sent), "neardup-sims").where(F.col("sim") >= threshold).select("a", "b")
        waiting = outside.join(now.select("key", "tid"), ["key", "tid"], "left_anti")
        if more.limit(1).count():
            edges = stored(edges.unionByName(more), "neardup-edges")
            labels = _connected(edges)
        outside = stored(_outside(waiting, labels), "neardup-outside")
        pivots *= 8
    return labels


def _bounded(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds the text's weight `w`, the weight `u` that it shares with no other text of large buckets, and its `sums` by
    parts; null if the row's bucket is not one of them."""
    return rows.join(bounds, ["key", "tid"], "left")


def _outside(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, tid, lead, sim) whose text is not in the class of its bucket's leader."""
    named = _label(_label(rows, labels, "tid", "mine"), labels, "lead", "theirs")
    return named.where(F.col("mine") != F.col("theirs")).select("key", "tid", "lead", "sim")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, epsilon: float = EPSILON, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, tid (the text's MD5), label (of its class; both null for a null text), class_id."""
    docs = docs.select("doc_id", "text")
    # At most (mean shingles) / EPSILON numbers.
    sent = docs.sparkSession.sparkContext.broadcast(Weights(*frequent_shingles(docs, epsilon), epsilon))
    signed = stored(sign(docs, sent, bands, rows), "neardup-signed")
    labels = link(signed, docs, sent, threshold)
    sent.destroy()  # both are stored
    texts = signed.where(F.col("tid").isNotNull()).groupBy("tid").agg(F.min("doc_id").alias("first_id"))
    texts = _label(texts, labels, "tid", "label")
    classes = texts.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = texts.join(classes, "label").select("tid", "label", "class_id")
    rows_ = signed.select("doc_id", "tid").join(named, "tid", "left")
    return rows_.select("doc_id", "tid", "label", F.when(F.col("tid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, **settings: Any) -> DataFrame:
    """docs without all but one document of each class; null texts stay."""
    found = near_duplicates(docs, **settings).where(F.col("tid").isNotNull())
    kept = found.groupBy("label").agg(F.min(F.struct("doc_id", "tid")).alias("one")).select(F.col("one.doc_id").alias("doc_id"), F.col("one.tid").alias("tid"))
    tid = F.unhex(F.md5(F.col("text").cast("binary")))
    rows = docs.where(F.col("text").isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), tid.alias("digest"))
    same = rows["id"].eqNullSafe(kept["doc_id"]) & (rows["digest"] == kept["tid"])
    once = rows.join(kept, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
    return once.unionByName(docs.where(F.col("text").isNull()))


def op10_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents", ["doc_id", "text"])).select("doc_id", "class_id")
