"""SimHash near-duplicates: 64-bit fingerprints, linked at DISTANCE or fewer differing bits by Gray-order hierarchical
indexes.

A fingerprint has a bit for each that is set in over half of the hashes of a text's 3-word shingles, repeats counted.
Equal fingerprints become one node. Two nodes that differ in at most DISTANCE bits agree in one of DISTANCE + 1 blocks
of bits, so nodes are dealt out by each block's value; a value with more than GROUP nodes is dealt again by blocks of
the bits that are left, which loses no pair for the same reason. What remains together is an index: nodes sorted by
their rank in Gray order, FAN neighbours under one node that takes over the bits all of them share, and so on up to
one root. A search goes down from the root, adds up the differences in the bits that each node takes over, and leaves
a whole group as soon as they pass DISTANCE. Links become one edge a node (to the least of its group that it reaches),
never all pairs; components are found over these edges.

Defined cases: a null or empty text and one without words have fingerprint zero, linked like any other; one or two
words are one shingle; equal rows are one node; rows that share a doc_id are judged by their texts; component_id is
null only if all doc_ids reachable are; texts of any length are read in slices; an empty table gives an empty result.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.common import stored, table
from colsight.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 64
DISTANCE = 3
#: Nodes that are dealt out again if a value has more; children of an index node.
GROUP, FAN = 1 << 16, 8
#: Bytes of a text read at once, hashes whose bits are counted at once, nodes indexed at once, and searches under way:
#: memory only, never the result.
SLICE, HASHES, NODES, SEARCHES = 1 << 20, 1 << 16, 1 << 16, 1 << 20
#: A-Z in lower case, all white space as a space.
SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingles(text: bytes | None) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Slices of a text with single spaces between words, and where its shingles start and end."""
    spaced = text.translate(SPACED) if text else b""
    at, carried, done = 0, [], False
    while at < len(spaced):
        end = spaced.find(b" ", at + SLICE)
        end = len(spaced) if end < 0 else end
        words = carried + spaced[at:end].split()
        at = end
        if len(words) >= SHINGLE:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            yield b" ".join(words), (ends - sizes)[: 1 - SHINGLE], ends[SHINGLE - 1 :]
            done = True
        carried = words[1 - SHINGLE :]
    if carried and not done:
        joined = b" ".join(carried)
        yield joined, np.array([0]), np.array([len(joined)])


def fingerprint(text: bytes | None) -> int:
    """The text's fingerprint, as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    ones, n = np.zeros(BITS, np.int64), 0
    for joined, starts, ends in shingles(text):
        n += len(starts)
        for k in range(0, len(starts), HASHES):
            spans = zip(starts[k : k + HASHES].tolist(), ends[k : k + HASHES].tolist())
            hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], ">u8")
            ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def sign(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint `fp` of every row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(signed, f"doc_id {kind}, fp bigint")


def parted(fixed: int, distance: int) -> list[int]:
    """`fixed` with each of distance + 1 parts of the other bits."""
    free = [bit for bit in range(BITS) if not fixed >> bit & 1]
    cuts = [round(k * len(free) / (distance + 1)) for k in range(distance + 2)]
    masks = [fixed | sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:])]
    return list(dict.fromkeys(masks))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def deal(nodes: DataFrame, distance: int, group: int) -> DataFrame:
    """Rows (mask, value, fp): two nodes `fp` at that distance or less share a mask and value. Values with over `group`
    nodes are dealt again, as long as bits are left for it."""
    spark = nodes.sparkSession
    dealt, masks, kept = nodes.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"), "fp"), [0], None
    while True:
        steps = [(_signed(m), _signed(further)) for m in masks for further in parted(m, distance)]
        # A fixed number of rows: four for each mask of the level above.
        step = spark.createDataFrame(steps, "mask bigint, further bigint")
        value = F.col("fp").bitwiseAND(F.col("further"))
        dealt = dealt.join(F.broadcast(step), "mask").select(F.col("further").alias("mask"), value.alias("value"), "fp")
        if len(masks) > 1:  # bits of a part may be dealt by several ways
            dealt = dealt.distinct()
        masks = list(dict.fromkeys(m for fixed in masks for m in parted(fixed, distance)))
        dealt = stored(dealt, "simhash-dealt")
        crowded = dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
        last = max(BITS - m.bit_count() for m in masks) <= 2 * (distance + 1)
        if last or not crowded.limit(1).count():
            return dealt if kept is None else kept.unionByName(dealt)
        crowded = stored(crowded.select("mask", "value"), "simhash-crowded")
        easy = dealt.join(crowded, ["mask", "value"], "left_anti")
        kept = easy if kept is None else kept.unionByName(easy)
        dealt = dealt.join(crowded, ["mask", "value"], "left_semi")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each number in the order in which neighbours differ by one bit."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Indexes over several groups of fingerprints of like size. Level 0 has the fingerprints, each level above a node
    for FAN of a group's nodes, the last one node a group. Of the bits that all below a node share, `own` are those
    that its parent does not have, `pattern` their values."""

    def __init__(self, groups: np.ndarray, fp: np.ndarray) -> None:
        order = np.lexsort((gray_rank(fp), groups))
        self.groups, self.fp = groups[order], fp[order]
        self.own, self.pattern, self.first = [], [], []
        #: Last fingerprint below each node.
        self.last = [np.arange(len(fp))]
        every, some, of = self.fp, self.fp, self.groups
        shared = [np.full(len(fp), ~np.uint64(0))]
        patterns = [self.fp]
        while True:
            sizes = np.diff(np.flatnonzero(np.diff(of, prepend=of[0] - 1, append=of[-1] + 1)))
            if sizes.max() == 1:
                break
            within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = np.flatnonzero(within % FAN == 0)
            every, some, of = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first), of[first]
            self.first.append(np.append(first, len(self.last[-1])))
            self.last.append(self.last[-1][self.first[-1][1:] - 1])
            shared.append(~(every ^ some))
            patterns.append(every)
        for level, mask in enumerate(shared):
            above = np.repeat(shared[level + 1], np.diff(self.first[level])) if level + 1 < len(shared) else np.uint64(0)
            self.own.append(mask & ~above)
            self.pattern.append(patterns[level])
        self.root = np.searchsorted(of, self.groups)

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of fingerprints of one group that differ in at most `distance` bits."""
        top = len(self.own) - 1
        waiting = [(top, np.arange(len(self.fp)), self.root, np.zeros(len(self.fp), np.uint8))]
        while waiting:
            level, asked, node, differ = waiting.pop()
            if len(asked) > SEARCHES // FAN and len(asked) > 1:
                half = len(asked) // 2
                waiting += [(level, asked[:half], node[:half], differ[:half]), (level, asked[half:], node[half:], differ[half:])]
                continue
            differ = differ + np.bitwise_count((self.fp[asked] ^ self.pattern[level][node]) & self.own[level][node])
            near = (differ <= distance) & (self.last[level][node] > asked)
            asked, node, differ = asked[near], node[near], differ[near]
            if not level:
                yield asked, node
            elif len(asked):
                first = self.first[level - 1]
                n = first[node + 1] - first[node]
                child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[node], n)
                waiting.append((level - 1, np.repeat(asked, n), child, np.repeat(differ, n)))

    def stars(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """One edge for each fingerprint with links: to the least it reaches within its group."""
        least = np.arange(len(self.fp))
        for a, b in self.links(distance):
            while len(a):
                x, y = least[a], least[b]
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
                while (least[least] != least).any():
                    least = least[least]
        moved = np.flatnonzero(least != np.arange(len(least)))
        return self.fp[moved], self.fp[least[moved]]


def link(dealt: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that connect what links connect, from rows (mask, value, fp)."""

    def search(groups: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.bincount(groups)
        depth = np.ceil(np.log(np.maximum(sizes, 1)) / np.log(FAN)).astype(np.int64)
        depth[sizes == 1] = -1
        for d in np.unique(depth[depth >= 0]):
            own = depth[groups] == d
            a, b = GrayIndex(groups[own], fp[own]).stars(distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [np.zeros((3, 0), np.int64)]
        for batch in batches:
            waiting.append(np.stack([c.to_numpy() for c in batch.columns]))
            if sum(w.shape[1] for w in waiting) < NODES:
                continue
            rows = np.concatenate(waiting, axis=1)
            new = np.flatnonzero((np.diff(rows[:2], axis=1) != 0).any(axis=0)) + 1
            whole = new[-1] if len(new) else 0  # the last group may go on
            waiting = [rows[:, whole:]]
            if whole:
                yield from search(_numbered(rows[:2, :whole]), rows[2, :whole].view(np.uint64))
        rows = np.concatenate(waiting, axis=1)
        if rows.shape[1]:
            yield from search(_numbered(rows[:2]), rows[2].view(np.uint64))

    keys = ["mask", "value"]
    sorted_ = dealt.select("mask", "value", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(searched, "a bigint, b bigint")


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum((np.diff(keys, axis=1) != 0).any(axis=0)))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    signed = stored(sign(docs), "simhash-signed")
    nodes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(link(deal(nodes, distance, group), distance)).select(F.col("node").alias("fp"), "root")
    linked = stored(nodes.join(roots, "fp"), "simhash-linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = linked.join(least, "root").select("fp", "least_id")
    of = nodes.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return signed.join(of, "fp").select("doc_id", "fp", "component_id")


def op12_gray_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents", ["doc_id", "text"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
