"""Language-model scores from Elias-Fano tries of n-grams.

Counting covers every training document. Words (by 64-bit hash) are counted in tasks, then by one sum; pairs and triples
in the parts described below. Those seen LEAST times or more are kept, at every size of the corpus; the parts of a kept n-gram are kept with it.

The kept n-grams are dealt to parts by the middle word of three: a part holds the triples around its words, their contexts
and all followers of its words, with the counts of all words in these. So whatever a token needs, given the two before it,
lies in one part. A word with more than a part's share of the tokens is spread over several by the word before it, and its
followers go to each of these. A pair of two such words may fill a part by itself: it is counted in several by its third word
(and summed), looked up in several by turns, and its triples go to each of these. The number of parts grows with the corpus, and each becomes a trie on an executor, where its levels
are memory-mapped. Training texts send counts of their triples, and all texts their look-ups, in blocks, one a chunk and
part; answers come back a block, are summed a chunk, and reach the texts by the hash of their words.

A chunk of texts is tokenised and hashed by array operations over its bytes; no word becomes a Python object.

A level keeps, for each context in order, the ids of its followers. Pointers to the followers' ranges are monotone,
and so are the ids once each range is lifted by the last value before it; both are Elias-Fano coded. A follower is
found by a successor search relative to its context: the lifted id's high part names a bucket, the low parts in it
are halved. Probabilities are discounted by DISCOUNT, backoff weights make each context sum to one, and both are
quantised to LEVELS levels a part. The lowest order is the add-one-half unigram model over all words: the counts of the most
frequent words, at most 1 / SHARE, are sent to the tasks, where blocks name these words by number; those of all others are joined.

Defined cases: null and empty texts are the end token alone; a null doc_id counts as the text `null` in the fold;
rows that share a doc_id are scored one by one; without training documents all counts are 0; an empty table gives an
empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.common import stored, table

FOLDS, HELD_OUT = 5, 1
SHARE, DISCOUNT = 1e-6, 0.5
#: Times an n-gram must have been seen.
LEAST = 2
#: Training tokens of a part: memory only.
PART_TOKENS = 2_000_000
#: Levels of quantised probabilities and weights.
LEVELS = 256
#: Hash of the end token; no word has it, as words with it take the next number.
END = 0
#: Tokens of an array operation (taken as TOKEN_BYTES each), those of a part that are counted at once, and different words a
#: task counts before it sends them: memory only.
CHUNK, TOKEN_BYTES, SLICE, CACHE_WORDS = 400_000, 6, 400_000, 300_000
#: Bytes of a word that are hashed by array operations, eight at a time; longer words are hashed one by one.
ARRAY_BYTES = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: What keeps the first k of eight bytes.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Signed hashes of the words of a text at these places."""
    padded = text + b"\0" * 8
    eights = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))  # at every byte
    sizes = ends - starts
    found = _mixed(sizes.astype(np.uint64))
    live, at, left = slice(None), starts, sizes
    for _ in range(ARRAY_BYTES // 8):
        found[live] = _mixed(found[live] * np.uint64(0x9E3779B97F4A7C15) + (eights[at] & FIRST_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    long = np.flatnonzero(sizes > ARRAY_BYTES)
    if len(long):
        found[long] = [_hash(text[b:e]) for b, e in zip(starts[long].tolist(), ends[long].tolist())]
    found[found == END] = 1
    return found.view(np.int64)


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


class Hashes:
    """Signed hashes of single words."""

    def __getitem__(self, word: bytes) -> int:
        return int(word_hashes(word, np.array([0]), np.array([len(word)]))[0])


class EliasFano:
    """A monotone sequence: low bits packed, high parts in unary."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str) -> None:
        self.low, high, (self.n, self.width) = arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.size"].tolist()
        bits = np.unpackbits(high.view(np.uint8), bitorder="little")
        zeros = np.flatnonzero(bits == 0)
        self.starts = np.append(0, zeros - np.arange(len(zeros))).astype(np.int64)
        self.ones = np.flatnonzero(bits)[: self.n].astype(np.int64)

    @staticmethod
    def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 2) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        low = np.zeros(n * width // 64 + 2, np.uint64)
        at, rest = np.arange(n) * width, values & np.uint64((1 << width) - 1)
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, at >> 6, rest << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(low, (at[over] >> 6) + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return {f"{name}.low": low, f"{name}.high": np.packbits(bits, bitorder="little").view(np.uint64), f"{name}.size": np.array([n, width])}

    def lows(self, k: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(k), np.int64)
        at = k * self.width
        shift = (at & 63).astype(np.uint64)
        both = (self.low[at >> 6] >> shift) | np.where(shift > 0, self.low[(at >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (both & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, k: np.ndarray) -> np.ndarray:
        return ((self.ones[k] - k) << self.width) | self.lows(k)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the values within [begin, end), -1 where absent."""
        place = np.full(len(value), -1, np.int64)
        high = value >> self.width
        inside = (high + 1 < len(self.starts)) & (begin < end)
        live = np.flatnonzero(inside)
        at = np.maximum(self.starts[high[live]], begin[live])
        stop = np.minimum(self.starts[high[live] + 1], end[live])
        # Low parts ascend within a bucket: halve what is left of it to the first that is not below. Few buckets are crowded.
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            live, at, stop = live[open_], at[open_], stop[open_]
            half = (at + stop) >> 1
            low, want = self.lows(half), value[live] & ((1 << self.width) - 1)
            same = np.flatnonzero(low == want)
            place[live[same]] = half[same]
            below = low < want
            at, stop = np.where(below, half + 1, at), np.where(below, stop, half)
            stop[same] = at[same]
            open_ = np.flatnonzero(at < stop)
        return place


def quantised(values: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """That many levels, each the mean of an equal share of the sorted distinct values, and every value's level."""
    kind = np.uint8 if levels <= 256 else np.uint32
    if not len(values):
        return np.zeros(1, np.float32), np.zeros(0, kind)
    distinct = np.unique(values)
    parts = np.array_split(distinct, min(levels, len(distinct)))
    book = np.array([p.mean() for p in parts], np.float32)
    edges = np.array([p[-1] for p in parts[:-1]])
    return book, np.searchsorted(edges, values, "left").astype(kind)


@dataclass
class Counts:
    """Kept n-grams of a part: word hashes sorted, pairs (first, second) and triples (pair, third) of ids sorted, with counts."""

    n_tokens: int
    n_types: int
    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    triples: np.ndarray
    triple_counts: np.ndarray


def unigram(count: np.ndarray, n_tokens: int, n_types: int) -> np.ndarray:
    return np.log10((count + 0.5) / (n_tokens + 0.5 * (n_types + 1)))


def build_trie(counts: Counts, levels: int | None = None) -> bytes:
    """The levels in one block of bytes: a JSON header with places, then the arrays."""
    levels = levels or LEVELS
    c1, c2 = counts.word_counts.astype(float), counts.pair_counts.astype(float)
    first, second = counts.pairs >> 32, counts.pairs & 0xFFFFFFFF
    pair, third = counts.triples >> 32, counts.triples & 0xFFFFFFFF
    p1 = 10 ** unigram(c1, counts.n_tokens, counts.n_types)
    p2 = (c2 - DISCOUNT) / c1[first]
    p3 = (counts.triple_counts - DISCOUNT) / c2[pair]

    def backoff(context: np.ndarray, n: int, higher: np.ndarray, lower: np.ndarray) -> np.ndarray:
        left = np.maximum(1 - np.bincount(context, higher, n), 1e-6)
        below = np.maximum(1 - np.bincount(context, lower, n), 1e-6)
        return np.log10(left / below)

    # A triple's lower order is the pair of its last words, which is kept.
    lower3 = p2[np.searchsorted(counts.pairs, second[pair] << 32 | third)] if len(pair) else np.zeros(0)
    arrays = {"words": counts.words, "p1": unigram(c1, counts.n_tokens, counts.n_types)}
    for name, context, follower, n, values in (("2", first, second, len(c1), np.log10(p2)), ("3", pair, third, len(c2), np.log10(p3))):
        ends = np.cumsum(np.bincount(context, minlength=n))
        begins = np.append(0, ends)[:n]
        arrays |= EliasFano.encode(np.append(0, ends), f"pointers{name}")
        # Each range is lifted by the last value before it.
        sizes = ends - begins
        tops = follower[ends[sizes > 0] - 1]
        lift = np.zeros(n, np.int64)
        lift[sizes > 0] = np.append(0, np.cumsum(tops))[:-1]
        arrays |= EliasFano.encode(follower + lift[context], f"ids{name}")
        arrays[f"book{name}"], arrays[f"code{name}"] = quantised(values, levels)
    arrays["back_book1"], arrays["back_code1"] = quantised(backoff(first, len(c1), p2, p1[second]), levels)
    arrays["back_book2"], arrays["back_code2"] = quantised(backoff(pair, len(c2), p3, lower3), levels)
    places, data, at = {}, [], 0
    for name, values in arrays.items():
        raw = np.ascontiguousarray(values).tobytes()
        places[name] = (values.dtype.str, at, len(values))
        data += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *data])


class Trie:
    """The levels, memory-mapped from a file that has no name and goes with the process."""

    def __init__(self, block: bytes) -> None:
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            view = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        begin = 8 + int.from_bytes(view[:8], "little")
        places = json.loads(bytes(view[8:begin]))
        arrays = {name: np.frombuffer(view, kind, n, begin + at) for name, (kind, at, n) in places.items()}
        self.words, self.p1 = arrays["words"], arrays["p1"]
        pointers = EliasFano(arrays, "pointers2"), EliasFano(arrays, "pointers3")
        self.pointers = [p.get(np.arange(p.n)) for p in pointers]
        self.ids = [EliasFano(arrays, "ids2"), EliasFano(arrays, "ids3")]
        self.log_p = [(arrays[f"book{k}"], arrays[f"code{k}"]) for k in (2, 3)]
        self.back = [(arrays[f"back_book{k}"], arrays[f"back_code{k}"]) for k in (1, 2)]

    def follow(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words after contexts, -1 where either is unknown."""
        place = np.full(len(word), -1, np.int64)
        live = np.flatnonzero((context >= 0) & (word >= 0))
        begin, end = self.pointers[level][context[live]], self.pointers[level][context[live] + 1]
        some = begin < end
        live, begin, end = live[some], begin[some], end[some]
        # The range is lifted by the value before it.
        lift = np.where(begin > 0, self.ids[level].get(np.maximum(begin - 1, 0)), 0) if len(live) else begin
        place[live] = self.ids[level].find(word[live] + lift, begin, end)
        return place

    def gain(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """log10 probability of the third words after the others, less that of the unigram model. An id is -1 for
        words that are not here, or no word."""
        context, pairs = self.follow(0, first, second), self.follow(0, second, third)
        triples = self.follow(1, context, third)
        take = lambda of, k: of[0][of[1][k]].astype(float)
        gain = np.zeros(len(third))
        back = np.flatnonzero((pairs < 0) & (second >= 0))
        gain[back] = take(self.back[0], second[back])
        two = np.flatnonzero(pairs >= 0)
        gain[two] = take(self.log_p[0], pairs[two]) - self.p1[third[two]]
        back = np.flatnonzero((triples < 0) & (context >= 0))
        gain[back] += take(self.back[1], context[back])
        three = np.flatnonzero(triples >= 0)
        gain[three] = take(self.log_p[1], triples[three]) - self.p1[third[three]]
        return gain


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[bytes]]:
    """Texts, about CHUNK tokens at a time."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(column):
            held.append(text.as_py() or b"")
            size += len(held[-1]) // TOKEN_BYTES + 1
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and where texts begin."""
    joined = b"\n".join(texts).translate(LOWER)
    edges = np.flatnonzero(np.diff(~SPACE[np.frombuffer(joined, np.uint8)], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    # Texts end where the next one begins.
    stops = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)) + np.arange(1, len(texts) + 1)
    ids = np.empty(len(starts) + len(texts), np.int64)
    inner = np.ones(len(ids), bool)
    inner[stops - 1] = False
    ids[inner] = word_hashes(joined, starts, ends)
    ids[stops - 1] = END
    return ids, np.append(0, stops[:-1])


def count_grams(training: DataFrame, parts: Parts, frequent: Broadcast) -> DataFrame:
    """(a, b, c, n, rare) of the pairs (c is null) and triples of word hashes that are seen LEAST times; rare: a or b is not a
    frequent word. All that share their first
    two words meet in one part, which counts them; only pairs of two spread words meet in several, and are summed after."""

    def count(blocks: pa.Table) -> pa.Table:
        held = [_words_of(f.as_py(), r.as_py(), frequent.value) for f, r in zip(blocks["frequent"], blocks["rare"])]
        words = np.unique(np.concatenate(held))
        sizes = blocks["n"].to_pylist()
        rows, end = np.empty((4, sum(sizes)), np.int32), 0
        for own, items, n in zip(held, blocks["items"], sizes):
            seen, *three = _unpacked(items.as_py(), n)
            of = np.append(np.searchsorted(words, own), -1).astype(np.int32)  # -1: none
            after = np.flatnonzero(of[three[0]] >= 0)
            begin, end = end, end + len(after)
            rows[:, begin:end] = seen[after], *(of[k[after]] for k in three)
        del held
        rows = rows[:, :end]
        # All triples of a pair are in one slice.
        slices, known = end // SLICE + 1, _places(words, frequent.value) >= 0
        return pa.concat_tables([kept_of(words, known, rows[:, (rows[1] + rows[2]) % slices == k]) for k in range(slices)])

    def kept_of(words: np.ndarray, known: np.ndarray, rows: np.ndarray) -> pa.Table:
        seen, first, middle, third = rows[:, _order(rows[1:], len(words) + 1)]
        new = np.ones(len(seen), bool)
        new[1:] = (np.diff(first) != 0) | (np.diff(middle) != 0)
        at = np.flatnonzero(new)
        first, middle, n = first[at], middle[at], np.add.reduceat(seen, at, dtype=np.int64) if len(at) else at
        pair = np.cumsum(new) - 1
        new[1:] |= np.diff(third) != 0
        at = np.flatnonzero(new)
        m = np.add.reduceat(seen, at, dtype=np.int64) if len(at) else at
        often = (m >= LEAST) & (third[at] >= 0)
        at, m = at[often], m[often]
        pair, third = pair[at], third[at]
        partial = parts.pair_spreads(words[first], words[middle]) > 1
        kept = partial | (n >= LEAST)
        a, b = (np.concatenate([word[kept], word[pair]]) for word in (first, middle))
        return pa.table({
            "rare": ~(known[a] & known[b]),
            "a": words[a],
            "b": words[b],
            "c": pa.concat_arrays([pa.nulls(int(kept.sum()), pa.int64()), pa.array(words[third])]),
            "n": np.concatenate([n[kept], m]),
            "partial": np.concatenate([partial[kept], np.zeros(len(m), bool)]),
        })

    blocks = blocks_of(training, parts, frequent, True).groupBy("part")
    counted = stored(blocks.applyInArrow(count, "rare boolean, a bigint, b bigint, c bigint, n bigint, partial boolean"), "lm-grams", compression="zstd")
    # Fewer rows than parts for each pair of two of the spread words, which are fewer than parts.
    summed = counted.where("partial").groupBy("a", "b").agg(F.sum("n").alias("n"), F.any_value("rare").alias("rare")).where(F.col("n") >= LEAST)
    columns = ["a", "b", "c", "n", "rare"]
    return counted.where("NOT partial").select(*columns).unionByName(summed.select("a", "b", F.lit(None).cast("bigint").alias("c"), "n", "rare"))


@dataclass
class Parts:
    """Which part has what: the number of parts, and the words (sorted) that are spread over several."""

    n: int
    hot: np.ndarray
    spread: np.ndarray

    def spreads(self, middle: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(middle), np.int64)
        at = np.minimum(np.searchsorted(self.hot, middle), len(self.hot) - 1)
        return np.where(self.hot[at] == middle, self.spread[at], 1)

    def pair_spreads(self, first: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Over how many parts contexts (first, middle) are spread: none is seen more often than its rarer word."""
        return np.minimum(self.spreads(first), self.spreads(middle))

    def of(self, first: np.ndarray, middle: np.ndarray, k: np.ndarray) -> np.ndarray:
        """A part of contexts (first, middle), the k-th by turns."""
        return self.nth(middle, (self.mixed(first) + k % self.pair_spreads(first, middle)) % self.spreads(middle))

    def nth(self, middle: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (self.mixed(middle) + k) % self.n

    @staticmethod
    def mixed(hashes: np.ndarray) -> np.ndarray:
        return ((hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)


def dealt(grams: DataFrame, words: DataFrame, parts: Parts, frequent: Broadcast) -> DataFrame:
    """(part, a, b, c, n, n_a, n_b, rare): the kept n-grams in each part that needs them. Frequent words are named by number;
    bits of `rare` tell which of a, b and c are hashes, and only these have a count."""
    columns = ["a", "b", "c", "n", "n_a", "n_b"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.asarray(batch.column(k).fill_null(0)) for k in range(3)]
            first, middle, _ = hashes
            is_pair = np.asarray(batch.column(2).is_null())
            pair = np.flatnonzero(is_pair)
            own, k = _repeated(np.arange(len(first)), parts.pair_spreads(first, middle))
            follower, turn = _repeated(pair, parts.spreads(first[pair]))
            of = np.concatenate([parts.of(first[own], middle[own], k), parts.nth(first[follower], turn)])
            places = [_places(h, frequent.value) for h in hashes]
            coded = [pa.array(np.where(at < 0, h, at), mask=is_pair if k == 2 else None) for k, (at, h) in enumerate(zip(places, hashes))]
            rare = sum((at < 0).astype(np.int8) << k for k, at in enumerate(places))
            known = pa.RecordBatch.from_arrays([*coded, *batch.columns[3:], pa.array(rare, pa.int8())], names=[*columns, "rare"])
            taken = known.take(pa.array(np.concatenate([own, follower])))
            yield pa.RecordBatch.from_arrays([pa.array(of), *taken.columns], names=["part", *columns, "rare"])

    none = F.lit(None).cast("bigint")
    asks = F.col("c").isNull() & F.col("rare")
    pairs = grams.where(asks)
    for side in ("a", "b"):
        pairs = pairs.join(words.select(F.col("hash").alias(side), F.col("n").alias(f"n_{side}")), side)
    others = grams.where(~asks).select("a", "b", "c", "n", none.alias("n_a"), none.alias("n_b"))
    rows = pairs.select(*columns).unionByName(others)
    return rows.mapInArrow(deal, "part bigint, a bigint, b bigint, c bigint, n bigint, n_a bigint, n_b bigint, rare tinyint")


def _repeated(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row that many times, and which of them it is."""
    return np.repeat(rows, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def part_counts(model: pa.Table, n_tokens: int, n_types: int, frequent: np.ndarray, frequent_counts: np.ndarray) -> Counts:
    """The rows of a part as Counts."""

    def column(of: pa.Table, name: str) -> np.ndarray:
        return np.asarray(of[name].combine_chunks().fill_null(0)).astype(np.int64)

    def hashes(of: pa.Table, k: int) -> np.ndarray:
        coded, known = column(of, "abc"[k]), (column(of, "rare") >> k & 1) == 0
        coded[known] = frequent[coded[known]]
        return coded

    pairs, triples = model.filter(model["c"].is_null()), model.filter(model["c"].is_valid())
    a, b = hashes(pairs, 0), hashes(pairs, 1)
    words, at = np.unique(np.concatenate([a, b]), return_index=True)
    word_counts = np.concatenate([column(pairs, "n_a"), column(pairs, "n_b")])[at]
    places = _places(words, frequent)
    word_counts[places >= 0] = frequent_counts[places[places >= 0]]
    keys, at = np.unique(np.searchsorted(words, a) << 32 | np.searchsorted(words, b), return_index=True)
    counts = column(pairs, "n")[at]
    a, b, c = (np.searchsorted(words, hashes(triples, k)) for k in range(3))
    ids = np.searchsorted(keys, a << 32 | b) << 32 | c
    order = np.argsort(ids)
    return Counts(n_tokens, n_types, words, word_counts, keys, counts, ids[order], column(triples, "n")[order])


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of small numbers, the third sorted and sent as steps, equal bytes of them together, compressed."""
    columns = [*columns[:2], np.diff(columns[2], prepend=0), *columns[3:]]
    return _planes(np.concatenate(columns))


def _unpacked(data: bytes, n: int) -> np.ndarray:
    columns = _from_planes(data, 4 * n).reshape(4, n)
    columns[2] = np.cumsum(columns[2])
    return columns


def _planes(numbers: np.ndarray) -> bytes:
    numbers = numbers.astype(np.int32)
    return pa.compress(b"".join((numbers >> shift).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24)), "zstd", asbytes=True)


def _from_planes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    numbers = planes[3].astype(np.int32)
    for plane in planes[2::-1]:
        numbers <<= 8
        numbers |= plane
    return numbers.astype(np.int64)


def _places(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Numbers of words among the frequent ones (sorted), -1 for others."""
    if not len(frequent):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, at, -1)


def _words_of(steps: bytes, rare: bytes, frequent: np.ndarray) -> np.ndarray:
    """The sorted words of a block: steps between numbers of frequent ones, and hashes of others."""
    n = int.from_bytes(steps[:4], "little")
    known = frequent[np.cumsum(_from_planes(steps[4:], n))] if n else np.zeros(0, np.int64)
    return np.sort(np.concatenate([known, np.frombuffer(rare, np.int64)]))


def _keys_of(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hashes of documents, by their words."""
    ends = np.append(begins[1:], len(tokens))
    return np.array([_hash(tokens[b:e].tobytes()) for b, e in zip(begins.tolist(), ends.tolist())], np.uint64).view(np.int64)


def _distinct(numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers from -1 to width - 1, sorted, and the place of each number among them."""
    if width > numbers.size:
        used, places = np.unique(numbers, return_inverse=True)
        return used, places.reshape(numbers.shape)
    there = np.zeros(width + 1, bool)
    there[numbers + 1] = True
    return np.flatnonzero(there) - 1, (np.cumsum(there, dtype=np.int32) - 1)[numbers + 1]


def _order(columns: Sequence[np.ndarray], width: int) -> np.ndarray:
    """The order by columns of numbers from -1 to width - 2, the first column first."""
    if width >= 1 << 20:
        return np.lexsort(tuple(reversed(columns)))
    key = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        key = key * width + (column + 1)
    return np.argsort(key)


def blocks_of(texts: DataFrame, parts: Parts, frequent: Broadcast, training: bool) -> DataFrame:
    """Blocks of tokens by part, each with the tokens before and after it, one a chunk and part. Those of training texts have
    all tokens, equal ones as one with their number, others those that one follows, with the numbers of their documents in the
    chunk; the first of a chunk has the hashes of its documents."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _chunks(batches, 0):
            tokens, begins = _numbered(texts)
            keys = b"" if training else _keys_of(tokens, begins).tobytes()
            chunk = int(np.array([_hash(keys)], np.uint64).view(np.int64)[0])
            lead = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.append(begins, len(tokens))))
            del texts
            words, middle = np.unique(tokens, return_inverse=True)
            del tokens
            middle = middle.astype(np.int32)  # numbers of a chunk's words, as are the other columns
            places = _places(words, frequent.value)
            none = np.array([-1], np.int32)
            first, third = np.append(none, middle[:-1]), np.append(middle[1:], none)
            first[begins] = -1
            third[begins[1:] - 1] = -1
            if not training:
                asking = third >= 0
                lead, first, middle, third = lead[asking], first[asking], middle[asking], third[asking]
            order = _order((middle, first, third), len(words) + 1)
            lead, first, middle, third = lead[order], first[order], middle[order], third[order]
            del order
            if training:
                new = np.flatnonzero(np.concatenate([[True], (np.diff(middle) != 0) | (np.diff(first) != 0) | (np.diff(third) != 0)]))
                lead = np.diff(np.append(new, len(middle))).astype(np.int32)
                first, middle, third = first[new], middle[new], third[new]
            hash_of = np.append(words, 0)  # the last stands for none
            turn = Parts.mixed(hash_of[third]) if training else np.arange(len(middle))
            part = parts.of(hash_of[first], hash_of[middle], turn)
            order = np.argsort(part.astype(np.min_scalar_type(parts.n)), kind="stable")
            items, part = np.stack([column[order] for column in (lead, first, middle, third)]), part[order]
            del lead, first, middle, third, order, turn
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                mine = items[:, begin:end]
                used, back = _distinct(mine[1:], len(words))
                unknown = int(used[0] < 0)
                used = used[unknown:]
                known = places[used]
                found = known[known >= 0]
                steps = len(found).to_bytes(4, "little") + _planes(np.diff(found, prepend=0))
                packed = _packed([mine[0], *(back - unknown)])
                values = part[begin], end - begin, chunk, steps, words[used[known < 0]].tobytes(), keys, packed
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.int64() if k < 3 else pa.binary()) for k, v in enumerate(values)],
                    names=["part", "n", "chunk", "frequent", "rare", "keys", "items"],
                )
                keys = b""

    return texts.mapInArrow(deal, "part bigint, n bigint, chunk bigint, frequent binary, rare binary, keys binary, items binary")


def frequent_words(words: DataFrame, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words with a count from some least one on, at most that many."""
    # A row for each quarter of an octave of counts.
    octave = F.floor(F.log2(F.col("n").cast("double")) * 4)
    least, total = None, 0
    for level, n in sorted(words.where("n > 1").groupBy(octave.alias("level")).agg(F.count(F.lit(1))).collect(), reverse=True):
        total += n
        if total > most:
            break
        least = level
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = words.where((F.col("n") > 1) & (octave >= least)).toArrow()
    keys, n = np.asarray(rows["hash"]).astype(np.int64), np.asarray(rows["n"]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def count_words(training: DataFrame) -> DataFrame:
    """(hash, n) of all tokens of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for texts in _chunks(batches, 0):
            new, times = np.unique(_numbered(texts)[0], return_counts=True)
            words, place = np.unique(np.concatenate([words, new]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), len(words)).astype(np.int64)
            if len(words) >= CACHE_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], names=["hash", "n"])
                words, n = words[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], names=["hash", "n"])

    return training.mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Numbers of tokens and types, the frequent words and their counts, kept n-grams by part."""

    n_tokens: int
    n_types: int
    parts: Parts
    frequent: Broadcast
    frequent_counts: Broadcast
    grams: DataFrame


def count_ngrams(training: DataFrame, share: float = SHARE, part_tokens: int = PART_TOKENS) -> tuple[Model, DataFrame]:
    """The model of the training texts, and the table (hash, n) of all words. `share` only says how many counts of words are
    sent; the others are joined."""
    training = training.select(F.col("text").cast("binary").alias("text"))
    words = stored(count_words(training), "lm-words")
    n_types, n_tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hashes, word_counts = frequent_words(words, 1 / share)
    frequent, frequent_counts = (training.sparkSession.sparkContext.broadcast(x) for x in (hashes, word_counts))  # at most 1 / SHARE
    n_parts = max(1, -(-n_tokens // part_tokens))
    often = sorted((r.hash, -(-r.n * n_parts // n_tokens)) for r in words.where(F.col("n") * n_parts > n_tokens).collect())  # fewer than parts
    parts = Parts(n_parts, np.array([h for h, _ in often], np.int64), np.array([k for _, k in often], np.int64))
    grams = count_grams(training, parts, frequent)
    return Model(n_tokens, n_types, parts, frequent, frequent_counts, dealt(grams, words, parts, frequent)), words


def score(docs: DataFrame, counts: Model, words: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_tokens, n_known, base_score, score."""
    n_tokens, n_types, levels, frequent, frequent_counts = counts.n_tokens, counts.n_types, LEVELS, counts.frequent, counts.frequent_counts
    texts = docs.select(F.col("text").cast("binary").alias("text"))

    def answer(model: pa.Table, asked: pa.Table) -> pa.Table:
        trie = Trie(build_trie(part_counts(model, n_tokens, n_types, frequent.value, frequent_counts.value), levels))
        documents, gains = [], []
        for n, steps, rare, items in zip(*(asked[c] for c in ("n", "frequent", "rare", "items"))):
            ids = np.append(_places(_words_of(steps.as_py(), rare.as_py(), frequent.value), trie.words), -1)  # the last stands for none
            row, *three = _unpacked(items.as_py(), n.as_py())
            three = ids[np.stack(three)]
            # Equal look-ups follow each other.
            new = np.flatnonzero(np.append(True, (np.diff(three) != 0).any(axis=0)))
            gain = np.repeat(trie.gain(*three[:, new]), np.diff(np.append(new, len(row))))
            there = np.flatnonzero(np.bincount(row))
            documents.append(there.astype(np.int32).tobytes())
            gains.append(np.bincount(row, gain)[there].tobytes())
        return pa.table({"chunk": asked["chunk"], "keys": asked["keys"], "documents": pa.array(documents, pa.binary()), "gains": pa.array(gains, pa.binary())})

    def summed(blocks: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_py(), np.int64) for k in blocks["keys"] if len(k.as_py())]  # equal chunks have one hash
        documents = np.concatenate([np.frombuffer(d.as_py(), np.int32) for d in blocks["documents"]])
        gains = np.concatenate([np.frombuffer(g.as_py(), float) for g in blocks["gains"]])
        return pa.table({"key": keys[0], "gain": np.bincount(documents, gains, len(keys[0])) / len(keys)})

    asked = blocks_of(texts, counts.parts, frequent, False)
    answers = counts.grams.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "chunk bigint, keys binary, documents binary, gains binary")
    # Rows with equal words ask for the same and share their answers.
    gains = answers.groupBy("chunk").applyInArrow(summed, "key bigint, gain double").groupBy("key").agg(F.avg("gain").alias("gain"))
    kind = dict(docs.dtypes)["doc_id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p1, row = unigram(frequent_counts.value, n_tokens, n_types), TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                tokens, begins = _numbered([t.as_py() or b"" for t in batch.column(1)])
                sizes = np.diff(np.append(begins, len(tokens)))
                ids = _places(tokens, frequent.value)
                known = ids >= 0
                base = np.where(known, p1[np.maximum(ids, 0)] if len(p1) else 0.0, 0.0)
                n_known = np.add.reduceat(known.astype(np.int64), begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(begins))),
                        batch.column(0),
                        pa.array(sizes),
                        pa.array(n_known),
                        pa.array(np.add.reduceat(base, begins)),
                        pa.array(_keys_of(tokens, begins)),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes - n_known)), pa.int32()), pa.array(tokens[~known])),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "base_score", "key", "rare"],
                )
                row += len(begins)

    schema = f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, key bigint, rare array<bigint>"
    parts = stored(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scored, schema), "lm-parts")
    n = F.coalesce(F.col("n"), F.lit(0))
    rare = (
        parts.select("row", F.explode("rare").alias("hash"))
        .join(words, "hash", "left")
        .groupBy("row")
        .agg(F.sum(F.log10((n + 0.5) / F.lit(counts.n_tokens + 0.5 * (counts.n_types + 1)))).alias("rare_score"), F.sum((n > 0).cast("long")).alias("rare_known"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("base_score") + zero("rare_score")
    return parts.join(rare, "row", "left").join(gains, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        base.alias("base_score"),
        (base + zero("gain")).alias("score"),
    )


def op2_trie_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % FOLDS
    counts, words = count_ngrams(docs.where(fold != HELD_OUT))
    return score(docs, counts, words).select(
        "doc_id", (fold == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(counts.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
