"""Phrase collocation mining by stripes: each word keys an associative counter of the words that follow it.

A task keeps one stripe a word, with an entry for each one to three words that come next and one, without words, for the word
itself (and one for all words); stripes of all tasks are merged elementwise. So a task sends no more rows than words at a time,
however many phrases are frequent, and each phrase once. That one structure has all that a phrase needs: its count and
those of its parts are entries, and the largest count of a phrase one word longer is that of the entries that begin or end
with it. (A phrase two words longer with so many occurrences holds one of one word more with as many.)

Only what occurs MIN_COUNT times or more matters, and all parts of such a phrase do. So stripes are counted in three passes: of
words, then of pairs of words that may be frequent, then of triples and quadruples whose pairs may be. What may be
frequent is a bitmap of at most MAX_BITS bits, which errs to one side only: a phrase is never left out, and a full
bitmap costs time and not the result. There words and phrases are two independent hashes, of 64 and 32 bits: occurrences count as the same
phrase if both agree. The last pass builds stripes with the words themselves, to name what was counted: not where it occurs, which
in a larger corpus is in ever more tasks, but only in the texts with the least mark of all that hold it.

Defined cases: a null text is empty, a null lang is 'und'; documents without words add nothing; repeated rows count
each; texts of any length are read in chunks that share three words where no piece ends; a language without candidates
has no rows; an empty table gives an empty result; ties are ordered by the phrase's UTF-8 bytes. Columns besides text
and lang are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsight.llm.common import stored, table

MIN_COUNT = 30
MAX_WORDS = 4
#: A phrase is dropped if a longer one has this percentage of its occurrences.
SUBSUMED = 80
SCALE = 2_000_000
TOP = 2000
#: Bits of a bitmap a frequent phrase, and of a whole bitmap: time only, never the result.
BITS_EACH, MAX_BITS = 16, 1 << 28
#: Bytes of text, hash counts and stripe entries that a task holds: memory only, never the result.
CHUNK, HELD, ENTRIES = 1 << 21, 500_000, 200_000
#: Bytes of a text that are hashed in one array operation.
BLOCK = 1 << 16
#: Marks of texts: a phrase is named in about one text, and one more for each so many occurrences; time only.
MARKS = 1 << 16

#: A-Z in lower case; what divides words (1) and pieces (2).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STOPS = [bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"]
SPACES = [b" ", b"\t"]
KIND = np.array([1 if bytes([c]) in SPACES else 2 if bytes([c]) in STOPS else 0 for c in range(256)], np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hash:
    """64-bit hashes of all words of a text at once: differences of a running sum of bytes times powers of an odd
    base, modulo 2^64. A sum runs over whole words of about BLOCK bytes, so no more powers are held, but for a longer word."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.step = _mixed(np.array([base], np.uint64))[0] | np.uint64(1)
        self.powers = self.inverses = np.ones(0, np.uint64)

    def words(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
        found = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            at = starts[first]
            past = max(int(np.searchsorted(ends, at + BLOCK, "right")), first + 1)
            size = int(ends[past - 1] - at)
            if size > len(self.powers):
                self.powers = np.multiply.accumulate(np.full(max(size, BLOCK), self.base))
                self.inverses = np.multiply.accumulate(np.full(max(size, BLOCK), self.inverse))
            part = text[at : at + size].astype(np.uint64)
            part += np.uint64(1)
            part *= self.powers[:size]
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(part, out=sums[1:])
            begin = starts[first:past] - at
            found[first:past] = (sums[ends[first:past] - at] - sums[begin]) * self.inverses[begin]
            first = past
        # Spread first: languages differ by little, and so do words by their first byte.
        return _mixed(found + _mixed(np.array([seed], np.uint64) + self.base))

    def longer(self, phrases: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        return _mixed(phrases * self.step + nexts)


BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class Chunk:
    """The words of a text, or of texts by lines: byte ranges, the piece of each, how many at the start were counted before,
    and the marks and sizes of the texts."""

    def __init__(self, lang: str, text: bytes, counted: int, marks: Sequence[int] = (0,), sizes: Sequence[int] | None = None) -> None:
        self.lang, self.text, self.counted = lang, text.translate(LOWER), counted
        self.marks, self.sizes = np.array(marks, np.int32), np.array(sizes or [len(text)], np.int64)
        self.bytes = np.frombuffer(self.text, np.uint8)
        kinds = KIND[self.bytes]
        edges = np.flatnonzero(np.diff(kinds == 0, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.pieces = np.cumsum(kinds == 2, dtype=np.int32)[self.starts]
        self.seed = hash_of(lang)

    def hashes(self, by: Hash) -> np.ndarray:
        return by.words(self.bytes, self.starts, self.ends, self.seed)

    def phrases(self, size: int) -> np.ndarray:
        """Whether a phrase of so many words that was not counted before starts at each word but the last ones."""
        n = max(len(self.starts) - size + 1, 0)
        whole = self.pieces[:n] == self.pieces[size - 1 :]
        whole[: max(self.counted - size + 1, 0)] = False
        return whole

    def texts(self) -> np.ndarray:
        """The mark of the text that each word is in."""
        past = np.searchsorted(self.starts, np.cumsum(self.sizes + 1))
        return np.repeat(self.marks, np.diff(past, prepend=0))

    def words(self) -> pa.Array:
        """Words are at the even places, what is between them at the odd ones."""
        offsets = np.empty(2 * len(self.starts), np.int32)
        offsets[::2], offsets[1::2] = self.starts, self.ends
        return pa.Array.from_buffers(pa.binary(), max(len(offsets) - 1, 0), [None, pa.py_buffer(offsets), pa.py_buffer(self.text)])


def hash_of(name: str) -> int:
    h = 0
    for c in name.encode("utf-8", "surrogatepass"):
        h = (h * 1_000_003 + c + 1) % (1 << 64)
    return h


def mark(text: bytes) -> int:
    """Depends on the text alone, so it is the same in every pass."""
    return zlib.crc32(text) % MARKS


def marked(h: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """One hash of a phrase and the mark of a text."""
    return _mixed(h + marks.astype(np.uint64) * np.uint64(BASES[1]))


def cut(text: bytes, limit: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text that end with a piece, or else with a word: then the next part begins three words earlier, and
    those are told."""
    last = lambda marks, start, end: max(text.rfind(m, start, end) for m in marks)
    at = counted = 0
    while len(text) - at > limit:
        size = limit
        while at + size < len(text):
            end = at + size
            if (stop := last(STOPS, at, end)) > at:
                yield text[at : stop + 1], counted
                at, counted = stop + 1, 0
                break
            if (end := last(SPACES, at, end)) > at:
                back = end
                for _ in range(MAX_WORDS - 1):
                    while back > at and text[back - 1 : back] in SPACES:
                        back -= 1
                    back = last(SPACES, at, back) + 1
                if back > at:
                    yield text[at:end], counted
                    at, counted = back, MAX_WORDS - 1
                    break
            size *= 2  # few long words
        else:
            break
    yield text[at:], counted


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Chunk]:
    """Chunks of about `limit` bytes, each of one language; a line break parts the documents."""
    waiting: dict[str, tuple[list[bytes], int]] = {}
    joined = lambda lang, texts: Chunk(lang, b"\n".join(texts), 0, list(map(mark, texts)), list(map(len, texts)))
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, text = lang.as_py(), text.as_py()
            if len(text) > limit:
                yield from (Chunk(lang, part, counted, [mark(text)]) for part, counted in cut(text, limit))
                continue
            texts, size = waiting.get(lang, ([], 0))
            texts.append(text)
            waiting[lang] = texts, size + len(text) + 1
            if waiting[lang][1] >= limit:
                yield joined(lang, waiting.pop(lang)[0])
        # A batch is bounded, and so is what waits for its language.
        for lang, (texts, _) in waiting.items():
            yield joined(lang, texts)
        waiting.clear()


class Bitmap:
    """What may be frequent: two bits a hash."""

    def __init__(self, words: np.ndarray, places: np.ndarray, bits: int) -> None:
        full = np.zeros(bits >> 6, np.uint64)
        full[places] = words
        self.bytes, self.shift = full.view(np.uint8), np.uint64(64 - (bits.bit_length() - 1))
        self.mask = np.uint64(bits - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        one, two = h >> self.shift, h & self.mask
        bit = lambda at: (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return (bit(one) & bit(two)).astype(bool)


def bitmap(frequent: DataFrame) -> Broadcast:
    """A Bitmap of a frame of hashes `h`, put together on the executors, for the tasks of the next pass."""
    n = frequent.count()
    bits = 1 << 16
    while bits < min(BITS_EACH * n, MAX_BITS):
        bits *= 2
    length = bits.bit_length() - 1
    places = F.explode(F.array(F.shiftrightunsigned("h", 64 - length), F.col("h").bitwiseAND(F.lit(bits - 1)))).alias("place")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    words = frequent.select(places).groupBy(F.shiftrightunsigned("place", 6).alias("at")).agg(F.bit_or(one).alias("word"))
    found = words.toArrow()  # at most MAX_BITS / 64 rows
    return frequent.sparkSession.sparkContext.broadcast(
        Bitmap(found.column("word").to_numpy().view(np.uint64), found.column("at").to_numpy(), bits)
    )


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))


def _half(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


#: A stripe's entries in hashes: those of the phrase, its occurrences, and the least mark of the texts that hold it.
ENTRY = "h bigint, g int, n bigint, mark int"
COLUMNS = [column.split()[0] for column in ENTRY.split(", ")]


def _summed(h: np.ndarray, g: np.ndarray, n: np.ndarray, marks: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal entries (both hashes) as one: occurrences are added, the least mark stays."""
    if not len(h):
        return h, g, n, marks, word
    order = np.argsort(h)
    same = np.diff(h[order]) == 0
    if (np.diff(g[order])[same] != 0).any():  # a collision of the first hash
        order = np.lexsort((g, h))
    h, g = h[order], g[order]
    at = np.flatnonzero(np.concatenate([[True], (np.diff(h) != 0) | (np.diff(g) != 0)]))
    return h[at], g[at], np.add.reduceat(n[order], at), np.minimum.reduceat(marks[order], at), word[order[at]]


def _by_word(h: np.ndarray, g: np.ndarray, n: np.ndarray, marks: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """Stripes, a row a word."""
    order = np.argsort(word)
    word = word[order]
    at = np.flatnonzero(np.concatenate([[len(word) > 0], np.diff(word) != 0])[: len(word)])
    entries = pa.StructArray.from_arrays([pa.array(x[order]) for x in (h.view(np.int64), g.view(np.int32), n, marks)], COLUMNS)
    nexts = pa.ListArray.from_arrays(pa.array(np.append(at, len(word)).astype(np.int32)), entries)
    return pa.RecordBatch.from_arrays([pa.array(word[at].view(np.int64)), nexts], names=["word", "nexts"])


def frequent_stripes(texts: DataFrame, sizes: tuple[int, ...], within: Broadcast | None, min_count: int, chunk: int) -> DataFrame:
    """The merged stripes' entries, in hashes, of the phrases of these sizes that min_count occurrences or more have; of those alone
    whose words (sizes from 2) or pairs (sizes from 3) `within` may have. Stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Hash(base) for base in BASES]
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0
        for part in chunks(batches, chunk):
            words = [part.hashes(by) for by in hashes]
            phrases, marks = words, part.texts()
            open_ = None
            for size in range(1, max(sizes) + 1):
                if size > 1:
                    phrases = [by.longer(p[:-1], w[size - 1 :]) for by, p, w in zip(hashes, phrases, words)]
                if within is not None and size == min(min(sizes) - 1, 2):
                    open_ = within.value.has(phrases[0])
                    least = size
                if size not in sizes:
                    continue
                ok = part.phrases(size)
                if open_ is not None:
                    for k in range(size - least + 1):
                        ok &= open_[k : k + len(ok)]
                at = np.flatnonzero(ok)
                entries = phrases[0][at], _half(phrases[1][at]), np.ones(len(at), np.int64), marks[at], words[0][at]
                waiting.append(_summed(*entries))
                held += len(waiting[-1][0])
            if held >= HELD:
                waiting = [_summed(*map(np.concatenate, zip(*waiting)))]
                held = len(waiting[0][0])
                if held >= HELD // 2:
                    yield _by_word(*waiting[0])
                    waiting, held = [], 0
        if waiting:
            yield _by_word(*_summed(*map(np.concatenate, zip(*waiting))))

    struct = ", ".join(column.replace(" ", ": ") for column in ENTRY.split(", "))
    entries = texts.mapInArrow(count, f"word bigint, nexts array<struct<{struct}>>").select(F.inline("nexts"))
    merged = entries.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("mark").alias("mark"))
    return stored(merged.where(F.col("n") >= min_count), "collocation-hashes")


def places(frequent: DataFrame) -> DataFrame:
    """Hashes `h` of each phrase with its mark."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, marks = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(marked(h.view(np.uint64), marks).view(np.int64))], names=["h"])

    return frequent.select("h", "mark").mapInArrow(hashed, "h bigint")


def hashed_names(names: DataFrame) -> DataFrame:
    """lang, word, next with the two hashes `h` and `g` of the phrase."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Hash(base) for base in BASES]
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                rows = batch.filter(pc.equal(langs.indices, code))
                whole = [rows.column(k).cast(pa.binary()).to_pylist() for k in (1, 2)]
                part = Chunk(lang, b"\n".join(a if b is None else a + b" " + b for a, b in zip(*whole)), 0)
                sizes = np.bincount(part.pieces, minlength=rows.num_rows)
                first = np.cumsum(sizes) - sizes
                found = []
                for h in by:
                    words = part.hashes(h)
                    phrases = words[first]
                    for size in range(1, MAX_WORDS):
                        more = np.flatnonzero(sizes > size)
                        phrases[more] = h.longer(phrases[more], words[first[more] + size])
                    found.append(phrases)
                both = pa.array(found[0].view(np.int64)), pa.array(_half(found[1]).view(np.int32))
                yield pa.RecordBatch.from_arrays([*rows.columns, *both], names=["lang", "word", "next", "h", "g"])

    return names.select("lang", "word", "next").mapInArrow(hashed, "lang string, word string, next string, h bigint, g int")


def _same(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of one occurrence of each pair of hashes, and the numbers of occurrences."""
    left = np.arange(len(first))
    while len(left):
        _, at, which, n = np.unique(first[left], return_index=True, return_inverse=True, return_counts=True)
        other = second[left] != second[left[at]][which]
        if other.any():  # a collision of the first hash: those come next
            n = n - np.bincount(which[other], minlength=len(n))
        yield left[at], n
        left = left[other]


def mine_stripes(texts: DataFrame, within: list[Broadcast], chunk: int, places: Broadcast | None = None) -> DataFrame:
    """The merged stripes: lang, word (empty: all words), next (null: the word itself), n. within: bitmaps of words, of pairs, and
    of longer phrases. places: a bitmap of phrases with marks; then phrases have entries of the texts with their mark alone."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Hash(base) for base in BASES]
        stripes: dict[tuple[str, bytes], Any] = defaultdict(lambda: defaultdict(int))
        entries = 0

        def flushed() -> pa.RecordBatch:
            langs, words = zip(*stripes)
            sizes = np.fromiter(map(len, stripes.values()), np.int32, len(stripes))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            nexts = pa.array([phrase for stripe in stripes.values() for phrase in stripe], pa.binary()).cast(pa.string())
            numbers = pa.array([n for stripe in stripes.values() for n in stripe.values()], pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.ListArray.from_arrays(offsets, nexts),
                    pa.ListArray.from_arrays(offsets, numbers),
                ],
                names=["lang", "word", "nexts", "ns"],
            )

        for part in chunks(batches, chunk):
            new = len(part.starts) - part.counted
            if new <= 0:
                continue
            stripes[part.lang, b""][None] += new
            words = [part.hashes(by) for by in hashes]
            listed, phrases, marks = part.words(), words, part.texts()
            for size in range(1, MAX_WORDS + 1):
                if size > 1:
                    phrases = [by.longer(p[:-1], w[size - 1 :]) for by, p, w in zip(hashes, phrases, words)]
                at = np.flatnonzero(part.phrases(size) & within[min(size, 3) - 1].value.has(phrases[0]))
                if places is not None:
                    at = at[places.value.has(marked(phrases[0][at], marks[at]))]
                for chosen, n in _same(phrases[0][at], phrases[1][at]):
                    word, *after = [listed.take(pa.array(2 * (at[chosen] + k))) for k in range(size)]
                    nexts = pc.binary_join_element_wise(*after, b" ") if after else pa.nulls(len(word))
                    for first, rest, count in zip(word.to_pylist(), nexts.to_pylist(), n.tolist()):
                        stripes[part.lang, first][rest] += count
                    entries += len(chosen)
            if entries >= ENTRIES:
                entries = sum(map(len, stripes.values()))
                if entries >= ENTRIES // 2:
                    yield flushed()
                    stripes.clear()
                    entries = 0
        if stripes:
            yield flushed()

    rows = texts.mapInArrow(build, "lang string, word string, nexts array<string>, ns array<bigint>")
    entries = rows.select("lang", "word", F.inline(F.arrays_zip("nexts", "ns")).alias("next", "n"))
    return entries.groupBy("lang", "word", "next").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, subsumed: int = SUBSUMED, chunk: int = CHUNK) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = _texts(docs)
    counted: list[DataFrame] = []
    within: list[Broadcast] = []
    for sizes in (1,), (2,), (3, 4):
        counted.append(frequent_stripes(texts, sizes, within[-1] if within else None, min_count, chunk))
        within.append(bitmap(counted[-1]))
    counts = counted[0].unionByName(counted[1]).unionByName(counted[2])
    least = bitmap(places(counts))
    root = F.col("word") == ""
    named = stored(mine_stripes(texts, within, chunk, least), "collocation-names")
    for sent in (*within, least):
        sent.destroy()
    names = hashed_names(named.where(~root)).join(counts.select("h", "g", "n"), ["h", "g"])
    stripes = stored(names.select(*named.columns).unionByName(named.where(root)), "collocation-stripes")

    parts = F.split("phrase", " ", -1)
    piece = lambda start, size: F.array_join(F.slice(parts, start, size), " ")
    phrases = stripes.where(~root).select("lang", F.concat_ws(" ", "word", "next").alias("phrase"), "next", "n")
    totals = phrases.where(F.size(parts) < MAX_WORDS)
    found = phrases.where(F.col("next").isNotNull()).select("lang", "phrase", F.col("n").alias("a"))
    longer = found.where(F.size(parts) > 2)
    ends, begins = (
        longer.select("lang", piece(F.lit(start), F.size(parts) - 1).alias("phrase"), F.col("a").alias("longer")) for start in (2, 1)
    )
    longest = ends.unionByName(begins).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: c.cast("decimal(20,0)")
    inside = F.coalesce(wide(F.col("longer")) * 100 >= wide(F.col("a")) * subsumed, F.lit(False))
    open_ = found.join(longest, ["lang", "phrase"], "left").where(~inside).select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    cuts = open_.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.size(parts)).alias("rest"))
    of = lambda part, count: totals.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.call_function("div", (wide(F.col("a")) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)"), (wide(F.col("l")) + wide(F.col("r"))))
    lowest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).join(stripes.where(root).select("lang", "n"), "lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op11_phrase_stripes(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents", ["lang", "text"]))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents
),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS w FROM d),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, m, phrase, count(*) AS n FROM (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
    FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, {MAX_WORDS + 1}) s(m) WHERE len(w) >= m)
  ) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
),
c AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inner_ AS (
  SELECT DISTINCT s.lang, s.phrase FROM (
    SELECT lang, a AS longer, array_to_string(w[i : i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM c, range(2, {MAX_WORDS}) s(m) WHERE m < len(w))
  ) s JOIN c USING (lang, phrase) WHERE 100 * s.longer >= {SUBSUMED} * c.a
),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c ANTI JOIN inner_ USING (lang, phrase))
),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.n AS l, y.n AS r, ({SCALE}::HUGEINT * a // (x.n + y.n))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN words USING (lang) WHERE rank <= {TOP}
"""
