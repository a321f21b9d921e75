"""Token files: one Parquet row a document, its token ids as a list column, in ascending doc_id order.

Layout: `doc_id`, `part` and `offset` (ids before the document within its part) are delta-encoded, `ids` is
dictionary-encoded (a vocabulary fits in one dictionary page) and bit-packed; row groups are bounded by bytes and
pages are small, so the page index lets a reader skip to a range of documents, and a reader of metadata never
touches the ids. Each range partition is a part and a file; the number of ids before a part comes from one sum a
part, read from the small columns. Encoding goes piece by piece through a bounded cache, texts of any length in slices
cut at white space, so the ids equal those of the whole text.

Defined cases: null and empty texts hold the end id alone; a null doc_id sorts first; rows that share a doc_id are
kept, ordered by text; an empty table gives a folder without rows. Columns besides the named ones are not read;
metadata columns may not be called like a column of the files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsight.llm.common import scratch, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Pieces a Python worker remembers before it starts over, eight times the words, and characters encoded at once; memory only,
#: never the result.
CACHE_PIECES, SLICE = 500_000, 1 << 20
ROW_GROUP_BYTES = 32 << 20
#: Characters of a text that take part in the choice of its file.
RANGE_CHARS = 32
PAGE_BYTES = 64 << 10
#: Parts (a small row each) up to which their offsets are sent to every executor instead of shuffling the ids.
BROADCAST_PARTS = 1_000_000
#: Documents in an output batch of Arrow.
BATCH_DOCS = 512


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable Latin-1 bytes stand for themselves, the rest, in order, for letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class PieceIds(dict):
    """Ids of the tokenizer's pieces as little-endian 32-bit numbers, remembered within bounds."""

    def __init__(self, merges: Any, size: int) -> None:
        super().__init__()
        self.merges, self.letters, self.size = merges, _byte_letters(), size

    def __missing__(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        if len(self) >= self.size:
            self.clear()
        found = self[piece] = array("i", [t.id for t in self.merges.tokenize(text)]).tobytes()
        return found


class TextIds:
    """Ids of texts as little-endian 32-bit numbers.

    Slices of ASCII marks and Latin letters are cut into the tokenizer's pieces here (lower case, then PATTERN), and only
    pieces not yet known go through the merges. All others go word by word: the tokenizer drops white space and no rule
    of it crosses a space or a line feed.
    """

    #: Fixed value: the tokenizer's rule for pieces.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SIMPLE = re.compile("[!-~ \n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    #: The same rule over those characters; letters, the usual case, come first.
    PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, slice_size: int = SLICE) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = PieceIds(self.tokenizer.model, cache_pieces)
        self.words: dict[str, bytes] = {}
        self.cache_words, self.slice_size = cache_pieces // 8, slice_size
        rules = json.loads(self.tokenizer.to_str())
        before = (rules["normalizer"] or {}).get("normalizers", ()), (rules["pre_tokenizer"] or {}).get("pretokenizers", ())
        self.simple = (
            [n["type"] for n in before[0]] == ["NFC", "Replace", "Lowercase"]
            and [n["type"] for n in before[1]] == ["Split", "ByteLevel"]
            and before[1][0]["pattern"] == {"Regex": self.PATTERN}
        )

    def _is_simple(self, text: str) -> bool:
        # Special tokens hold "<|"; they are the tokenizer's business.
        return self.simple and "<|" not in text and self.SIMPLE.fullmatch(text) is not None

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if self._is_simple(word):
                found = b"".join(map(self.pieces.__getitem__, self.PIECES.findall(word.lower())))
            else:
                found = array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            if len(self.words) >= self.cache_words:
                self.words.clear()
            self.words[word] = found
        return found

    def _slices(self, text: str) -> Iterator[str]:
        """The text, cut at spaces and line feeds."""
        at = 0
        while len(text) - at > self.slice_size:
            end = max(text.rfind(" ", at, at + self.slice_size), text.rfind("\n", at, at + self.slice_size))
            if end <= at:  # one long word
                ends = [e for e in (text.find(" ", at + 1), text.find("\n", at + 1)) if e >= 0]
                if not ends:
                    break
                end = min(ends)
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, text: str, end: bytes) -> bytes:
        found = []
        for part in self._slices(text):
            if self._is_simple(part):
                found.append(b"".join(map(self.pieces.__getitem__, self.PIECES.findall(part.lower()))))
            else:
                found.append(b"".join(map(self._word, part.replace("\n", " ").split(" "))))
        return b"".join(found) + end


@lru_cache(maxsize=2)
def encoder_of(path: str) -> TextIds:
    """One a Python worker: its tasks share the pieces they remember."""
    return TextIds(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    metadata: Sequence[str] = (),
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Writes docs (doc_id, text and the metadata columns) as token files."""
    spark = docs.sparkSession
    name = tokenizer or TOKENIZER
    metadata = tuple(metadata)
    if clash := {"doc_id", "part", "offset", "n_tokens", "ids", "start", "base", "text"}.intersection(metadata):
        raise ValueError(f"The token files have a column {min(clash)} of their own.")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = encoder_of(name if os.path.sep in name else tokenizer_path(name)), array("i", [end_id]).tobytes()
        part, offset = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                ids = [encoder.encode(text or "", end) for text in batch.column(1).to_pylist()]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                ends = np.cumsum(lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(offset + ends - lengths),
                        pa.array(lengths.astype(np.int32)),
                        lists,
                        *(batch.column(2 + k) for k in range(len(metadata))),
                    ],
                    names=["doc_id", "part", "offset", "n_tokens", "ids", *metadata],
                )
                offset += int(ends[-1])

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, part int, offset bigint, n_tokens int, ids array<int>"
    schema += "".join(f", `{c}` {kinds[c]}" for c in metadata)
    rows = docs.select("doc_id", "text", *metadata)
    # Rows that share a doc_id may be many: the start of the text, whose order is that of texts, divides them.
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "offset")},
    }
    ordered.mapInArrow(encode, schema).write.options(**options).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens: read without the ids."""
    return _started(spark.read.parquet(path).select("doc_id", "part", "offset", "n_tokens"), spark, path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All columns of the documents from `first` to `last`; the bounds reach the row groups and the page index."""
    rows = spark.read.parquet(path)
    rows = rows if first is None else rows.where(F.col("doc_id") >= first)
    rows = rows if last is None else rows.where(F.col("doc_id") <= last)
    return _started(rows, spark, path)


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("part_ids"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    bases = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("base"))
    if parts.count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("offset")).drop("part", "offset", "base")


def checksums(rows: DataFrame) -> DataFrame:
    """Replaces `ids` by the CRC-32 of the ids as little-endian unsigned 32-bit integers, and n_tokens by their number."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.asarray(lists.offsets)
            values = np.ascontiguousarray(np.asarray(lists.values), "<u4")
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    return rows.select("doc_id", "start", "ids").mapInArrow(digest, schema)


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, folder, "documents", ["doc_id", "text"]), path)
    return checksums(read_tokens(spark, path))
