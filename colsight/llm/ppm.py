"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of byte counts. The code length of a byte comes from the longest known context;
what that context has not seen costs an escape (method C: distinct followers over occurrences plus distinct
followers) and is coded by the next shorter context without the followers already ruled out, down to a uniform
order. Counts are frozen after fitting, so each (context, byte) has one length: the trees of all languages share one
set of contexts, the lengths are a table, and a document is scored by array look-ups, `order` + 1 a byte. The
language with the shortest code wins, the first by name in ties.

Fitting takes a bounded sample of labelled text: of each language pieces of PIECE_CHARS characters, about `fit_bytes`
bytes in all (everything, if it has no more), chosen by a hash of text and piece; counts are summed on the executors. Followers of contexts of two or more bytes need two occurrences; of
all contexts, the most frequent are kept while the table stays under `cells` numbers
(contexts x bytes x languages). Both bounds are parameters. Scoring reads whole texts.

Defined cases: null texts and texts without a letter are `und` with score 0; rows with null text or lang are not
learned from; a null doc_id counts as the text `null` in the fold; without learned languages all is `und`; repeated
rows are scored alike. Columns besides the named ones are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from colsight.llm.common import table

ORDER = 4
FIT_BYTES = 200_000
PIECE_CHARS = 512
#: Bytes of a language's sample that a task counts: memory only.
PART_BYTES = 1_000_000
CELLS = 6_000_000
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: Bytes scored in one array operation.
SLICE = 1 << 19


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS


@dataclass
class Model:
    languages: list[str]
    order: int
    codes: np.ndarray  # byte -> dense code; unseen bytes share the last code
    child: np.ndarray  # (context, code further back) -> longer context, 0 if unknown; context 0 is the empty one
    bits: np.ndarray  # (context * codes + code, language) -> code length in bits


def _grams(text: bytes, order: int) -> Iterator[bytes]:
    for n in range(order + 1):
        yield from (text[k : k + n + 1] for k in range(len(text) - n))


def count_in_tasks(sample: DataFrame, order: int, parts: int) -> DataFrame:
    """(lang, gram, n): counts of the tasks, to be summed. Each language is in at most `parts` tasks, however many the sample came from."""

    def counted(lang: str, of: dict[bytes, int]) -> pa.RecordBatch:
        grams = list(of)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams)), pa.array(grams, pa.binary()), pa.array(list(of.values()), pa.int64())],
            names=["lang", "gram", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, defaultdict(int)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang != last and of:
                    yield counted(last, of)
                    of = defaultdict(int)
                last = lang
                for gram in _grams(text, order):
                    of[gram] += 1
        if of:
            yield counted(last, of)

    rows = sample.select("lang", F.col("text").cast("binary").alias("text"))
    dealt = rows.repartition("lang", F.pmod(F.xxhash64("text"), F.lit(parts))).sortWithinPartitions("lang")
    return dealt.mapInArrow(count, "lang string, gram binary, n bigint")


def count_followers(sample: DataFrame, order: int, parts: int = 1) -> DataFrame:
    """(lang, gram, n) of the sample's (lang, text)."""
    return count_in_tasks(sample, order, parts).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, order: int = ORDER, fit_bytes: int = FIT_BYTES, cells: int = CELLS) -> Model:
    """labelled (doc_id, text, lang); rows of held-out documents must be gone already."""
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    digest = F.xxhash64("text")
    once = labelled.select("lang", digest.alias("digest"), F.octet_length("text").alias("size")).distinct()
    sizes = once.groupBy("lang").agg((F.lit(float(fit_bytes)) / F.greatest(F.lit(1), F.sum("size"))).alias("share"))
    # A piece is told by its text and number, so neither one long document nor one doc_id decides for a language.
    place = lambda k: F.pmod(F.xxhash64(digest, k, F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_CHARS).cast("int"))
    chosen = F.filter(numbers, lambda k: place(k) < F.col("share"))
    # Pieces are cut before rows are made of them, so a long text is not copied for each.
    cut = F.transform(chosen, lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), k * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("text")))
    sample = labelled.where(F.length("text") > 0).join(F.broadcast(sizes), "lang")  # a row a language
    sample = sample.select("lang", digest.alias("digest"), F.inline(cut))
    sample = sample.dropDuplicates(["lang", "digest", "k"])
    parts = max(1, math.ceil(fit_bytes / PART_BYTES))
    rows = count_followers(sample, order, parts).where((F.octet_length("gram") <= 2) | (F.col("n") >= 2)).toArrow()  # of the bounded sample
    counts: dict[str, dict[bytes, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
    for batch in rows.to_batches():
        for lang, gram, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            counts[lang][gram[:-1]][gram[-1]] = n
    del rows
    return build(counts, order, cells)


def build(counts: dict[str, dict[bytes, dict[int, int]]], order: int, cells: int) -> Model:
    """The table of code lengths from followers by language and context."""
    languages = sorted(counts)
    seen = sorted({s for lang in languages for s in counts[lang].get(b"", {})})
    codes = np.full(256, len(seen), np.int32)
    codes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    total: dict[bytes, int] = defaultdict(int)
    for lang in languages:
        for context, followers in counts[lang].items():
            total[context] += sum(followers.values())
    most = max(1, cells // (width * max(1, len(languages))))
    # Shorter first among equals: a context is never kept without its suffixes, which are at least as frequent.
    kept = sorted(sorted(total, key=lambda c: (-total[c], len(c), c))[:most], key=lambda c: (len(c), c))
    held = set(kept)
    kept = [c for c in kept if all(c[k:] in held for k in range(1, len(c) + 1))] or [b""]
    number = {c: k for k, c in enumerate(kept)}
    child = np.zeros((len(kept), width), np.int32)
    for context, k in number.items():
        if context:
            child[number[context[1:]], codes[context[0]]] = k
    bits = np.zeros((len(kept), width, len(languages)), np.float32)
    for at, lang in enumerate(languages):
        # full[c]: lengths in context c; past[c]: lengths in c once the followers of a longer context are ruled out.
        full: dict[bytes, np.ndarray] = {}
        past: dict[tuple[bytes, bytes], np.ndarray] = {}
        for context in kept:
            followers = counts[lang].get(context)
            if followers is None:
                full[context] = full[context[1:]] if context else np.full(width, 8.0)
            else:
                full[context] = _lengths(counts[lang], context, np.zeros(width, bool), codes, past)
            bits[number[context], :, at] = full[context]
    return Model(languages, order, codes, child, bits.reshape(-1, max(1, len(languages))))


def _lengths(
    tree: dict[bytes, dict[int, int]], context: bytes, ruled_out: np.ndarray, codes: np.ndarray, past: dict[tuple[bytes, bytes], np.ndarray]
) -> np.ndarray:
    """Code lengths in a context of the tree, for all codes that are not ruled out."""
    key = context, ruled_out.tobytes()
    if key in past:
        return past[key]
    n = np.zeros(len(ruled_out))
    followers = tree.get(context, {})
    n[codes[list(followers)]] = list(followers.values())
    n[ruled_out] = 0
    total, distinct = n.sum(), np.count_nonzero(n)
    known = ruled_out | (n > 0)
    if context:
        shorter = _lengths(tree, context[1:], known, codes, past)
    else:
        shorter = np.full(len(n), np.log2(max(1, 256 - np.count_nonzero(known[:-1]))))
    if distinct:
        with np.errstate(divide="ignore"):
            shorter = np.where(n > 0, np.log2((total + distinct) / n), np.log2((total + distinct) / distinct) + shorter)
    past[key] = shorter
    return shorter


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language; long texts go through in slices that overlap by the order."""
    result = np.zeros((len(texts), len(model.languages)))
    width = model.child.shape[1]
    child, codes = model.child.ravel(), model.codes
    group: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not group:
            return
        data = codes[np.frombuffer(b"".join(piece for _, _, piece in group), np.uint8)]
        sizes = np.array([len(piece) for _, _, piece in group])
        begins = np.cumsum(sizes) - sizes
        deep = np.arange(len(data), dtype=np.int32) - np.repeat(begins, sizes).astype(np.int32)
        node = np.zeros(len(data), np.int32)
        longest = node.copy()
        for back in range(1, model.order + 1):
            further = np.zeros(len(data), np.int32)
            further[back:] = child[node[back:] * width + data[:-back]]
            # Only within the text, and only from a known context of one byte less.
            further[(deep < back) | ((node == 0) if back > 1 else False)] = 0
            node = further
            np.copyto(longest, node, where=node > 0)
        bits = model.bits[longest * width + data]
        for k, (_, skip, _) in enumerate(group):
            if skip:
                bits[begins[k] : begins[k] + skip] = 0
        sums = np.add.reduceat(bits.astype(np.float64), begins, axis=0)
        for k, (at, _, _) in enumerate(group):
            result[at] += sums[k]
        group.clear()

    held = 0
    for at, text in enumerate(texts):
        for begin in range(0, len(text), SLICE):
            skip = min(begin, model.order)
            piece = text[begin - skip : begin + SLICE]
            group.append((at, skip, piece))
            held += len(piece)
            if held >= SLICE:
                flush()
                held = 0
    flush()
    return result


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    """docs with a text and any columns: `row`, a struct of the columns to keep, with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most `cells` numbers
    columns = list(dict.fromkeys([*keep, "text"]))
    text_at, kept = columns.index("text"), list(range(len(keep)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            fields = batch.column(0).flatten()
            texts = fields[text_at].cast(pa.binary()).to_pylist()
            live = [k for k, text in enumerate(texts) if text and model.languages and has_letter(text)]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            lengths = code_lengths(model, [texts[k] for k in live])
            for k, row in zip(live, lengths):
                best = int(row.argmin())
                langs[k], scores[k] = model.languages[best], float(1 / np.exp2(np.maximum(row[best] - row, -1000.0)).sum())
            rows = pa.StructArray.from_arrays([fields[k] for k in kept], fields=[batch.column(0).type.field(k) for k in kept])
            yield pa.RecordBatch.from_arrays([rows, pa.array(langs), pa.array(scores)], names=["row", "lang_pred", "score"])

    packed = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"))
    schema = StructType([
        StructField("row", StructType([docs.schema[c] for c in keep])),
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
    ])
    return packed.mapInArrow(score, schema)


def op5_ppm_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "text", "lang"])
    model = fit(docs.where(fold(F.col("doc_id")) != HELD_OUT))
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"]).select("row.doc_id", "row.held_out", "lang_pred", "score")
