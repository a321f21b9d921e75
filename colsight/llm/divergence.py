"""Source divergence audit: how far each source's use of words is from that of every other source of its language.

Terms are counted in the tasks and kept if MIN_DOCS documents of the language have them. A group (lang, source) or a
language gives a kept term p = 1 + floor(SCALE * (count + 1) / (N + V)); two of them differ at a term by
floor((p - q)^2 / q), and over the language by the sum of that over all kept terms.

The group-term count matrix is cut into tiles of about TILE terms by BLOCK groups. A tile becomes two K-squared
quadtrees (bitmaps of the non-zero quadrants, level by level, with ranks for the children), one for the groups of
either side. Both are walked together, all pairs of groups at once: a quadrant that is zero on both sides has one
price a pair and term, p and q being those of a count of zero, so only its number of columns is noted; the others are
opened down to the single counts. Terms that neither side has are priced alike. A task holds one tile of either side, whatever the numbers of terms, groups and rows.

Defined cases: null text, lang and source count as ''; a group without terms is listed too; a language without kept
terms has pairs of value 0 and no terms; each row is a document by itself, whatever its doc_id; texts of any length
are read in slices; an empty table gives an empty result; ties are ranked by the item's UTF-8 bytes. Columns besides
text, lang and source are not read. p and the sums of differences stay within 64 bits: the p of a group add up to at
most SCALE + V, so a sum to about SCALE * (SCALE + V).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsight.llm.common import stored, table

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Terms and groups of a tile: memory only, never the result.
TILE, BLOCK = 1024, 32
#: Terms that a task holds before it passes their counts on, and bytes of a text read at once: memory only.
HELD, SLICE = 200_000, 1 << 20
#: Bytes of a term stay (A-Z in lower case), all others become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in slices."""
    spaced = text.translate(TERM_BYTES) if text else b""
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + SLICE)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(n.values(), pa.int64()),
                    pa.array(map(docs.__getitem__, terms), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3))):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in terms_of(text.as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size >= HELD:
                yield from flushed()
                size = 0
    yield from flushed()


def _named(docs: DataFrame) -> DataFrame:
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    return docs.select(blank("lang"), blank("source"), F.col("text").cast("binary").alias("text"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count n among `total` counts of `terms` terms; exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    scaled = (F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1)).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", scaled, wide(total + terms)).cast("long")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def count_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each kept term of each group that has it: lang, source, term, n, lang_n (over all groups), and
    `lead`, true in one row of each (lang, term). Stored."""
    counted = _named(docs).mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    sums = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # At most a row a group.
    term = W.partitionBy("lang", "term")
    kept = sums.withColumns({
        "lang_n": F.sum("n").over(term),
        "lang_docs": F.sum("docs").over(term),
        "lead": F.col("source") == F.min("source").over(term),
    })
    return stored(kept.where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"), "divergence-terms")


def list_groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Every group: lang, source, n (of kept terms), lang_n, v (kept terms of the language), no (from 0 within the
    language), groups (of the language). Stored."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("lead").cast("long")).alias("lead"))
    groups = _named(docs).select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0, ["n", "lead"])
    lang = W.partitionBy("lang")
    return stored(
        groups.select(
            "lang",
            "source",
            "n",
            F.sum("n").over(lang).alias("lang_n"),
            F.sum("lead").over(lang).alias("v"),
            (F.row_number().over(lang.orderBy("source")) - 1).alias("no"),
            F.count(F.lit(1)).over(lang).cast("int").alias("groups"),
        ),
        "divergence-groups",
    )


class QuadTree:
    """Bitmaps of a matrix's non-zero quadrants. Level k has four bits (upper left, upper right, lower left, lower
    right) for each set bit of level k - 1; `ranks` numbers the set bits; `values` follows those of the last level."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, depth: int) -> None:
        codes = np.zeros(len(rows), np.int64)
        for bit in range(depth):
            codes |= ((rows >> bit & 1) << (2 * bit + 1)) | ((columns >> bit & 1) << (2 * bit))
        order = np.argsort(codes)
        codes, self.values = codes[order], values[order]
        self.bits, self.ranks = [], []
        above = np.zeros(1 if len(codes) else 0, np.int64)
        for level in range(1, depth + 1):
            nodes = np.unique(codes >> 2 * (depth - level))
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.ranks.append(np.cumsum(bits) - 1)
            above = nodes
        self.empty = not len(codes)

    def child(self, level: int, nodes: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Numbers of the nodes' children in that quadrant; -1 where the node or the quadrant is zero."""
        if self.empty:
            return np.full(len(nodes), -1)
        at = 4 * nodes + quadrant
        there = (nodes >= 0) & self.bits[level][at]
        return np.where(there, self.ranks[level][at], -1)


#: The eight ways to go down: half of the left rows, half of the right rows, half of the columns.
WAYS = np.indices((2, 2, 2)).reshape(3, 8)


def walk(left: QuadTree, right: QuadTree, zero_left: np.ndarray, zero_right: np.ndarray, n_columns: int, depth: int) -> np.ndarray:
    """Sums of floor((p - q)^2 / q) over the columns for every left row (p) and right row (q). zero_*: what a row has
    where its count is zero."""
    shape = len(zero_left), len(zero_right)
    sums, columns = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    a = b = c = np.zeros(1, np.int64)
    node_a, node_b = (np.array([-1 if t.empty else 0]) for t in (left, right))
    for level in range(depth):
        side = 1 << (depth - level - 1)
        i, j, m = (np.tile(way, len(a)) for way in WAYS)
        a, b, c, node_a, node_b = (np.repeat(x, 8) for x in (a, b, c, node_a, node_b))
        a, b, c = 2 * a + i, 2 * b + j, 2 * c + m
        node_a, node_b = left.child(level, node_a, 2 * i + m), right.child(level, node_b, 2 * j + m)
        inside = (a * side < shape[0]) & (b * side < shape[1]) & (c * side < n_columns)
        zero = inside & (node_a < 0) & (node_b < 0)
        width = np.minimum(n_columns - c[zero] * side, side)
        # All pairs of rows below a quadrant share its number of columns.
        noted = np.zeros((-(-shape[0] // side), -(-shape[1] // side)), np.int64)
        np.add.at(noted, (a[zero], b[zero]), width)
        columns += noted.repeat(side, 0).repeat(side, 1)[: shape[0], : shape[1]]
        a, b, c, node_a, node_b = (x[inside & ~zero] for x in (a, b, c, node_a, node_b))
    p, q = zero_left[a], zero_right[b]
    if not left.empty:
        p = np.where(node_a >= 0, left.values[node_a], p)
    if not right.empty:
        q = np.where(node_b >= 0, right.values[node_b], q)
    np.add.at(sums, (a, b), (p - q) ** 2 // q)
    p, q = zero_left[:, None], zero_right[None, :]
    return sums + columns * ((p - q) ** 2 // q)


def _compare(tile: pa.Table) -> pa.Table:
    """Partial sums of one tile's pairs of groups."""
    column = lambda name: tile.column(name).to_numpy()
    low, high, no, p = column("low")[0], column("high")[0], column("no"), column("p")
    block, counted = column("block"), column("term").astype(object)
    is_cell = np.array([t is not None for t in counted])
    terms, columns = np.unique(counted[is_cell].astype(str), return_inverse=True)
    sides = {}
    depth = 1
    while 1 << depth < max(len(terms), int(column("size")[0])):
        depth += 1
    for side in {low, high}:
        own = block == side
        nos = np.sort(no[own & ~is_cell])
        zero = p[own & ~is_cell][np.argsort(no[own & ~is_cell])]
        cells = own & is_cell
        rows = np.searchsorted(nos, no[cells])
        sides[side] = nos, zero, QuadTree(rows, columns[own[is_cell]], p[cells], depth)
    found = []
    for one, other in {(low, high), (high, low)}:
        (nos, zero, tree), (to, to_zero, to_tree) = sides[one], sides[other]
        sums = walk(tree, to_tree, zero, to_zero, len(terms), depth)
        no_left, no_right = np.repeat(nos, len(to)), np.tile(to, len(nos))
        apart = no_left != no_right
        found.append((no_left[apart], no_right[apart], sums.ravel()[apart]))
    no_left, no_right, sums = (np.concatenate(x) for x in zip(*found))
    lang = tile.column("lang")[0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(sums), pa.string()),
        "no": pa.array(no_left, pa.int32()),
        "other": pa.array(no_right, pa.int32()),
        "value": pa.array(sums, pa.int64()),
        "terms": pa.array(np.full(len(sums), len(terms)), pa.int64()),
    })


def compare_groups(counts: DataFrame, groups: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    tiles = F.greatest(F.lit(1), F.ceil(F.col("v") / tile)).cast("int")
    own = groups.select("lang", "source", "no", "groups", "n", "v", tiles.alias("tiles"))
    # p of a count of zero; without terms none is needed.
    none = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1))
    zero = own.where("groups > 1").select(
        "lang",
        "no",
        "groups",
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
        F.lit(None).cast("string").alias("term"),
        none.alias("p"),
    )
    total = own.where("groups > 1").select("lang", "source", "no", "groups", F.col("n").alias("total"), "v", "tiles")
    cells = counts.join(total, ["lang", "source"]).select(
        "lang",
        "no",
        "groups",
        F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile"),
        "term",
        share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
    )
    block_no = F.floor(F.col("no") / block).cast("int")
    blocks = F.ceil(F.col("groups") / block).cast("int")
    rows = cells.unionByName(zero).withColumn("block", block_no).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(
        "lang", "tile", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "no", "term", "p", F.lit(block).alias("size")
    )
    sums = (
        rows.groupBy("lang", "tile", "low", "high")
        .applyInArrow(_compare, "lang string, no int, other int, value bigint, terms bigint")
        .groupBy("lang", "no", "other")
        .agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    )
    side = lambda no, source, p: groups.select("lang", F.col("no").alias(no), F.col("source").alias(source), "v", none.alias(p))
    both = sums.join(side("no", "source", "p"), ["lang", "no"]).join(side("other", "item", "q").drop("v"), ["lang", "other"])
    # Terms that no group of the two blocks has are in none of their tiles.
    value = F.col("value") + (F.col("v") - F.col("terms")) * difference(F.col("p"), F.col("q"))
    return both.select("lang", "source", "item", value.alias("value"))


def outstanding_terms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term that the group uses more than its language), value."""
    total = groups.select("lang", "source", F.col("n").alias("total"), F.col("lang_n").alias("lang_total"), "v")
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rows = counts.join(total, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    return rows.where(F.col("p") > F.col("q")).select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, top: int = TOP_TERMS, min_docs: int = MIN_DOCS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Ranked items of each group and part: all other sources, and the first `top` terms."""
    counts = count_terms(docs, min_docs)
    groups = list_groups(docs, counts)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    listed = lambda frame, part: frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    pairs = listed(compare_groups(counts, groups, tile, block), "pair")
    return pairs.unionByName(listed(outstanding_terms(counts, groups), "term").where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents", ["text", "lang", "source"]))


_P = "1 + ({scale}::HUGEINT * ({n} + 1)) // ({total} + v)"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, sum(lang_n)::HUGEINT AS lang_total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, lang_total, v
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN langs USING (lang)
),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_P.format(scale=SCALE, n="coalesce(n, 0)", total="total")} AS p,
    {_P.format(scale=SCALE, n="lang_n", total="lang_total")} AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term
) WHERE rank <= {TOP_TERMS}
"""
