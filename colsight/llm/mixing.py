"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents lie in a seeded order on a line of tokens. Large sources are dealt over leaves of about
`leaf` tokens, so no window ever holds a whole source. Each leaf is cut into blocks of about `block` tokens. Blocks
are the seats: the sources get them by highest quotients of their targets, then the nodes below a source get its
seats by highest quotients of their blocks, down a tree of `fan` children a node. A leaf with q seats and b blocks
takes q // b whole passes and a cyclic run of q % b blocks from a seeded first block; as the documents' order is
random, such a run is a random choice of blocks. Everything is arithmetic on columns.

Defined cases: null text or a text without words has size 0 and nothing is taken; a null source is a source of its
own, last in order; null and repeated doc_ids are ordinary rows (rows alike in doc_id and size may swap places);
an empty table gives an empty result. Further columns ride along packed in `row`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsight.llm.common import WORD, n_words, stored, table

WEIGHTS = (5, 2, 1)
CEILING = 3
BLOCK = 64
LEAF = 65_536
FAN = 1_024
SEED = "mix-1"


def hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], ceiling: int) -> DataFrame:
    """Adds `target` to rows of (source, source_size): the level at which weighted shares, each stopped at its
    ceiling, add up to everything. The level is the largest that any number of stopped sources gives."""
    everything = W.partitionBy(F.lit(0))
    by_source = everything.orderBy(F.col("source").asc_nulls_last())
    by_ceiling = everything.orderBy(F.col("ceiling") / F.col("weight"), F.col("rank"))
    before = F.coalesce(F.sum("ceiling").over(by_ceiling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_ceiling.rowsBetween(0, W.unboundedFollowing))
    return (
        sources.withColumn("rank", F.row_number().over(by_source) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("ceiling", F.col("source_size") * ceiling)
        .withColumn("level", (F.sum("source_size").over(everything) - before) / open_weight)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("ceiling").cast("double"), F.col("weight") * F.col("level")))
        .drop("rank", "weight", "ceiling", "level")
    )


def apportion(parties: DataFrame, group: Sequence[str], party: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Adds `seats` to rows of (votes, house, most): the `house` highest quotients votes / (2k + 1) of each group,
    at most `most` seats a party. Divisors that surely give too few and enough seats bound each party's open
    quotients, so about two a party are ranked. Ties go to the first party."""
    whole = W.partitionBy(*group)
    sure = F.floor(F.col("votes") * (F.col("house") - F.col("n") / 2 - 1) / F.col("all_votes") + 0.5)
    enough = F.floor(F.col("votes") * (F.col("house") + F.col("n") / 2 + 1) / F.col("all_votes") + 0.5)
    none = (F.col("all_votes") <= 0) | (F.col("votes") <= 0)
    bounded = (
        parties.withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("all_votes", F.sum("votes").over(whole))
        .withColumn("sure", F.when(none, 0).otherwise(F.least("most", F.greatest(F.lit(0), sure))).cast("long"))
        .withColumn("enough", F.when(none, 0).otherwise(F.least("most", enough)).cast("long"))
        .withColumn("open", F.col("house") - F.sum("sure").over(whole))
    )
    seat = F.explode_outer(F.when(F.col("enough") > F.col("sure"), F.sequence("sure", F.col("enough") - 1)))
    ranked = bounded.withColumn("seat", seat).withColumn("quotient", F.col("votes") / (2 * F.col("seat") + 1))
    order = whole.orderBy(F.col("quotient").desc_nulls_last(), *party, "seat")
    won = F.col("seat").isNotNull() & (F.row_number().over(order) <= F.col("open"))
    return (
        ranked.withColumn("won", won.cast("long"))
        .groupBy(*dict.fromkeys((*group, *party)))
        .agg(*(F.first(c).alias(c) for c in keep), (F.first("sure") + F.sum("won")).alias("seats"))
    )


def keyed(rows: DataFrame, seed: str) -> DataFrame:
    """Adds the source's key, under which null is a source too, and the document's place in the seeded order."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    return rows.withColumn("k", key).withColumn("h", F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"))))


def placed(rows: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """Adds the source's numbers and the document's leaf."""
    at = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("n_leaves"), 32)
    return keyed(rows, seed).join(sources, "k").withColumn("leaf", at)


def plan(
    rows: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    ceiling: int = CEILING,
    block: int = BLOCK,
    leaf: int = LEAF,
    fan: int = FAN,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, source, size): the sources with their targets, and the leaves with their seats."""
    counted = keyed(rows, seed).groupBy("k").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    n_leaves = F.greatest(F.lit(1), F.ceil(F.col("source_size") / leaf), F.ceil(F.col("n_rows") / leaf))
    sources = stored(
        targets(counted, weights, ceiling).select("k", "source_size", "target", n_leaves.cast("long").alias("n_leaves")),
        "mix-sources",
    )
    levels, most = 1, sources.agg(F.max("n_leaves")).first()[0] or 1
    while fan**levels < most:
        levels += 1

    leaves = placed(rows, sources, seed).groupBy("k", "leaf").agg(F.sum("size").alias("z"))
    blocks = F.when(F.col("z") > 0, F.greatest(F.lit(1), F.round(F.col("z") / block))).otherwise(0).cast("long")
    leaves = stored(leaves.withColumn("blocks", blocks), "mix-leaves")

    # Sources: their targets in blocks of their own are the votes.
    seats = leaves.groupBy("k").agg(F.sum("blocks").alias("blocks")).join(sources, "k")
    votes = F.when(F.col("source_size") > 0, F.col("blocks") * F.col("target") / F.col("source_size")).otherwise(0.0)
    seats = seats.withColumn("votes", votes).withColumn("g", F.lit(0))
    seats = seats.withColumn("house", F.round(F.sum("votes").over(W.partitionBy("g"))).cast("long"))
    seats = apportion(seats.withColumn("most", F.col("blocks") * ceiling), ["g"], ["k"], []).select("k", F.lit(0).cast("long").alias("node"), "seats")
    # Then each node's seats to its children, down to the leaves.
    for level in range(1, levels + 1):
        width = fan ** (levels - level)
        children = (
            leaves.withColumn("child", F.floor(F.col("leaf") / width))
            .groupBy("k", "child")
            .agg(F.sum("blocks").alias("votes"), F.sum("z").alias("z"))
            .withColumn("node", F.floor(F.col("child") / fan))
            .join(seats.withColumnRenamed("seats", "house"), ["k", "node"])
            .withColumn("most", F.col("votes") * ceiling)
        )
        keep = ["z", "votes"]
        seats = apportion(children, ["k", "node"], ["child"], keep).select(
            "k", F.col("child").alias("node"), "seats", "z", F.col("votes").alias("blocks")
        )
        seats = seats if level == levels else seats.select("k", "node", "seats")
    return sources, seats.withColumnRenamed("node", "leaf")


def take(rows: DataFrame, sources: DataFrame, quotas: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (doc_id, source, size, row) with source_size, target, taken; and what of each document is taken: `passes`
    whole copies and, in the last, partial pass, the words [0, wrap_end) and [cut, cut_end)."""
    line = W.partitionBy("k", "leaf").orderBy("h", "doc_id", "size")
    n, z = F.greatest(F.col("blocks"), F.lit(1)), F.col("z")
    first = F.pmod(hash32(F.concat_ws("/", F.lit(seed), F.col("k"), F.col("leaf").cast("string"))), n)
    rest, size = F.col("seats") % n, F.col("size")
    within = lambda c: F.greatest(F.lit(0), F.least(size, c - F.col("pos")))
    bound = lambda c: F.floor(c * z / n)
    taken = F.col("passes") * size + F.col("cut_end") - F.col("cut") + F.col("wrap_end")
    return (
        placed(rows, sources, seed)
        .join(quotas, ["k", "leaf"])
        .withColumn("pos", F.sum("size").over(line) - size)
        .withColumn("passes", F.floor(F.col("seats") / n))
        .withColumn("first", first)
        .withColumn("last", F.col("first") + rest)
        .withColumn("cut", within(bound(F.col("first"))))
        .withColumn("cut_end", F.greatest(F.col("cut"), within(bound(F.least(F.col("last"), n)))))
        .withColumn("wrap_end", within(bound(F.greatest(F.col("last") - n, F.lit(0)))))
        .withColumn("taken", taken)
        .select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "cut", "cut_end", "wrap_end", "row")
    )


def mix(rows: DataFrame, **settings: Any) -> DataFrame:
    """rows (doc_id, source, size, row), planned with the settings of `plan` and taken."""
    return take(rows, *plan(rows, **settings), seed=settings.get("seed", SEED))


def copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: `row` unpacked, once for each pass and once for the words of the partial pass, whose `text` (and
    `n_chars`, where there is one) hold what is taken. A document taken whole keeps its text as it is."""
    text, size = F.col("row.text"), F.col("size")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    some = F.concat(F.slice(words, F.lit(1), F.col("wrap_end")), F.slice(words, F.col("cut") + 1, F.col("cut_end") - F.col("cut")))
    n_some = F.col("wrap_end") + F.col("cut_end") - F.col("cut")
    last = F.when(n_some == 0, F.array().cast("array<string>")).when(n_some >= size, F.array(text)).otherwise(F.array(F.array_join(some, " ")))
    parts = F.concat(F.array_repeat(text, F.col("passes").cast("int")), last)
    taken = mixed.where("taken > 0").select("row", F.explode(parts).alias("piece"))
    of = {"text": F.col("piece"), "n_chars": F.length("piece").cast("long")}
    return taken.select(*(of[c].alias(c) if c in of else F.col(f"row.`{c}`").alias(c) for c in columns))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(sized(table(spark, folder, "documents", ["doc_id", "source", "text"])), "mix-sizes")
    return mix(rows.withColumn("row", F.lit(None).cast("string"))).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")
    )


#: The same with one level of leaves below the sources.
SQL = f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
    md5(CASE WHEN doc_id IS NULL THEN '{SEED}' ELSE '{SEED}/' || doc_id END) AS h
  FROM documents
), counted AS (
  SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM rows GROUP BY k
), weighted AS (
  SELECT *, {CEILING} * source_size AS ceiling,
    [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight
  FROM counted
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY ceiling / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted
), sources AS (
  SELECT k, source_size, least(ceiling::DOUBLE, weight * max(level) OVER ()) AS target,
    greatest(1, ceil(source_size / {LEAF}), ceil(n_rows / {LEAF}))::BIGINT AS n_leaves
  FROM levels
), placed AS (
  SELECT rows.*, source_size, target, (('0x' || substr(h, 1, 8))::BIGINT * n_leaves) >> 32 AS leaf FROM rows JOIN sources USING (k)
), leaves AS (
  SELECT *, CASE WHEN z > 0 THEN greatest(1, round(z / {BLOCK}))::BIGINT ELSE 0 END AS blocks
  FROM (SELECT k, leaf, sum(size)::BIGINT AS z FROM placed GROUP BY k, leaf)
), p1 AS (
  SELECT k, blocks, CASE WHEN source_size > 0 THEN blocks * target / source_size ELSE 0.0 END AS votes
  FROM (SELECT k, sum(blocks)::BIGINT AS blocks FROM leaves GROUP BY k) JOIN sources USING (k)
), p2 AS (
  SELECT *, {CEILING} * blocks AS most, round(sum(votes) OVER ())::BIGINT AS house, sum(votes) OVER () AS all_votes, count(*) OVER () AS n FROM p1
), p3 AS (
  SELECT *, CASE WHEN votes <= 0 THEN 0 ELSE least(most, greatest(0, floor(votes * (house - n / 2 - 1) / all_votes + 0.5))) END::BIGINT AS sure,
    CASE WHEN votes <= 0 THEN 0 ELSE least(most, floor(votes * (house + n / 2 + 1) / all_votes + 0.5)) END::BIGINT AS enough FROM p2
), p4 AS (
  SELECT k, row_number() OVER (ORDER BY votes / (2 * j + 1) DESC, k, j) <= house - total_sure AS won
  FROM (SELECT *, unnest(range(sure, enough)) AS j FROM (SELECT *, sum(sure) OVER () AS total_sure FROM p3))
), s1 AS (
  SELECT k, (any_value(sure) + count(*) FILTER (WHERE won))::BIGINT AS house FROM p3 LEFT JOIN p4 USING (k) GROUP BY k
), q2 AS (
  SELECT leaves.*, blocks AS votes, {CEILING} * blocks AS most, house, sum(blocks) OVER (PARTITION BY k) AS all_votes, count(*) OVER (PARTITION BY k) AS n
  FROM leaves JOIN s1 USING (k)
), q3 AS (
  SELECT *, CASE WHEN votes <= 0 THEN 0 ELSE least(most, greatest(0, floor(votes * (house - n / 2 - 1) / all_votes + 0.5))) END::BIGINT AS sure,
    CASE WHEN votes <= 0 THEN 0 ELSE least(most, floor(votes * (house + n / 2 + 1) / all_votes + 0.5)) END::BIGINT AS enough FROM q2
), q4 AS (
  SELECT k, leaf, row_number() OVER (PARTITION BY k ORDER BY votes / (2 * j + 1) DESC, leaf, j) <= house - total_sure AS won
  FROM (SELECT *, unnest(range(sure, enough)) AS j FROM (SELECT *, sum(sure) OVER (PARTITION BY k) AS total_sure FROM q3))
), s2 AS (
  SELECT k, leaf, any_value(z) AS z, greatest(1, any_value(blocks)) AS b, (any_value(sure) + count(*) FILTER (WHERE won))::BIGINT AS seats
  FROM q3 LEFT JOIN q4 USING (k, leaf) GROUP BY k, leaf
), s3 AS (
  SELECT *, seats // b AS passes, ('0x' || substr(md5('{SEED}/' || k || '/' || leaf), 1, 8))::BIGINT % b AS f FROM s2
), line AS (
  SELECT placed.*, z, passes, (f * z) // b AS c0, (least(f + seats % b, b) * z) // b AS c1, (greatest(f + seats % b - b, 0) * z) // b AS c2,
    sum(size) OVER (PARTITION BY k, leaf ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS pos
  FROM placed JOIN s3 USING (k, leaf)
)
SELECT doc_id, size, source_size, target, (passes * size
  + greatest(0, greatest(0, least(size, c1 - pos)) - greatest(0, least(size, c0 - pos))) + greatest(0, least(size, c2 - pos)))::BIGINT AS taken
FROM line
"""
