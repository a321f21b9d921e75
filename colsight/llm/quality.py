"""Quality rules whose cutoffs come with a guarantee on the good documents they reject.

Five statistics of each text give six rules (word length both ways, symbols, repeated lines, repeated word windows,
few words), each with a fixed row of cutoffs from lenient to strict. On labelled good documents that pass the base
filter, each stratum (language) tests each rule's cutoffs in that order: the cutoff holds if so few rejections among n
would be seen with at most the level's chance were the true share above the rule's part of RISK (exact binomial
tail). The first that fails ends the row, so a row needs no correction of its own; over rules and strata the level
LEVEL is divided evenly (Bonferroni). With chance 1 - LEVEL no stratum loses more than RISK of its good documents to
the rules. Too few labels, no cutoff: the rule then never rejects.

Everything is DataFrame functions. Windows of three words are compared within a text by their 64-bit hashes, sorted.

Defined cases: a null text has no words; a null language is a stratum of its own, and so is one without labels (no
cutoffs); a document with several labels is good if all say so, null labels say nothing; each row of documents is
judged by itself; empty tables give empty results or no cutoffs. Columns besides the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.common import WORD, stored, table

RISK, LEVEL = 0.02, 0.05
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"

#: Rules: name, what is measured (rejected above the cutoff), and the cutoffs from lenient to strict.
RULES = (
    ("long_words", "word_chars / n_words", (60.0, 40.0, 30.0, 24.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    ("short_words", "-word_chars / n_words", (-1.2, -1.5, -2.0, -2.5, -2.8, -3.0, -3.2, -3.4, -3.6, -3.8, -4.0, -4.3, -4.6)),
    ("symbols", "n_symbols / n_words", (5.0, 3.0, 2.0, 1.4, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    ("dup_lines", "n_dup_lines / n_words", (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.005)),
    ("repeats", "n_repeat_words / n_words", (0.49, 0.47, 0.45, 0.42, 0.4, 0.37, 0.35, 0.32, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("few_words", "-1.0 * n_words", (-51.0, -52.0, -54.0, -56.0, -60.0, -65.0, -70.0, -80.0, -90.0, -100.0, -120.0, -150.0, -200.0)),
)


def statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """docs with a text: the columns to keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(F.struct(*keep).alias("row"), text.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda line: line.rlike(WORD))
    split = kept.select(
        "row",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        lines.alias("lines"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    hashed = split.select(
        "row",
        F.size("w").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("w") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    some = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    placed_kind = "array<struct<h:bigint,i:int>>"
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    sorted_ = hashed.select("row", *numbers, F.when(some, placed).otherwise(F.array().cast(placed_kind)).alias("p"))
    same = lambda x, o: F.coalesce(x["h"] == o["h"], F.lit(False))
    again = F.filter("p", lambda x, k: F.when(k > 0, same(x, F.get("p", k - 1))).otherwise(False) | same(x, F.get("p", k + 1)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, at: F.struct(at.alias("last"), (a["n"] + F.least(F.lit(3), at - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return sorted_.select("row.*", *(F.col(c).cast("long").alias(c) for c in numbers), covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def tail(n: Column, rejected: Column, share: float) -> Column:
    """The chance of at most `rejected` of n at a true share: a sum of exact binomial terms, in logarithms."""
    odds = F.log(F.lit(share / (1 - share)))
    start = F.struct((n * F.log(F.lit(1 - share))).alias("term"), F.lit(0.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        return F.struct((a["term"] + F.log((n - i) / (i + 1)) + odds).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))

    # Above the mean the tail is over a half: no need to add it up.
    return F.when(rejected > n * share, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), rejected), start, step, lambda a: a["sum"]))


def cutoffs(good: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum and the strictest cutoff of each rule that holds (null if none), from good documents' statistics with
    a `stratum`."""
    counted = [
        F.coalesce(F.sum((F.expr(what) > c).cast("long")), F.lit(0)).alias(f"{name}_{k}")
        for name, what, row in RULES
        for k, c in enumerate(row)
    ]
    strata = stored(good.where(~base_failed()).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counted), "quality-strata")
    share, chance = risk / len(RULES), level / (len(RULES) * max(1, strata.count()))  # a row a language
    columns = []
    for name, _, row in RULES:
        holds, chosen = F.lit(True), F.lit(None).cast("double")
        for k, c in enumerate(row):
            holds = holds & F.col(f"{name}_{k}_holds")
            chosen = F.when(holds, c).otherwise(chosen)
        columns.append(chosen.alias(name))
    tested = strata.select(
        "stratum",
        *((tail(F.col("n"), F.col(f"{name}_{k}"), share) <= chance).alias(f"{name}_{k}_holds") for name, _, row in RULES for k in range(len(row))),
    )
    return stored(stored(tested, "quality-tests").select("stratum", *columns), "quality-cutoffs")


def judge(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stats (with doc_id and lang) with base_failed and kept; labels (doc_id, quality)."""
    stats = stats.withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")))
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least")).where("least >= 1").select("doc_id")
    chosen = cutoffs(stats.join(good, "doc_id", "left_semi"), risk, level)
    rejected = F.lit(False)
    for name, what, _ in RULES:
        rejected = rejected | F.coalesce(F.expr(what) > F.col(name), F.lit(False))
    failed = base_failed()
    return stats.join(chosen, "stratum", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected)


def op4_risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "lang", "text"])
    stats = stored(statistics(docs, ("doc_id", "lang")), "quality-stats")
    return judge(stats, table(spark, folder, "labels", ["doc_id", "quality"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_GRID = ", ".join(f"('{name}', {k}, {c}::DOUBLE)" for name, _, row in RULES for k, c in enumerate(row))
_MEASURED = " UNION ALL ".join(f"SELECT r, '{name}' AS rule, ({what})::DOUBLE AS x FROM stats WHERE n_words > 0" for name, what, _ in RULES)
_SHARE = RISK / len(RULES)
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN 'null' ELSE '=' || lang END AS stratum,
    coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY r
), stats AS (
  SELECT d.r, doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)
), based AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM stats
), good AS (
  SELECT * FROM based WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) >= 1)
), grid(rule, k, c) AS (VALUES {_GRID}),
measured AS ({_MEASURED}),
strata AS (SELECT stratum, count(*) AS n FROM good GROUP BY stratum),
counted AS (
  SELECT good.stratum, grid.rule, k, c, count(*) FILTER (WHERE x > c) AS rejected FROM good JOIN measured USING (r) JOIN grid USING (rule) GROUP BY ALL
), tested AS (
  SELECT counted.*, n, CASE WHEN rejected > n * {_SHARE} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))) FROM (SELECT unnest(range(0, rejected + 1)) AS i)
  ) END AS p FROM counted JOIN strata USING (stratum)
), chosen AS (
  SELECT stratum, rule, c FROM (
    SELECT *, max(CASE WHEN p > {LEVEL} / ({len(RULES)} * (SELECT count(*) FROM strata)) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY k) AS over FROM tested
  ) WHERE over = 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY k DESC) = 1
), rejected AS (SELECT DISTINCT r FROM based JOIN measured USING (r) JOIN chosen USING (stratum, rule) WHERE x > c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept FROM based
"""
