"""Documents to token files in five stages; each takes (spark, docs, sf_dir) and its result is stored for the next.

The language stage drops documents without a language, near-duplicate detection keeps one document of each class,
decontamination drops documents that hold a window of a benchmark item, mixing repeats or cuts documents until each
source has its share, and the last stage writes the token files and returns what they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm import mixing, neardup, phrases, ppm, tokens
from colsight.llm.common import scratch, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ppm.fit(docs.where(ppm.fold(F.col("doc_id")) != ppm.HELD_OUT))
    return ppm.predict(docs, model, docs.columns).where(F.col("lang_pred") != ppm.UNKNOWN).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrases.clean(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sources, quotas = mixing.plan(stored(mixing.sized(docs), "mix-sizes"))
    rows = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    return mixing.copies(mixing.take(rows, sources, quotas), docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokens.write_tokens(docs, path)
    return tokens.checksums(tokens.read_tokens(spark, path))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: Byte context trees, consistent sampling and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
