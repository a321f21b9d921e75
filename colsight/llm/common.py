"""What the operators share: input columns, scratch tables in the shared folder, and the word pattern."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a stored table; whatever else it holds is not read."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    folder = f"file://{tempfile.mkdtemp(prefix='colsight-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/colsight-{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(frame.sparkSession, name)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
