"""Frames written to the folder that all executors share, so that a shuffle they need runs once and outlives executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    folder = f"file://{tempfile.mkdtemp(prefix='colsight-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(frame: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """The frame, written once and read back, and what deletes it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/colsight-{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    try:
        (frame.write.partitionBy(partition_by) if partition_by else frame.write).parquet(path)
    except BaseException:
        delete()
        raise
    return spark.read.schema(frame.schema).parquet(path), delete


@contextmanager
def kept(frame: DataFrame, name: str, partition_by: str | None = None) -> Iterator[DataFrame]:
    """The frame, stored until the end of the block, which must not hand it on."""
    rows, delete = stored(frame, name, partition_by)
    try:
        yield rows
    finally:
        delete()
