"""Small driver-side results as frames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A frame of a few literal rows, known in full to the optimizer."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if any(isinstance(f.dataType, T.TimestampType) for f in schema.fields):
        return spark.createDataFrame([tuple(r) for r in rows], schema)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([row[k] for row in rows], type=arrow.field(k).type) for k in range(len(arrow))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
