"""Type inference for text columns: integer, then decimal, then boolean, else text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colsight.functions.columns import chunks, col

# The texts a CSV reader takes for booleans and for infinity.
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")
INFINITE_TEXTS = ("inf", "-inf", "+inf", "Inf", "-Inf", "+Inf", "infinity", "-infinity", "Infinity", "-Infinity")

INTEGER_PATTERN = r"^\s*[+-]?[0-9]{1,19}\s*$"
DECIMAL_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

INTEGER, DECIMAL, BOOLEAN, TEXT = 1, 2, 4, 8


def type_code(value: Column) -> Column:
    """The narrowest type of one text; NULL for a missing one."""
    whole = value.rlike(INTEGER_PATTERN) & value.try_cast("long").isNotNull()
    number = value.rlike(DECIMAL_PATTERN) | value.isin(list(INFINITE_TEXTS))
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(whole, INTEGER)
        .when(number, DECIMAL)
        .when(value.isin(list(BOOLEAN_TEXTS)), BOOLEAN)
        .otherwise(TEXT)
    )


def code_type(codes: int | None) -> T.DataType:
    """The type that holds all values whose codes were or-ed together."""
    if codes is None:
        return T.DoubleType()
    if codes == INTEGER:
        return T.LongType()
    if codes in (DECIMAL, INTEGER | DECIMAL):
        return T.DoubleType()
    return T.BooleanType() if codes == BOOLEAN else T.StringType()


def cast_text(value: Column, dtype: T.DataType) -> Column:
    """Cast a text column whose values were all checked to fit."""
    if isinstance(dtype, T.DoubleType):
        infinite = F.when(F.startswith(value, F.lit("-")), F.lit("-Infinity")).otherwise(F.lit("Infinity"))
        return F.when(value.isin(list(INFINITE_TEXTS)), infinite).otherwise(F.trim(value)).try_cast("double")
    if isinstance(dtype, T.LongType):
        return F.trim(value).try_cast("long")
    return value.try_cast(dtype)


def infer_types(df: DataFrame) -> DataFrame:
    """(position, name, dtype) of the types that text columns could take, from one aggregate per chunk."""
    labels = {
        None: "double", INTEGER: "bigint", DECIMAL: "double", INTEGER | DECIMAL: "double", BOOLEAN: "boolean",
    }
    frames = None
    for part in chunks(list(enumerate(df.columns))):
        codes = df.agg(*[F.bit_or(type_code(col(c))).alias(f"t{i}") for i, c in part])
        cells = []
        for i, c in part:
            dtype = F.when(F.col(f"t{i}").isNull(), labels[None])
            for code, label in labels.items():
                if code is not None:
                    dtype = dtype.when(F.col(f"t{i}") == code, label)
            cells.append(
                F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), dtype.otherwise("string").alias("dtype"))
            )
        frame = codes.select(F.inline(F.array(*cells)))
        frames = frame if frames is None else frames.unionByName(frame)
    return frames


def apply_types(df: DataFrame, types: Sequence[T.DataType]) -> DataFrame:
    return df.select(*[cast_text(col(c), t).alias(c) for c, t in zip(df.columns, types)])
