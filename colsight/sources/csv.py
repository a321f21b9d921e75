"""CSV ingest: header cleaning, NA tokens, type inference and ragged rows in one checked scan."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from colsight.errors import DatasetError
from colsight.functions.columns import col
from colsight.functions.missing import NA_TOKENS
from colsight.sources.checks import require_columns, require_rows
from colsight.sources.inference import TEXT, apply_types, code_type, type_code

EXTRA = "__field_beyond_header"


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    na_tokens: Iterable[str] = NA_TOKENS,
    max_rows: int | None = None,
    max_columns: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read comma-separated files with a header row into typed columns.

    Every file must have the same header. Rows longer than it are an error, shorter ones are filled with NULL. Integers, decimals
    and True/False are recognised, everything else (dates too) stays text. One scan decides the types
    and checks the rows; the returned frame scans again with those types.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("escape", '"').option("multiLine", multi_line)
    header = _header_cells(reader, sorted(spark.read.text(paths).inputFiles()))
    names = clean_header(header)
    require_columns(len(names), max_columns)
    tokens, schema = list(na_tokens), _text_schema(len(names))

    # The checking scan reads header lines as rows: the first line of each file must be the header.
    lines = reader.option("header", False).schema(schema).csv(paths)
    start = F.col("_metadata.file_block_start")
    lines = lines.select(
        *lines.columns,
        F.col("_metadata.file_path").alias("path"),
        F.when(start == 0, F.monotonically_increasing_id()).otherwise(F.lit(2**63 - 1)).alias("place"),
    )
    first = F.regexp_replace("c0", "^\ufeff", "")
    cells = [(first if i == 0 else F.col(f"c{i}")).eqNullSafe(F.lit(cell)) for i, cell in enumerate(header)]
    is_header = reduce(lambda x, y: x & y, cells, F.col(EXTRA).isNull())
    files = _counted(
        lines.select("*", is_header.alias("is_header")),
        tokens,
        len(names),
        ~F.col("is_header"),
        F.count_if("is_header").alias("headers"),
        F.min(F.struct("place", "is_header"))["is_header"].alias("fits"),
        by="path",
    )
    found = files.agg(
        *[F.sum(c).alias(c) for c in ("rows", "long_rows", "headers")],
        *[F.bit_or(f"t{i}").alias(f"t{i}") for i in range(len(names))],
        F.count("*").alias("files"),
        F.min(F.when(~F.col("fits"), F.col("path"))).alias("other"),
    ).first()
    if found["other"] is not None:
        raise DatasetError(f"The header of '{found['other']}' is not that of the first file.")
    rows = found["rows"] + found["headers"] - found["files"]
    codes = [found[f"t{i}"] for i in range(len(names))]
    if found["headers"] > found["files"]:
        # A row that repeats the header is data like any other.
        codes = [TEXT | (code or 0) if cell else code for code, cell in zip(codes, header)]
    _check(rows, found["long_rows"], len(names), max_rows)
    raw = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(paths)
    return apply_types(_texts(raw, tokens, len(names)), [code_type(c) for c in codes]).toDF(*names)


def read_csv_lines(
    lines: DataFrame, header: str, na_tokens: Iterable[str] = NA_TOKENS, max_rows: int | None = None, max_columns: int | None = None
) -> DataFrame:
    """As :func:`read_csv`, for a frame with one text column of data lines and a header line apart."""
    names = clean_header([cell or None for cell in next(csv.reader([header]), [])])
    if not names:
        raise DatasetError("The CSV input is empty.")
    require_columns(len(names), max_columns)
    tokens, raw = list(na_tokens), _parsed(lines, len(names))
    found = _counted(raw, tokens, len(names), F.lit(True)).first()
    _check(found["rows"], found["long_rows"], len(names), max_rows)
    return apply_types(_texts(raw, tokens, len(names)), [code_type(found[f"t{i}"]) for i in range(len(names))]).toDF(*names)


def long_lines(lines: DataFrame, width: int) -> DataFrame:
    """One row: the data lines, and those with more fields than the header."""
    return _parsed(lines, width).agg(F.count("*").alias("rows"), F.count(EXTRA).alias("long_rows"))


def _text_schema(width: int) -> T.StructType:
    # Fields beyond the header land in a last column of their own, which must stay empty.
    return T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(width)), T.StructField(EXTRA, T.StringType())])


def _parsed(lines: DataFrame, width: int) -> DataFrame:
    text = col(lines.columns[0])
    options = {"escape": '"', "mode": "PERMISSIVE"}
    schema = ", ".join(f"{name} string" for name in _text_schema(width).names)
    return lines.where(F.trim(text) != "").select(F.from_csv(text, schema, options).alias("r")).select("r.*")


def _texts(raw: DataFrame, tokens: Sequence[str], width: int) -> DataFrame:
    return raw.select(*[F.when(~F.col(f"c{i}").isin(tokens), F.col(f"c{i}")).alias(f"c{i}") for i in range(width)])


def _counted(raw: DataFrame, tokens: Sequence[str], width: int, counts: Column, *more: Column, by: str | None = None) -> DataFrame:
    """Rows, rows beyond the header, and the type codes of each column over the rows that count."""
    known = [F.when(counts & ~F.col(f"c{i}").isin(tokens), F.col(f"c{i}")) for i in range(width)]
    return raw.groupBy(*([by] if by else [])).agg(
        F.count_if(counts).alias("rows"),
        F.count_if(counts & F.col(EXTRA).isNotNull()).alias("long_rows"),
        *[F.bit_or(type_code(x)).alias(f"t{i}") for i, x in enumerate(known)],
        *more,
    )


def _check(rows: int, long_rows: int, width: int, max_rows: int | None) -> None:
    if rows <= 0:
        raise DatasetError("There is a header but not one row of data.")
    if long_rows:
        raise DatasetError(f"{long_rows} rows hold more fields than the header has ({width}).")
    require_rows(rows, max_rows)


def clean_header(cells: Sequence[str | None]) -> list[str]:
    """Number repeated names, fill in empty ones, and trim; names that only then collide are an error."""
    seen: dict[str, int] = {}
    names: list[str] = []
    for i, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {i}"
        count = seen.get(name, 0)
        while count and f"{name}.{count}" in seen:
            count += 1
        seen[name] = count + 1
        if count:
            name = f"{name}.{count}"
            seen[name] = 1
        names.append(name.strip())
    for name in names:
        if names.count(name) > 1:
            raise DatasetError(f"Column name '{name}' appears more than once after trimming spaces.")
    return names


def _header_cells(reader: DataFrameReader, files: list[str]) -> list[str | None]:
    """The first line of the first file, by name, that has one."""
    first = next((rows for file in files if (rows := reader.option("header", False).csv(file).head(1))), None)
    if not first:
        raise DatasetError("The CSV input is empty.")
    cells = list(first[0])
    if cells[0] is not None:
        cells[0] = cells[0].removeprefix("\ufeff")
    return cells
