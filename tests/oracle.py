"""Compare registered queries with their SQL on DuckDB."""

import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        if (pathlib.Path(folder) / f"{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(normal(row[k]) for k in order) for row in rows), key=repr)


def differences(frame, connection, sql):
    """Empty when names, types, and rows agree."""
    found = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]).upper() for d in result.description}
    expected = rows_of(names, result.fetchall())
    problems = []
    if sorted(names) != sorted(frame.columns):
        problems.append(f"columns {sorted(frame.columns)} != {sorted(names)}")
    same = {
        "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
        "timestamp_ntz": {"TIMESTAMP"},
    }
    for name, kind in frame.dtypes:
        if kind in same and kinds.get(name) not in same[kind]:
            problems.append(f"{name}: {kind} != {kinds.get(name)}")
    if found != expected:
        wrong = [(a, b) for a, b in zip(found, expected) if a != b][:3]
        problems.append(f"{len(found)} rows, expected {len(expected)}; first differences {wrong}")
    return problems
