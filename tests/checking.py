"""Compare a registered query with its SQL check in an in-process database."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def compare(df, con, sql: str) -> str | None:
    """None if rows, column names, types and values agree, otherwise what differs."""
    names = sorted(df.columns)
    mine = df.select(*names).toArrow()
    theirs = con.execute(sql).to_arrow_table()
    if sorted(theirs.column_names) != names:
        return f"columns {names} / {sorted(theirs.column_names)}"
    theirs = theirs.select(names)
    kinds = [str(f.type).replace("large_", "").replace("[us, tz=UTC]", "[us]") for f in mine.schema]
    other = [str(f.type).replace("large_", "") for f in theirs.schema]
    if kinds != other:
        return f"types {[(n, a, b) for n, a, b in zip(names, kinds, other) if a != b]}"
    if mine.num_rows != theirs.num_rows:
        return f"rows {mine.num_rows} / {theirs.num_rows}"
    left = sorted(tuple(_plain(v) for v in row.values()) for row in mine.to_pylist())
    right = sorted(tuple(_plain(v) for v in row.values()) for row in theirs.to_pylist())
    for a, b in zip(left, right):
        if a != b:
            return f"values {dict(zip(names, a))} / {dict(zip(names, b))}"
    return None


def table(spark, rows, schema):
    """A frame whose 'ntz' columns are given as text."""
    fields = [f.strip().split() for f in schema.split(",")]
    raw = ", ".join(f"{name} {'string' if kind == 'ntz' else kind}" for name, kind in fields)
    df = spark.createDataFrame(rows, raw)
    return df.selectExpr(
        *[f"CAST({name} AS TIMESTAMP_NTZ) AS {name}" if kind == "ntz" else name for name, kind in fields]
    )
