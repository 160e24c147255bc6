"""CSV scans of activity logs and directory snapshots, with lenient typing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrace.sources.records import csv_records

# Fixed: header columns of the raw files.
LOG_COLUMNS = {
    "logon": ["id", "date", "user", "pc", "activity"],
    "device": ["id", "date", "user", "pc", "activity"],
    "http": ["id", "date", "user", "pc", "url", "content"],
    "email": ["id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content"],
    "file": ["id", "date", "user", "pc", "filename", "content"],
    "psychometric": ["employee_name", "user_id", "O", "C", "E", "A", "N"],
}
DIRECTORY_COLUMNS = [
    "employee_name",
    "user_id",
    "email",
    "role",
    "business_unit",
    "functional_unit",
    "department",
    "team",
    "supervisor",
]
# Fixed: accepted time formats, tried in this order.
TIME_FORMATS = (
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
)
TIME_COLUMNS = {t: ["date"] for t in ("logon", "device", "http", "email", "file")}
INT_COLUMNS = {"email": ["size", "attachments"], "psychometric": ["O", "C", "E", "A", "N"]}
# Raw header name -> column name the operators expect.
OPERATOR_NAMES = {"user": "user_id", "to": "to_addr", "cc": "cc_addr", "bcc": "bcc_addr", "from": "from_addr"}


def read_csv(spark: SparkSession, path: str | list[str], *, multi_line: bool = True) -> DataFrame:
    """CSV as text columns, named by the header line.

    Quoted fields may hold line breaks; many tasks read one file all the same (see
    ``records``). Where no field has a break Spark's own reader does the work, as it does
    with ``multi_line=False``, which also spares the look. All files must have the same
    header. Blank lines are no records.
    """
    reader = spark.read.options(header=True, escape='"', enforceSchema=False)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    records = csv_records(spark, path) if multi_line else None
    if records is None:
        return reader.schema(schema).csv(path)
    parsed = F.from_csv("value", ", ".join(f"`{n}` STRING" for n in names), {"escape": '"'})
    odd = records.where("kind = 'header'").select("file", parsed.alias("r")).where(F.array(*[F.col(f"r.`{n}`") for n in names]) != F.array(*map(F.lit, names)))
    for row in odd.limit(1).collect():
        raise ValueError(f"another header than {names}: {row['file']}")
    rows = records.where("kind <> 'header'").select(parsed.alias("r"))
    return rows.select(*[F.col(f"r.`{n}`").alias(n) for n in names])


def scan_log(spark: SparkSession, path: str | list[str], table: str, *, multi_line: bool = True) -> DataFrame:
    """One raw log as text."""
    if table not in LOG_COLUMNS:
        raise ValueError(f"unknown log {table!r}; known: {sorted(LOG_COLUMNS)}")
    return read_csv(spark, path, multi_line=multi_line)


def lenient_time(column: str, formats: Sequence[str] = TIME_FORMATS) -> str:
    """Timestamp without zone from text in ISO form or one of ``formats``; NULL if none fits."""
    tried = [f"CAST(try_to_timestamp({column}, '{f}') AS TIMESTAMP_NTZ)" for f in formats]
    return f"coalesce(try_cast({column} AS TIMESTAMP_NTZ), {', '.join(tried)})"


def lenient_int(column: str) -> str:
    """BIGINT from text, cut toward zero; 0 if it is no number."""
    number = f"try_cast(trim({column}) AS DOUBLE)"
    return f"""coalesce(try_cast(trim({column}) AS BIGINT),
        CASE WHEN isnan({number}) THEN 0L ELSE try_cast({number} AS BIGINT) END, 0L)"""


def coerce_types(
    df: DataFrame,
    timestamps: Sequence[str] = (),
    ints: Sequence[str] = (),
    formats: Sequence[str] = TIME_FORMATS,
) -> DataFrame:
    out = []
    for c in df.columns:
        name = f"`{c}`"
        if c in timestamps:
            out.append(f"{lenient_time(name, formats)} AS {name}")
        elif c in ints:
            out.append(f"{lenient_int(name)} AS {name}")
        else:
            out.append(name)
    return df.selectExpr(*out)


def typed_log(df: DataFrame, table: str) -> DataFrame:
    """Raw text log with its types and the column names the operators use."""
    typed = coerce_types(df, TIME_COLUMNS.get(table, ()), INT_COLUMNS.get(table, ()))
    if table == "psychometric":
        return typed.withColumnsRenamed({c: c.lower() for c in INT_COLUMNS[table]})
    return typed.withColumnsRenamed(OPERATOR_NAMES)


def scan_snapshots(spark: SparkSession, path: str, pattern: str = r"(\d{4}-\d{2})\.csv") -> DataFrame:
    """All snapshot files ``<period>.csv`` of a folder with the period in each file's name.

    Columns are matched by name: files are grouped by their header line (one per period), and
    a column that a file lacks is NULL.
    """
    files = spark.read.text(f"{path}/*.csv").inputFiles()
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(files):
        header = spark.read.options(header=True, escape='"').csv(file).columns
        by_header.setdefault(tuple(header), []).append(file)
    parts = [_snapshot_rows(spark, group, pattern) for group in by_header.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _snapshot_rows(spark: SparkSession, files: list[str], pattern: str) -> DataFrame:
    rows = spark.read.options(header=True, escape='"', multiLine=True, enforceSchema=False)
    names = rows.csv(files).columns
    rows = rows.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(files)
    period = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    first_day = "if(length(ldap_month) = 7, concat(ldap_month, '-01'), ldap_month)"
    return rows.select("*", period.alias("ldap_month")).selectExpr(
        "*", f"try_cast({first_day} AS TIMESTAMP_NTZ) AS ldap_date"
    )
