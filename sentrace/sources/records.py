"""CSV records of large files that many tasks read, also where quoted fields hold line breaks.

Spark reads the lines of any part of a file. Whether a line begins inside a quoted field depends on
all lines before it, but only through one bit, so each line is a function of that bit:

1. Every line that is not neutral tells where it ends for both cases; a part of a file chains its
   lines to one such function, and the functions of all parts of a file are chained in order.
2. With the bit at its start known, each part joins its lines to records. What is open at the end of
   a part, and what closes it in later parts, is joined in a last step: one record for each border.

Files without breaks in fields (the first step tells) are left to Spark's own CSV reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrace.storage import materialise

#: So many parts that begin inside a field are broadcast (about 10 MB); more travel as rows of their part.
MAX_SHARED_PARTS = 100_000
_PIN = "spark.sql.files.minPartitionNum"
# A line as a function: states are 0 outside, 1 outside at the start of a field, 2 inside a quoted
# field, 3 behind its closing quote (another quote there is an escaped one).
_STEP = """(a, x) -> CASE a WHEN 2 THEN if(x = '', 3, if(endswith(x, ','), 1, 0))
    WHEN 0 THEN if(endswith(x, ','), 1, 0) ELSE 2 END"""


@contextmanager
def pinned_parts(spark: SparkSession) -> Iterator[None]:
    """Files are cut into the same parts by every scan inside, even if executors come or go."""
    before = spark.conf.get(_PIN, None)
    if before is None:
        spark.conf.set(_PIN, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PIN)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, part, value, open, stays): does the line end inside a field if it begins outside, or inside, one?"""
    lines = spark.read.option("lineSep", "\n").text(path)
    pieces = "split(value, '\"', -1)"
    ends = lambda start: f"aggregate(slice({pieces}, 2, size({pieces})), {start}, {_STEP}) = 2"
    begin = f"if(element_at({pieces}, 1) = '' OR endswith(element_at({pieces}, 1), ','), 1, 0)"
    quoted = "contains(value, '\"')"
    return lines.selectExpr(
        "_metadata.file_path AS file",
        "_metadata.file_block_start AS part",
        "value",
        f"CASE WHEN {quoted} THEN {ends(begin)} ELSE false END AS open",
        f"CASE WHEN {quoted} THEN {ends('2')} ELSE true END AS stays",
    )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of each part: its end for both starts, and whether it leaves the field it begins in."""
    key, now = None, (False, True, False)
    out = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for file, part, opens, stays in zip(*columns):
            if (file, part) != key:
                if key is not None:
                    out.append((*key, *now))
                key, now = (file, part), (False, True, False)
            ends = [stays if state else opens for state in now[:2]]
            now = (ends[0], ends[1], now[2] or not ends[1])
    if key is not None:
        out.append((*key, *now))
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    columns = list(zip(*out)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "part", "end0", "end1", "leaves"])


def _inside(table: pa.Table) -> pa.Table:
    """Of the parts of one file those that begin inside a field, with the part in which that field's record begins."""
    rows: dict[int, tuple] = {}
    for row in table.to_pylist():  # a part is listed, and tells its function if that is not neutral
        if row["end0"] is not None or row["part"] not in rows:
            rows[row["part"]] = (row["end0"] or False, True if row["end1"] is None else row["end1"], row["leaves"] or False)
    found, state, chain = [], False, None
    for part in sorted(rows):
        end0, end1, leaves = rows[part]
        if state:
            found.append((part, chain))
        ends = end1 if state else end0
        if ends and (not state or leaves):
            chain = part
        state = ends
    file = table.column("file")[0].as_py()
    columns = [pa.array([file] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())]
    return pa.table(columns, ["file", "part", "chain"])


def _joined(shared):
    """Records of each part, and the pieces of records that cross its borders (``chain`` tells which belong together).

    Lines of a part come one after the other. The part in which the record at its start began
    is looked up in ``shared``, or comes as the part's first row.
    """
    names = ["file", "part", "kind", "chain", "value"]

    def rows(file: str, part: int, kinds: list[str], chain: int | None, values: pa.Array) -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array([file] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.array(kinds, pa.string()), pa.array([chain] * n, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, values.cast(pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, chain, held, first = None, False, None, [], True
        for batch in batches:
            files, parts = batch.column(0), batch.column(1).to_numpy()
            codes = pc.dictionary_encode(files).indices.to_numpy()
            cuts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (parts[1:] != parts[:-1]))) if len(parts) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(parts))):
                file, part = files[int(a)].as_py(), int(parts[a])
                lines = batch.slice(int(a), int(b - a))
                if (file, part) != key:
                    yield from close(key, inside, chain, held)
                    key, held, first = (file, part), [], part == 0
                    chain = shared.value.get(key) if shared is not None else lines.column(5)[0].as_py()
                    inside = chain is not None
                if shared is None:  # rows that tell the chain hold no line
                    lines = lines.filter(pc.is_valid(lines.column(2)))
                if not lines.num_rows:
                    continue
                opens, stays = lines.column(3).to_numpy(zero_copy_only=False), lines.column(4).to_numpy(zero_copy_only=False)
                ends = np.empty(lines.num_rows, bool)
                at, state = 0, inside
                for i in np.flatnonzero(opens | ~stays).tolist():  # other lines change nothing
                    ends[at:i] = state
                    state = bool(stays[i] if state else opens[i])
                    ends[i], at = state, i + 1
                ends[at:] = state
                values = lines.column(2)
                done = np.flatnonzero(~ends)
                if held and len(done):
                    whole = pa.array(["\n".join([*held, *values.slice(0, int(done[0]) + 1).to_pylist()])], pa.string())
                    held, rest = [], int(done[0]) + 1
                    if chain is not None:
                        yield rows(file, part, ["piece"], chain, whole)
                        chain = None
                    else:
                        yield rows(file, part, ["header" if first else "record"], None, whole)
                    first = False
                elif chain is not None and len(done):
                    rest = int(done[0]) + 1
                    yield rows(file, part, ["piece"], chain, pa.array(["\n".join(values.slice(0, rest).to_pylist())], pa.string()))
                    chain, first = None, False
                else:
                    rest = 0
                done = done[done >= rest]
                if len(done):
                    bounds = pa.array(np.append(rest, done + 1), pa.int32())
                    whole = pc.binary_join(pa.ListArray.from_arrays(bounds, values), "\n")
                    yield rows(file, part, ["header" if first and i == 0 else "record" for i in range(len(whole))], None, whole)
                    rest, first = int(done[-1]) + 1, False
                held += values.slice(rest).to_pylist()
                inside = state
        yield from close(key, inside, chain, held)

    def close(key, inside: bool, chain: int | None, held: list[str]) -> Iterator[pa.RecordBatch]:
        """What stays open at the end of a part."""
        if held:
            yield rows(*key, ["piece"], chain if chain is not None else key[1], pa.array(["\n".join(held)], pa.string()))

    return run


def csv_records(spark: SparkSession, path: str | list[str], *, max_shared: int = MAX_SHARED_PARTS) -> DataFrame | None:
    """(file, kind, value): the records of all files, one of each file a ``header``; None if no record has a line break.

    Lines end with a line feed; a carriage return before it is cut from the end of a record. Quotes
    are escaped by doubling, and a quote inside a field that is not quoted is a character like
    others. A field that is never closed takes the rest of its file.
    """
    with pinned_parts(spark):
        lines = _lines(spark, path)
        inner = "instr(substring(value, 1, length(value) - 1), '\r') > 0"
        if lines.where(f"open OR {inner}").isEmpty():
            return None
        odd = lines.where("open OR NOT stays").select("file", "part", "open", "stays")
        told = materialise(odd.mapInArrow(_chained, "file string, part long, end0 boolean, end1 boolean, leaves boolean"), "parts")
        listed = lines.select("file", "part").distinct().selectExpr("*", "CAST(NULL AS BOOLEAN) AS end0", "CAST(NULL AS BOOLEAN) AS end1", "CAST(NULL AS BOOLEAN) AS leaves")
        starts = materialise(listed.unionByName(told).groupBy("file").applyInArrow(_inside, "file string, part long, chain long"), "inside")
        schema = "file string, part long, kind string, chain long, value string"
        if starts.count() <= max_shared:
            known = {(r["file"], r["part"]): r["chain"] for r in starts.collect()}
            found = lines.mapInArrow(_joined(spark.sparkContext.broadcast(known)), schema)
        else:
            carry = starts.selectExpr("file", "part", "CAST(NULL AS STRING) AS value", "false AS open", "true AS stays", "chain", "-1L AS nr")
            rows = lines.selectExpr("*", "CAST(NULL AS BIGINT) AS chain", "monotonically_increasing_id() AS nr").unionByName(carry)
            rows = rows.repartition("file", "part").sortWithinPartitions("file", "part", "nr").drop("nr")
            found = rows.mapInArrow(_joined(None), schema)
        found = materialise(found, "records")
    pieces = found.where("kind = 'piece'").groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("part", "value"))).alias("p"))
    crossing = pieces.select("file", F.lit("record").alias("kind"), F.array_join("p.value", "\n").alias("value"))
    out = found.where("kind <> 'piece'").select("file", "kind", "value").unionByName(crossing)
    return out.withColumn("value", F.regexp_replace("value", "\r$", "")).where("trim(value) <> ''")
