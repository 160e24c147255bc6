"""Ordered computations that stay distributed when one key holds most rows.

A plain window puts a whole key (or, without PARTITION BY, the whole table) into one
task. The helpers here cut every key into slices along the order, compute inside the
slices, and pass between slices only one summary row per slice. Summary rows travel as
extra rows of the slice ("carry" rows), so no join back to the data is needed and
NULL keys behave as in a plain window. Slices are pure functions of the row, so a
recomputed task gives the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.functions.columns import struct_of, time_bucket
from sentrace.storage import materialise

#: Rows of a key that a time slice may hold before it is cut where the data are dense.
SLICE_ROWS = 2_000_000
#: A key and a time take at least so many bytes in a table; smaller tables have no dense slice.
LEAST_ROW_BYTES = 4
#: A key with at most this part of ``SLICE_ROWS`` rows stays in one slice.
WHOLE_SHARE = 8
_BUCKETS = 8_192  # hash buckets in which rows are counted before any slice is
_WHOLE = {"whole_keys": True}  # metadata of a slice column that cuts no key
_STEP = 32  # distance of the cut points tried first
_ALL_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _over(keys: Sequence[str], order: Sequence[str], frame: str = "") -> str:
    by = ", ".join(keys) or "0"
    return f"OVER (PARTITION BY {by} ORDER BY {', '.join(order)} {frame})"


def time_slices(df: DataFrame, keys: Sequence[str], time: str, seconds: int, *, name: str = "_slice", limit: int | None = None) -> DataFrame:
    """Adds ``name``: the slice of each row, as the microsecond at which it begins; grows with ``time``.

    Slices are ``seconds`` wide. Where a key has more than ``limit`` rows in one, its
    seconds are counted and the slice is cut into pieces of about ``limit`` rows; a second that
    has more itself is cut by its microseconds in the same way. So a slice holds at most
    ``2 * limit`` rows of a key, and those of one more microsecond. Counts are bounded by the clock: a
    slice has ``seconds`` seconds, and a second a million microseconds. NULL times have a NULL slice.

    Rows are first counted by a hash of the key, which bounds the rows of every key. Where
    no key can have more than ``limit / WHOLE_SHARE`` rows, none is cut: its rows of known time share one
    slice, and the helpers below then need no carry rows. Where none can exceed ``limit``, slices keep their
    width. Only otherwise are rows counted by key and slice. Tables whose estimated size leaves no
    room for a dense slice are spared the counts. Cut or not, results are the same.
    """
    limit = limit or SLICE_ROWS
    ticks = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time})"
    second, bucket = f"floor({ticks} / 1000000)", time_bucket(time, seconds)
    whole = f"{bucket} * {seconds * 1_000_000}"
    plain = df.selectExpr("*", f"{whole} AS {name}")
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate < limit * LEAST_ROW_BYTES:
        return plain
    by = ", ".join(keys)
    most = df.groupBy(F.expr(f"pmod(hash({by}), {_BUCKETS})").alias("_h")).count().agg(F.max("count")).first()[0] or 0
    if most <= limit // WHOLE_SHARE:
        return df.select("*", F.expr(f"CASE WHEN {time} IS NOT NULL THEN 0L END").alias(name, metadata=_WHOLE))
    if most <= limit:
        return plain
    narrow = df.where(f"{time} IS NOT NULL").selectExpr(*keys, f"{bucket} AS _b", f"{second} AS _s", f"{ticks} AS _t")
    dense = materialise(narrow.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).where(f"_n > {limit}").select(*keys, "_b"), "dense")
    if dense.isEmpty():
        return plain

    def same(a: str, b: str, *columns: str):
        return F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in (*keys, *columns)))

    # The running count before a second tells its piece; a piece begins at its first second.
    hot = narrow.alias("r").join(dense.alias("d"), same("r", "d", "_b"), "left_semi")
    counted = hot.groupBy(*keys, "_b", "_s").agg(F.count("*").alias("_n"))
    placed = counted.selectExpr("*", f"sum(_n) OVER (PARTITION BY {by}, _b ORDER BY _s) - _n AS _before")
    placed = placed.selectExpr("*", f"_before div {limit} AS _piece")
    placed = placed.selectExpr(*keys, "_s", "_n", "_before", "_piece", f"min(_s) OVER (PARTITION BY {by}, _b, _piece) * 1000000 AS _start")
    placed = materialise(placed, "dense-seconds")
    full = placed.where(f"_n > {limit}")
    instants = narrow.alias("r").join(full.alias("d"), same("r", "d", "_s")).groupBy(*[f"r.{k}" for k in keys], "r._s", "r._t")
    instants = instants.agg(F.count("*").alias("_n"), F.first("d._before").alias("_from"), F.first("d._piece").alias("_first"))
    instants = instants.selectExpr("*", f"(_from + sum(_n) OVER (PARTITION BY {by}, _s ORDER BY _t) - _n) div {limit} AS _piece")
    cuts = instants.where("_piece > _first").groupBy(*keys, "_s", "_piece").agg(F.min("_t").alias("_t"))
    cuts = cuts.groupBy(*keys, "_s").agg(F.collect_list("_t").alias("_cuts"))
    starts = placed.alias("p").join(cuts.alias("c"), same("p", "c", "_s"), "left").selectExpr(
        *[f"p.{k} AS _key{i}" for i, k in enumerate(keys)], "p._s AS _second", "_start", "_cuts"
    )
    found = df.join(
        materialise(starts, "slice-starts"),
        F.expr(" AND ".join([*[f"{k} <=> _key{i}" for i, k in enumerate(keys)], f"{second} = _second"])),
        "left",
    )
    own = f"coalesce(array_max(filter(_cuts, cut -> cut <= {ticks})), _start, {whole})"
    return found.selectExpr(*df.columns, f"{own} AS {name}")


def _whole_keys(df: DataFrame, slice_col: str) -> bool:
    """Whether :func:`time_slices` found that every key is small enough for a plain window."""
    return bool(df.schema[slice_col].metadata.get("whole_keys"))


def _neighbour(df, keys, order, slice_col, values, *, ahead: bool) -> DataFrame:
    payload = struct_of(f"{source} AS {name}" for name, source in values.items())
    shift, edge, rank = ("lead", "min_by", 1) if ahead else ("lag", "max_by", 0)
    if _whole_keys(df, slice_col):
        found = df.selectExpr("*", f"{shift}({payload}) {_over(keys, order)} AS _found")
        return found.selectExpr(*df.columns, *[f"_found.{name} AS {name}" for name in values])
    edges = df.groupBy(*keys, slice_col).agg(F.expr(f"{edge}({payload}, {struct_of(order)}) AS _edge"))
    carry = edges.selectExpr(
        *keys, slice_col, f"{shift}(_edge) {_over(keys, [slice_col])} AS _carry", f"{rank} AS _rank"
    )
    rows = df.selectExpr("*", f"{payload} AS _carry", f"{1 - rank} AS _rank")
    inside = _over([*keys, slice_col], ["_rank", *order])
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .selectExpr(*df.columns, "_rank", f"{shift}(_carry) {inside} AS _found")
        .where(f"_rank = {1 - rank}")
        .selectExpr(*df.columns, *[f"_found.{name} AS {name}" for name in values])
    )


def next_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str, values: dict[str, str]
) -> DataFrame:
    """LEAD of ``values`` (output name -> input column) over ``keys`` in ``order``.

    ``slice_col`` must not decrease along ``order``. Only the first row of each slice is
    looked at across slices.
    """
    return _neighbour(df, keys, order, slice_col, values, ahead=True)


def previous_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str, values: dict[str, str]
) -> DataFrame:
    """LAG counterpart of :func:`next_in_order`."""
    return _neighbour(df, keys, order, slice_col, values, ahead=False)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: str,
    sums: dict[str, str],
    *,
    totals: dict[str, str] | None = None,
    slice_descending: bool = False,
) -> DataFrame:
    """Running BIGINT sums (current row included) over ``keys`` in ``order``.

    ``totals`` (output name -> name of a sum) adds the sum over the whole key.
    """
    totals = totals or {}
    names = list(sums)
    if _whole_keys(df, slice_col):
        every = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        added = lambda n, frame: f"coalesce(sum(CAST({sums[n]} AS BIGINT)) {_over(keys, order, frame)}, 0L)"
        return df.selectExpr(
            "*",
            *[f"{added(n, _ALL_BEFORE)} AS {n}" for n in names],
            *[f"{added(n, every)} AS {out}" for out, n in totals.items()],
        )
    per_slice = df.groupBy(*keys, slice_col).agg(
        *[F.expr(f"CAST(coalesce(sum({sums[n]}), 0) AS BIGINT) AS {n}") for n in names]
    )
    slices = [f"{slice_col} DESC" if slice_descending else slice_col]
    before = _over(keys, slices, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    whole = _over(keys, slices, "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    carried = [f"coalesce(sum({n}) {before}, 0L)" for n in names]
    carried += [f"sum({n}) {whole}" for n in totals.values()]
    carry = per_slice.selectExpr(*keys, slice_col, f"array({', '.join(carried)}) AS _carry", "0 AS _rank")
    inside = _over([*keys, slice_col], ["_rank", *order], _ALL_BEFORE)
    running = [
        f"sum(CASE WHEN _rank = 0 THEN _carry[{i}] ELSE CAST({sums[n]} AS BIGINT) END) {inside} AS {n}"
        for i, n in enumerate(names)
    ]
    wholes = [f"first(_carry[{len(names) + i}]) {inside} AS {out}" for i, out in enumerate(totals)]
    return (
        df.selectExpr("*", "1 AS _rank")
        .unionByName(carry, allowMissingColumns=True)
        .selectExpr(*df.columns, "_rank", *running, *wholes)
        .where("_rank = 1")
        .drop("_rank")
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: str,
    name: str = "_n",
    *,
    total: str | None = None,
) -> DataFrame:
    """1-based ROW_NUMBER over ``keys`` in ``order``, and on request the row count of the key."""
    return running_sums(df, keys, order, slice_col, {name: "1"}, totals={total: name} if total else None)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: str,
    length: int,
    aggregates: dict[str, str],
    block: int = 4096,
) -> DataFrame:
    """Aggregates over the current and the ``length - 1`` rows before it, per key.

    Rows are numbered per key, cut into blocks of at least ``length`` rows, and the last
    ``length - 1`` rows of a block are copied to the next one, so a task holds at most
    ``block + length`` rows of a key whatever the size of the key.
    """
    block = max(block, length)
    place = f"(_n - 1) % {block}"
    numbered = ordinal(df, keys, order, slice_col, "_n").selectExpr("*", f"(_n - 1) div {block} AS _own")
    copies = numbered.selectExpr(
        "*",
        f"explode(CASE WHEN {place} >= {block - (length - 1)} THEN array(_own, _own + 1) ELSE array(_own) END)"
        " AS _block",
    )
    frame = _over([*keys, "_block"], ["_n"], f"ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW")
    return (
        copies.selectExpr("*", *[f"{aggregate} {frame} AS {name}" for name, aggregate in aggregates.items()])
        .where("_block = _own")
        .drop("_own", "_block", "_n")
    )


def default_slices(df: DataFrame) -> int:
    """As many value slices as shuffle partitions, and at least 256."""
    return max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_value_slices(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    slices: int | None = None,
    name: str = "_slice",
    *,
    count: str | None = None,
) -> DataFrame:
    """Adds slices of about equal size along ``value``, within each of a few ``keys``.

    The cut points come from one quantile sketch per key: at most ``slices`` numbers per
    key whatever the size of the data. They reach the rows as a scalar subquery, or through a
    join with one row per key, and are searched in two steps (every 32nd cut, then the
    32 cuts from there). For pre-aggregated rows name their ``count``: the sketch then needs
    the same columns as the rows, and Spark reuses their shuffle instead of a second scan.
    """
    slices = slices or default_slices(df)
    fractions = ", ".join(str(i / slices) for i in range(1, slices))
    sketch = f"percentile_approx({value}, array({fractions}), {slices * 20})"
    if count:
        sketch += f" FILTER (WHERE {count} >= 0)"
    found = df.groupBy(*keys).agg(F.expr(f"{sketch} AS _all"))
    cuts = found.selectExpr(
        *keys, f"struct(_all, filter(_all, (cut, i) -> i % {_STEP} = {_STEP - 1}) AS _some) AS _cuts"
    )
    if keys:
        with_cuts = df.join(cuts, list(keys))  # broadcast only if it is measured small
    else:
        with_cuts = df.withColumn("_cuts", cuts.scalar())
    skipped = f"{_STEP} * size(filter(_cuts._some, cut -> cut <= {value}))"
    rest = f"size(filter(slice(_cuts._all, _skipped + 1, {_STEP}), cut -> cut <= {value}))"
    return with_cuts.selectExpr("*", f"coalesce({skipped}, 0) AS _skipped").selectExpr(
        *df.columns, f"CAST(_skipped + coalesce({rest}, 0) AS BIGINT) AS {name}"
    )


def hash_key(id_col: str, seed: int) -> str:
    """Reproducible pseudo-random key of a row: hex MD5 of id and seed."""
    return f"md5(CAST(concat(CAST({id_col} AS STRING), ':{seed}') AS BINARY))"


def hash_slice(key: str) -> str:
    """Slice of a hash key: its first five hex digits, about a million slices."""
    return f"CAST(conv(substring({key}, 1, 5), 16, 10) AS BIGINT)"
