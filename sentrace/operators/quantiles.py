"""Exact quantiles and ranks without bringing a column into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.operators.ordered import running_sums, with_value_slices


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """(name, value) rows of numeric or boolean columns as DOUBLE."""
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) AS ({name}, {value})")


def exact_quantiles(
    long: DataFrame,
    fractions: Sequence[float],
    *,
    key: str = "feature",
    value: str = "value",
    slices: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per ``key``: (key, p, quantile).

    Equal values are counted before the first shuffle. The distinct values are then cut
    into slices along the value, and each quantile is read from the rows its position falls
    into. NULL and NaN are left out. Meant for few keys (features) with many values.
    """
    counted = (
        long.where(f"{value} IS NOT NULL AND NOT isnan({value})")
        .groupBy(key, value)
        .agg(F.expr("count(*) AS _count"))
    )
    sliced = with_value_slices(counted, value, [key], slices, count="_count")
    placed = running_sums(
        sliced, [key], [value], "_slice", {"_upto": "_count"}, totals={"_total": "_upto"}
    )
    wanted = ", ".join(f"{p}D" for p in fractions)
    # Only the positions that fall on a value are kept before rows multiply.
    low, high = "floor({p} * (_total - 1))", "ceil({p} * (_total - 1))"
    held = "(_upto - _count <= {at} AND {at} < _upto)"
    hit = " OR ".join(held.format(at=at.format(p="p")) for at in (low, high))
    ranked = placed.selectExpr(
        key, value, "_total", f"explode(filter(array({wanted}), p -> {hit})) AS p"
    ).selectExpr(key, value, "p", "p * (_total - 1) AS _position")
    low = "floor(_position)"
    return (
        ranked.groupBy(key, "p")
        .agg(
            F.expr(f"min({value}) AS _low"),
            F.expr(f"max({value}) AS _high"),
            F.expr(f"max(_position - {low}) AS _part"),
        )
        .selectExpr(key, "p", "_low + (_high - _low) * _part AS quantile")
    )


def column_quantile(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """One row, one column ``quantile``."""
    return exact_quantiles(unpivot(df, [column]), [fraction]).select("quantile")


def value_ranks(df: DataFrame, value: str, slices: int | None = None) -> DataFrame:
    """Distinct values with how many rows are below, up to and in total: (value, below, upto, total).

    NULL and NaN have no rank and count nowhere.
    """
    counted = df.where(f"{value} IS NOT NULL AND NOT isnan(CAST({value} AS DOUBLE))").groupBy(value).agg(F.expr("count(*) AS _count"))
    placed = running_sums(
        with_value_slices(counted, value, (), slices, count="_count"),
        [],
        [value],
        "_slice",
        {"upto": "_count"},
        totals={"total": "upto"},
    )
    return placed.selectExpr(value, "upto - _count AS below", "upto", "total")
