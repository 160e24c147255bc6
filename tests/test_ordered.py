"""Sliced computations against plain windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrace.operators import ordered as O
from sentrace.operators.quantiles import exact_quantiles, unpivot, value_ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None]), rng.randrange(200), rng.randrange(5)) for i in range(600)]
    return spark.createDataFrame(data, "id int, k string, t int, v int").selectExpr("*", "t div 10 AS s").cache()


def same(left, right):
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour_equals_window(rows, ahead):
    find, name = (O.next_in_order, "lead") if ahead else (O.previous_in_order, "lag")
    mine = find(rows, ["k"], ["t", "id"], "s", {"n": "v"}).select("id", "n")
    same(mine, rows.selectExpr("id", f"{name}(v) OVER (PARTITION BY k ORDER BY t, id) AS n"))


def test_neighbour_keeps_null_values(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 9, 5)], "id int, t int, v int").selectExpr("*", "t div 5 AS s")
    found = O.previous_in_order(df, [], ["t"], "s", {"p": "v"}).orderBy("id").collect()
    assert [r["p"] for r in found] == [None, None]


def test_running_sums_equal_window(rows):
    mine = O.running_sums(rows, ["k"], ["t", "id"], "s", {"r": "v"}, totals={"all": "r"}).select("id", "r", "all")
    plain = rows.selectExpr(
        "id",
        "sum(v) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS r",
        "sum(v) OVER (PARTITION BY k) AS all",
    )
    same(mine, plain)


def test_running_sums_descending_without_key(rows):
    mine = O.running_sums(rows, [], ["t DESC", "id"], "s", {"r": "v"}, slice_descending=True).select("id", "r")
    same(mine, rows.selectExpr("id", "sum(v) OVER (ORDER BY t DESC, id ROWS UNBOUNDED PRECEDING) AS r"))


@pytest.mark.parametrize("length,block", [(1, 1), (3, 4), (7, 7), (50, 64)])
def test_trailing_equals_window(rows, length, block):
    mine = O.trailing(rows, ["k"], ["t", "id"], "s", length, {"x": "collect_list(id)", "n": "count(*)"}, block)
    frame = f"OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    same(mine.select("id", "x", "n"), rows.selectExpr("id", f"collect_list(id) {frame} AS x", f"count(*) {frame} AS n"))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(float(a), float(b)) for a, b in zip(rng.lognormal(0, 3, 1001), rng.integers(0, 4, 1001))]
    df = spark.createDataFrame([*data, (None, 2.0)], "a double, b double")
    got = {(r["feature"], r["p"]): r["quantile"] for r in exact_quantiles(unpivot(df, ["a", "b"]), [0.0, 0.25, 0.5, 0.93, 1.0], slices=16).collect()}
    for name, values in {"a": [d[0] for d in data], "b": [d[1] for d in data] + [2.0]}.items():
        for p in (0.0, 0.25, 0.5, 0.93, 1.0):
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantile_of_one_value_holding_most_rows(spark):
    df = spark.range(1000).selectExpr("CAST(if(id < 900, 5, id) AS DOUBLE) AS x")
    got = exact_quantiles(unpivot(df, ["x"]), [0.5, 0.95]).collect()
    values = [5.0] * 900 + [float(i) for i in range(900, 1000)]
    assert sorted(r["quantile"] for r in got) == pytest.approx(sorted(np.quantile(values, [0.5, 0.95])))


def test_value_ranks(rows):
    mine = value_ranks(rows.select("t"), "t", slices=8)
    plain = rows.groupBy("t").count().selectExpr(
        "t", "sum(count) OVER (ORDER BY t) - count AS below", "sum(count) OVER (ORDER BY t) AS upto", "600L AS total"
    )
    same(mine, plain)


def test_slices_follow_the_value(rows):
    cut = O.with_value_slices(rows.select(F.col("t").cast("double").alias("t")), "t", slices=8)
    spans = cut.groupBy("_slice").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_slice").collect()
    assert len(spans) > 4 and all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))
