"""Atomic operators against DuckDB on random rows with nulls, zeros, repeats and letters of many scripts."""

import random

import duckdb
import pandas as pd
import pytest

from loomtext import operators as ops


@pytest.fixture(scope="module")
def pair(spark):
    rnd = random.Random(11)
    words = [None, "", "a_b", "a%b", "A", "é", "강릉", "back\\slash", "abc"]
    rows = [(rnd.choice([None, *range(6)]), rnd.choice([None, 0, 1, -2, 7]), rnd.choice(words)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, v long, s string")
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["k", "v", "s"]).astype({"k": "Int64", "v": "Int64"}))
    con.execute("CREATE TABLE t AS SELECT * FROM given")
    return df, con


def same(df, con, sql):
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(con.execute(sql).fetchall(), key=key)


@pytest.mark.parametrize(
    ("column", "how", "value", "where"),
    [
        ("v", "eq", 1, "v = 1"),
        ("v", "neq", 1, "v <> 1"),
        ("v", "gt", 0, "v > 0"),
        ("v", "gte", 0, "v >= 0"),
        ("v", "lt", 0, "v < 0"),
        ("v", "lte", 0, "v <= 0"),
        ("v", "in", [0, 7], "v IN (0, 7)"),
        ("v", "not_in", [0, 7], "v NOT IN (0, 7)"),
        ("v", "not_in", [0, None], "v NOT IN (0, NULL)"),
        ("v", "between", [0, 1], "v BETWEEN 0 AND 1"),
        ("s", "contains", "_", "s LIKE '%_%'"),
        ("s", "contains", "a%b", "s LIKE '%a%b%'"),
        ("s", "contains", "k\\s", r"s LIKE '%k\s%'"),
        ("s", "contains", "릉", "s LIKE '%릉%'"),
        ("s", "is_null", None, "s IS NULL"),
        ("s", "not_null", None, "s IS NOT NULL"),
    ],
)
def test_filters(pair, column, how, value, where):
    same(ops.filter_rows(pair[0], column, how, value), pair[1], f"SELECT * FROM t WHERE {where}")


def test_string_dates_compare_as_text_and_typed_ones_as_time(spark):
    df = spark.sql("SELECT '2025-08-22T10:00:00Z' AS s, timestamp_ntz'2025-08-22 10:00:00' AS t")
    for column in ("s", "t"):
        assert ops.filter_rows(df, column, "between", ["2025-08-15", "2025-08-22"]).count() == 0
        assert ops.filter_rows(df, column, "between", ["2025-08-15", "2025-08-23"]).count() == 1


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` long, `c``d` long")
    assert ops.filter_rows(df, "a.b", "eq", 1).count() == 1
    assert ops.present(df, ["c`d"]).first()[0] == 2


@pytest.mark.parametrize(("how", "sql"), [("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")])
def test_joins_with_null_keys_and_clashing_names(pair, how, sql):
    df, con = pair
    left, right = df.where("v = 1").select("k", "s"), df.where("v = 7").select("k", "s", "v")
    out = ops.join(left, right, ["k"], how)
    assert out.columns == ["k", "s", "right_s", "v"]
    same(out, con, f"SELECT coalesce(l.k, r.k), l.s, r.s, r.v FROM (SELECT k, s FROM t WHERE v = 1) l {sql} (SELECT * FROM t WHERE v = 7) r ON l.k = r.k")


def test_aggregates_by_group_and_in_all(pair):
    metrics = [{"name": f, "function": f, "column": "v"} for f in ("count", "sum", "avg", "min", "max")]
    sql = "count(v), CAST(sum(v) AS BIGINT), avg(v), min(v), max(v)"
    same(ops.aggregate(pair[0], ["k", "s"], metrics), pair[1], f"SELECT k, s, {sql} FROM t GROUP BY k, s")
    same(ops.aggregate(pair[0].where("k > 99"), [], metrics), pair[1], f"SELECT {sql} FROM t WHERE k > 99")


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_nulls_are_last_in_both_directions(pair, order):
    got = [r.k for r in ops.sort(pair[0], ["k"], order).collect()]
    assert got == [r[0] for r in pair[1].execute(f"SELECT k FROM t ORDER BY k {order} NULLS LAST").fetchall()]


def test_top_k_sorts_nothing_whole(pair):
    plan = ops.sort(pair[0], ["k", "v", "s"], "desc", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_arithmetic_of_nulls_and_zeros(spark):
    df = spark.createDataFrame([(10, 0), (10, 2), (10, None), (None, 4)], "numerator int, denominator int")
    made = ops.calculate(
        df,
        [
            {"name": "d", "operation": "divide", "left": "numerator", "right": "denominator"},
            {"name": "r", "operation": "ratio", "numerator": "numerator", "denominator": "denominator"},
            {"name": "p", "operation": "percent_change", "base": "denominator", "current": "numerator"},
            {"name": "a", "operation": "add", "left": "numerator", "right": "denominator"},
            {"name": "m", "operation": "multiply", "left": "numerator", "right": "denominator"},
        ],
    )
    rows = [tuple(r)[2:] for r in made.collect()]
    assert rows == [(None, None, None, 10, 0), (5.0, 5.0, 400.0, 12, 20), (None, None, None, 10, None), (None, None, -100.0, 4, None)]


def test_shares(pair):
    df, con = pair
    positive = df.where("v > 0")
    out = ops.calculate(positive, [{"name": "x", "operation": "share_of_total", "value": "v"}, {"name": "y", "operation": "share_of_total", "value": "v", "partition_by": ["k"]}])
    same(out, con, "SELECT *, CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY k) AS DOUBLE) FROM t WHERE v > 0")
    empty = ops.calculate(df.where("k > 99"), [{"name": "x", "operation": "share_of_total", "value": "v"}])
    assert empty.count() == 0
    with pytest.raises(ValueError, match="exist"):
        ops.calculate(df, [{"name": "v", "operation": "add", "left": "k", "right": "v"}])


def test_a_filter_and_its_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = ops.present(ops.filter_rows(df, "o_totalprice", "gt", 100.0), ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100.0)" in plan and "o_custkey" not in plan
