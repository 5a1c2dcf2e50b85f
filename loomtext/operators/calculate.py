"""Derived columns. Each operation has its own rule for nulls and zeros."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import named

OPERATIONS = ("add", "subtract", "multiply", "divide", "percent_change", "ratio", "share_of_total")


def over(numerator: Column, denominator: Column) -> Column:
    """A double; null where the denominator is null or 0."""
    return F.when(denominator.isNotNull() & (denominator != 0), numerator.cast("double") / denominator.cast("double"))


def calculate(df: DataFrame, expressions: Sequence[Mapping[str, Any]]) -> DataFrame:
    """df with a column for each expression; all see the columns of df, not each other.

    add and subtract take null as 0; multiply passes it on. divide, ratio and percent_change are null where the divisor is null or
    0, and percent_change takes a null current value as 0. share_of_total divides by the sum of the column, or of its partition.
    Both sums are aggregates that are joined to the rows, so rows never meet in one task for them, however many a partition has.
    """
    taken = [e["name"] for e in expressions if e["name"] in df.columns]
    if taken:
        raise ValueError(f"columns exist already: {', '.join(taken)}")
    totals = {e["name"]: F.sum(named(df, e["value"])).alias(f"_total_{e['name']}") for e in expressions if e["operation"] == "share_of_total" and not e.get("partition_by")}
    rows = df.crossJoin(df.agg(*totals.values())) if totals else df  # by a single row
    parted = {e["name"]: tuple(e["partition_by"]) for e in expressions if e["operation"] == "share_of_total" and e.get("partition_by")}
    for k, keys in enumerate(dict.fromkeys(parted.values())):
        of_each = [F.sum(F.col("`" + e["value"] + "`")).alias(f"_total_{e['name']}") for e in expressions if parted.get(e["name"]) == keys]
        mine = [f"_part_{k}_{i}" for i in range(len(keys))]
        sums = df.groupBy(*[F.col(f"`{p}`").alias(m) for p, m in zip(keys, mine, strict=True)]).agg(*of_each)
        same = reduce(lambda x, y: x & y, [F.col(f"`{p}`").eqNullSafe(F.col(m)) for p, m in zip(keys, mine, strict=True)])
        rows = rows.join(sums, same, "left")

    def made(e: Mapping[str, Any]) -> Column:
        of = lambda key: F.col("`" + e[key] + "`")
        zero = lambda c: F.coalesce(c, F.lit(0))
        op = e["operation"]
        if op == "add":
            return zero(of("left")) + zero(of("right"))
        if op == "subtract":
            return zero(of("left")) - zero(of("right"))
        if op == "multiply":
            return of("left") * of("right")
        if op == "divide":
            return over(of("left"), of("right"))
        if op == "percent_change":
            return over((zero(of("current")) - of("base")).cast("double") * 100.0, of("base"))
        if op == "ratio":
            top, bottom = ("numerator", "denominator") if "numerator" in e else ("left", "right")
            return over(of(top), of(bottom))
        if op == "share_of_total":
            return over(of("value"), F.col(f"_total_{e['name']}"))
        raise ValueError(f"unknown operation {op!r}")

    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[made(e).alias(e["name"]) for e in expressions])
