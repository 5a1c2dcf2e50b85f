"""Joins, aggregation, comparison, sorting and projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import named

JOINS = ("inner", "left", "right", "outer")
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join. Keys first (of the right side where the left has none), then the left's other columns, then the right's.

    A right column whose name the left has, too, becomes right_<name>. Null keys match nothing.
    """
    if how not in JOINS:
        raise ValueError(f"unknown join {how!r}")
    a, b = left.alias("a"), right.alias("b")
    col = lambda side, c: F.col(f"{side}.`{c}`")
    both = a.join(b, [col("a", k) == col("b", k) for k in on], "full" if how == "outer" else how)
    keys = [F.coalesce(col("a", k), col("b", k)).alias(k) for k in on]
    mine = [col("a", c) for c in left.columns if c not in on]
    theirs = [col("b", c).alias(f"right_{c}" if c in left.columns else c) for c in right.columns if c not in on]
    return both.select(*keys, *mine, *theirs)


def aggregate(df: DataFrame, group_by: Sequence[str], metrics: Sequence[Mapping[str, str]]) -> DataFrame:
    """Metrics {name, function, column} by group; without groups one row, also over no rows. count without a column counts rows."""

    def made(m: Mapping[str, str]) -> Column:
        column = m.get("column")
        of = F.lit(1) if m["function"] == "count" and column in (None, "", "*") else named(df, str(column))
        return AGGREGATES[m["function"]](of).alias(m["name"])

    out = [made(m) for m in metrics]
    if not group_by:
        return df.agg(*out)
    return df.groupBy(*[named(df, g) for g in group_by]).agg(*out)


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], left_label: str, right_label: str) -> DataFrame:
    """Two results side by side: all keys of both, the other columns as <label>_<name>. Without keys both must be single rows."""
    a, b = left.alias("a"), right.alias("b")
    col = lambda side, c: F.col(f"{side}.`{c}`")
    mine = [col("a", c).alias(f"{left_label}_{c}") for c in left.columns if c not in keys]
    theirs = [col("b", c).alias(f"{right_label}_{c}") for c in right.columns if c not in keys]
    if not keys:
        return a.crossJoin(b).select(*mine, *theirs)  # one row by one row
    both = a.join(b, [col("a", k) == col("b", k) for k in keys], "full")
    return both.select(*[F.coalesce(col("a", k), col("b", k)).alias(k) for k in keys], *mine, *theirs)


def sort(df: DataFrame, by: Sequence[str], order: str = "desc", limit: int | None = None, offset: int = 0) -> DataFrame:
    """All keys in one direction, nulls last in both; with a limit a top-k that sorts nothing whole."""
    direction = "asc_nulls_last" if order == "asc" else "desc_nulls_last"
    out = df.orderBy(*[getattr(named(df, c), direction)() for c in by])
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def present(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns, or all of them if none are named or a name is not a string."""
    if not columns or not all(isinstance(c, str) and c for c in columns):
        return df
    return df.select(*[named(df, c) for c in columns])
