"""Filters: one predicate on one column."""

from __future__ import annotations

import operator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import family

COMPARISONS = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
CONDITIONS = (*COMPARISONS, "in", "not_in", "between", "contains", "is_null", "not_null")


def named(df: DataFrame, column: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + column.replace("`", "``") + "`"]


def condition(df: DataFrame, column: str, how: str, value: Any = None) -> Column:
    """The predicate `column how value`; null rows never pass, but for is_null.

    A string against a date or timestamp column is cast to the column's type; against a string column it is compared as text.
    contains is LIKE with % and _ live, and case counts. A null among the values of not_in lets no row pass.
    """
    col = named(df, column)
    kind = df.schema[column].dataType

    def literal(v: Any) -> Column:
        made = F.lit(v)
        return made.cast(kind) if v is None or (family(kind) == "time" and isinstance(v, str)) else made

    if how in COMPARISONS:
        return COMPARISONS[how](col, literal(value))
    if how == "in":
        return col.isin(*[literal(v) for v in value])
    if how == "not_in":
        return ~col.isin(*[literal(v) for v in value])
    if how == "between":
        low, high = value
        return col.between(literal(low), literal(high))
    if how == "contains":
        return col.like("%" + str(value).replace("\\", "\\\\") + "%")
    if how == "is_null":
        return col.isNull()
    if how == "not_null":
        return col.isNotNull()
    raise ValueError(f"unknown filter operator {how!r}")


def filter_rows(df: DataFrame, column: str, how: str, value: Any = None) -> DataFrame:
    return df.where(condition(df, column, how, value))
