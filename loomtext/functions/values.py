"""Dates, JSON fields and inferred types."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import UNICODE, strip

# Timestamp formats that are understood, in order.
TIMESTAMPS = ("yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
#: How texts in these formats begin. Others aren't tried: each format that doesn't fit costs an exception.
YEAR_FIRST = "^[+-]?[0-9]{4,}[-/]"
DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")
#: The share of filled values that must be timestamps.
TIMESTAMP_SHARE = 0.9


def coerce_timestamp(c: Column) -> Column:
    """ISO text in UTC of a text in one of the known formats, else null. Without a zone it is UTC. The session's zone must be UTC."""
    text = strip(F.regexp_replace(c, "^﻿+", ""))
    tried = F.when(text.rlike(YEAR_FIRST), F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMPS]))
    return F.when(~F.lower(text).startswith("invalid"), F.date_format(tried, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def to_date(c: Column) -> Column:
    """A date from a text that is a date or instant in one of the usual forms, else null."""
    return F.coalesce(c.try_cast("date"), *[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATES])


# Keys of source rows that may hold the day of a text, in the order in which they are tried.
DATE_KEYS = (
    "게시일",
    "작성일",
    "작성시간",
    "등록일",
    "수집일",
    "날짜",
    "docDatetime",
    "doc_datetime",
    "pub_date",
    "reg_date",
    "post_date",
    "write_date",
    "regdate",
    "datetime",
    "date",
    "published_at",
)


def with_day(df: DataFrame, *, created: str = "created_at", json_col: str = "source_json", keys: Sequence[str] = DATE_KEYS, name: str = "day") -> DataFrame:
    """df with the date of each row: from `created` if any row has one there, else from the first key of the JSON that has any.

    One aggregate counts the dates under all keys, with the JSON parsed once a row to a map; its one row, the key chosen, is joined
    to the rows, so nothing runs before a result is asked for. A column that isn't there has no dates; with no date at all, all are
    null. JSON that isn't an object has no keys.
    """
    if name in df.columns:
        raise ValueError(f"column exists already: {name}")
    own = to_date(F.col(f"`{created}`").cast("string")) if created in df.columns else F.lit(None).cast("date")
    fields = F.from_json(F.col(f"`{json_col}`").cast("string"), "map<string,string>") if json_col in df.columns else F.lit(None).cast("map<string,string>")
    found = df.select(own.alias("own"), fields.alias("fields"))
    counts = found.agg(F.count("own").alias("own"), *[F.count(to_date(F.try_element_at("fields", F.lit(k)))).alias(f"k{i}") for i, k in enumerate(keys)])
    chosen = F.coalesce(F.when(F.col("own") > 0, ""), *[F.when(F.col(f"k{i}") > 0, k) for i, k in enumerate(keys)])
    day = F.when(F.col("_key") == "", own).otherwise(to_date(F.try_element_at(fields, F.col("_key"))))
    return df.crossJoin(F.broadcast(counts.select(chosen.alias("_key")))).withColumn(name, day).drop("_key")  # by a single row


def as_text(kind: T.DataType) -> T.DataType:
    """The same shape with text at every leaf: what JSON of unknown types is read as."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, as_text(f.dataType)) for f in kind])
    return T.ArrayType(as_text(kind.elementType)) if isinstance(kind, T.ArrayType) else T.StringType()


def normalised(c: Column, kind: T.DataType) -> Column:
    """A value of shape as_text(kind) as `kind`, by a walk over it.

    Booleans are true for the text true in any case, else false, also for null. Integers are read as such, else null. An object
    whose fields are all null before that is null. Blank texts stay; other types are cast where that can be.
    """
    if isinstance(kind, T.StructType):
        filled = F.array_contains(F.array(*[c[f.name].isNotNull() for f in kind]), True)
        return F.when(filled, F.struct(*[normalised(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: normalised(x, kind.elementType))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.lower(strip(c)) == "true", F.lit(False))
    if isinstance(kind, T.IntegralType):
        return F.when(strip(c).rlike(r"^[+-]?[0-9]+$"), strip(c).try_cast(kind))
    return c if isinstance(kind, T.StringType) else c.try_cast(kind)


def json_value(c: Column, schema: str) -> Column:
    """JSON text as a struct by a DDL schema, leniently: each field is normalised by its type; text that is no object is null."""
    kind = T.StructType.fromDDL(schema)
    return normalised(F.from_json(c, as_text(kind)), kind)


def json_field(c: Column, key: str) -> Column:
    """A field of a JSON object as text; the key is taken as it is, dots and all."""
    return F.get_json_object(c, "$['" + key.replace("'", "\\'") + "']")


def source_url(c: Column) -> Column:
    """The first value, by key, that is a web address without white space; empty if there is none."""
    entries = F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    values = F.transform(entries, lambda e: strip(e["value"]))
    urls = F.filter(values, lambda v: v.rlike(r"^https?://[^ \t\r\n]*$"))
    return F.coalesce(F.get(urls, F.lit(0)), F.lit(""))


def bucket(c: Column, grain: str) -> Column:
    """Label of a day, a week (its Monday) or a month."""
    if grain == "month":
        return F.date_format(c, "yyyy-MM")
    return F.date_format(F.date_trunc("week", c) if grain == "week" else c, "yyyy-MM-dd")


def number_text(c: Column) -> Column:
    return F.regexp_replace(strip(c), ",", "")


def coerce(c: Column, kind: str) -> Column:
    """A text as integer, float, timestamp (ISO text) or string; null where it isn't one."""
    if kind == "integer":
        return F.when(number_text(c).rlike(r"^[+-]?[0-9]+$"), number_text(c).try_cast("bigint"))
    if kind == "float":
        return number_text(c).try_cast("double")
    if kind == "timestamp":
        return coerce_timestamp(c)
    return F.when(strip(c) != "", c)


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] = (), *, sample: int | None = None) -> DataFrame:
    """column, type of text columns, from their values in all rows: timestamp, integer, float, else string.

    With a sample, only so many rows count; order_by fixes which are first, without it they are any. One aggregate over the rows
    finds all types.
    """
    columns = list(columns or df.columns)
    rows = df
    if sample is not None:
        rows = (df.orderBy(*order_by) if order_by else df).limit(sample)
    rows = rows.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns)])
    parts = []
    for k, c in enumerate(columns):
        col = F.col(f"c{k}")
        filled = F.count(F.when(strip(col) != "", 1))
        is_a = lambda kind, col=col: F.count(F.when((strip(col) != "") & coerce(col, kind).isNotNull(), 1))
        kind = (
            F.when(filled == 0, "string").when(is_a("timestamp") >= TIMESTAMP_SHARE * filled, "timestamp").when(is_a("integer") == filled, "integer").when(is_a("float") == filled, "float").otherwise("string")
        )
        parts.append(F.struct(F.lit(c).alias("column"), kind.alias("type")))
    return rows.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("e")).select("e.column", "e.type")


def column_aliases(names: Sequence[str]) -> list[str]:
    """Safe names: lower case, other characters as underscores; col_<n> where no letter leads; a number where one repeats."""
    out: list[str] = []
    for k, name in enumerate(names):
        made = re.sub(r"[^a-z0-9_]+", "_", name.strip().lstrip("﻿").lower()).strip("_")
        if not made or not made[0].isalpha():
            made = f"col_{k}"
        base, i = made, 2
        while made in out:
            made, i = f"{base}_{i}", i + 1
        out.append(made)
    return out


def blank_to(c: Column, word: str = "unknown") -> Column:
    """The trimmed text, or `word` for null and blank."""
    return F.coalesce(F.when(strip(c) != "", strip(c)), F.lit(word))


def percent_of(part: Column, whole: Column) -> Column:
    """Percent to one decimal, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part.cast("double") / whole * 1000 + 0.5) / 10).otherwise(0.0)


__all__ = ["UNICODE", "blank_to", "bucket", "coerce", "coerce_timestamp", "column_aliases", "infer_types", "json_field", "json_value", "percent_of", "source_url", "to_date", "with_day"]
