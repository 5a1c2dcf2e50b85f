"""Corrections laid over tables when they are read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import replace_words


def apply_rules(keywords: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """keywords without blocked terms and with synonyms replaced, by active rules {rule_type, source_term, target_term, active}.

    Blocks compare the keyword as it was. A term that maps to itself is no rule.
    """
    active = [r for r in rules if r.get("active") is True and r.get("source_term")]
    block = [r["source_term"] for r in active if r.get("rule_type") == "block"]
    synonyms = {r["source_term"]: r["target_term"] for r in active if r.get("rule_type") == "synonym" and r.get("target_term") and r["target_term"] != r["source_term"]}
    kept = keywords.where(F.col("keyword").isNull() | ~F.col("keyword").isin(*block)) if block else keywords
    return kept.select(*[replace_words(F.col(c), synonyms).alias(c) if c == "keyword" else F.col(c) for c in kept.columns])


def override_labels(labels: DataFrame, overrides: DataFrame, *, key: str = "doc_id", columns: Sequence[str] = ("genuineness", "reason")) -> DataFrame:
    """labels with each column replaced by override_<column> where an override has one, and overridden (boolean)."""
    mine = overrides.select(F.col(key).alias("_k"), *[F.col(f"override_{c}").alias(f"_o_{c}") for c in columns if f"override_{c}" in overrides.columns])
    joined = labels.join(mine, labels[key] == F.col("_k"), "left")
    out = [F.coalesce(F.col(f"_o_{c}"), labels[c]).alias(c) if f"_o_{c}" in mine.columns else labels[c] for c in labels.columns]
    return joined.select(*out, F.col("_k").isNotNull().alias("overridden"))


def count_shift(labels: DataFrame, overrides: DataFrame, *, column: str = "genuineness", keep: str = "non_review") -> DataFrame:
    """Per label: n_before, n_after, and crossed (rows that an override moves into or out of `keep`)."""
    after = override_labels(labels.select("doc_id", column), overrides, columns=(column,)).select("doc_id", F.col(column).alias("after"))
    both = labels.select("doc_id", F.col(column).alias("before")).join(after, "doc_id")
    moved = (F.col("before") == keep) != (F.col("after") == keep)
    each = both.select(F.explode(F.array(F.struct(F.col("before").alias("label"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("after").alias("label"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("e"), moved.alias("m"))
    return each.groupBy(F.col("e.label").alias("label")).agg(
        F.sum("e.b").cast("long").alias("n_before"), F.sum("e.a").cast("long").alias("n_after"), F.sum(F.col("m").cast("int")).cast("long").alias("crossed")
    )
