"""Rows of exports, in the order that files have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..build.clauses import clause_ids
from .dashboards import with_clean


def genuineness_rows(labels: DataFrame, clean: DataFrame | None) -> DataFrame:
    """Labels with texts by source order; labels alone where there is no cleaned table."""
    if clean is None:
        return labels.orderBy(F.asc_nulls_last("doc_id"))
    return with_clean(labels, clean).orderBy(F.asc_nulls_last("source_row_index"), F.asc_nulls_last("doc_id"))


def clause_rows(clauses: DataFrame, clean: DataFrame, labels: DataFrame, *, ordinal: str) -> DataFrame:
    """Clauses with ids by place, texts, and their document's label."""
    tier = labels.select(F.col("doc_id").alias("_d"), "genuineness")
    rows = with_clean(clause_ids(clauses, ordinal=ordinal), clean)
    return rows.join(tier, rows["doc_id"] == F.col("_d"), "left").drop("_d").orderBy(F.asc_nulls_last("source_row_index"), F.asc_nulls_last("clause_id"))


def verified_rows(labels: DataFrame) -> DataFrame:
    """Verified document labels with the models' and the judge's answers as columns."""
    part = lambda c, f: F.col(f"{c}.{f}").alias(f"{c.removesuffix('_result')}_{f}") if c in labels.columns else F.lit(None).alias(f"{c.removesuffix('_result')}_{f}")
    return labels.select("doc_id", "final_label", "needs_review", "resolution", *[part(c, f) for c in ("model_a_result", "model_b_result") for f in ("genuineness", "reason")], part("judge_result", "final_label"), part("judge_result", "confidence"), part("judge_result", "reason"))


def verified_clause_rows(clauses: DataFrame, clean: DataFrame) -> DataFrame:
    rows = with_clean(clauses, clean)
    return rows.select("doc_id", "clause", "sentiment", "aspect", "resolution", "needs_review", "cleaned_text").orderBy(F.asc_nulls_last("doc_id"), F.asc_nulls_last("clause"))
