"""Stages that make the standard tables from a source."""

from .asking import ask, failure_counts
from .clauses import clause_ids, clause_keywords, chunk_sentences, keyword_summary, label_texts
from .clean import clean, clean_summary, column_types, first_of_each, write_clean
from .labels import combine_chunks, gated, parse_labels, reconcile_documents, reconcile_sentences, union_spans
from .sentence_labels import area_agreement, both_labels, clause_rows, judge_sentences, label_sentences, sentence_table, verified_clauses

__all__ = [
    "chunk_sentences",
    "clause_ids",
    "clause_keywords",
    "clean",
    "clean_summary",
    "combine_chunks",
    "first_of_each",
    "gated",
    "keyword_summary",
    "label_texts",
    "parse_labels",
    "reconcile_documents",
    "reconcile_sentences",
    "union_spans",
    "ask",
    "failure_counts",
    "area_agreement",
    "both_labels",
    "clause_rows",
    "judge_sentences",
    "label_sentences",
    "sentence_table",
    "verified_clauses",
    "column_types",
    "write_clean",
]
