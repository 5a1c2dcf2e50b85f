"""Named tables, their contracts, and the families of column types that checks speak of."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")

# The columns of the standard tables. docs may have further columns.
CONTRACTS: dict[str, tuple[str, ...]] = {
    "docs": ("doc_id", "row_id", "raw_text", "cleaned_text", "created_at"),
    "clauses": ("doc_id", "clause_id", "clause", "sentiment", "aspect", "prompt_version", "source"),
    "genuineness": ("doc_id", "genuineness", "reason", "prompt_version", "source"),
    "clause_keywords": ("doc_id", "clause_id", "clause", "aspect", "sentiment", "keyword", "source", "extractor_version", "keyword_rank_in_clause"),
}


def family(kind: T.DataType) -> str:
    """numeric, time, text, boolean or other."""
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    if isinstance(kind, T.StringType):
        return "text"
    return "boolean" if isinstance(kind, T.BooleanType) else "other"


@dataclass
class Catalog:
    """Tables by name. Any table may be registered; the standard ones have contracts to check against."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, *, strict: bool = True) -> Catalog:
        """Adds a table. A standard table must have the columns of its contract, unless strict is off."""
        if not NAME.fullmatch(name):
            raise ValueError(f"not a table name: {name!r}")
        lacking = [c for c in CONTRACTS.get(name, ()) if c not in df.columns]
        if strict and lacking:
            raise ValueError(f"{name} lacks {', '.join(lacking)}")
        self.tables[name] = df
        return self

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self.tables

    def extra_columns(self, name: str) -> list[str]:
        """Columns beyond the contract: what the real data offers besides."""
        return [c for c in self.tables[name].columns if c not in CONTRACTS.get(name, ())]

    @staticmethod
    def of(tables: Mapping[str, DataFrame]) -> Catalog:
        out = Catalog()
        for name, df in tables.items():
            out.register(name, df, strict=False)
        return out
