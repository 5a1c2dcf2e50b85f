"""Writers. Spark's committers rename whole files into place, so a failed write leaves none behind."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, columns: Sequence[str] | None = None, *, mode: str = "errorifexists") -> None:
    """The declared columns; those that are lacking are null. An empty table is written, too."""
    chosen = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns or df.columns]
    df.select(*chosen).write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, order_by: Sequence[str] = (), *, mode: str = "errorifexists") -> None:
    """One object a line, in the given order over the part files."""
    (df.orderBy(*[F.asc_nulls_last(c) for c in order_by]) if order_by else df).write.mode(mode).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] = (), *, one_file: bool = False, mode: str = "errorifexists") -> None:
    """With headers, nulls empty, sorted over the part files. one_file is for exports that people open: one task writes it all."""
    out = df.orderBy(*[F.asc_nulls_last(c) for c in order_by if c in df.columns]) if order_by else df
    (out.coalesce(1) if one_file else out).write.mode(mode).csv(path, header=True, escape='"')


class FailureShareExceeded(RuntimeError):
    """Too many rows of a build failed; nothing was published."""


def publish(df: DataFrame, path: str, *, failed: Column, attempted: Column | None = None, most_share: float = 0.5) -> DataFrame:
    """df written as Parquet at path, unless most_share or more of the attempted rows failed: then nothing is there, and it raises.

    Both counts are observed by the writing job itself, so injected functions run once. The files lie beside path until the counts
    are known, and become path by one rename. A row counts as attempted if `attempted` is true (all rows, by default), and as failed
    if `failed` is true, too. A build without attempts is published. path must not exist.
    """
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    aside, there = jvm_path(f"{path.rstrip('/')}_unpublished-{uuid.uuid4().hex}"), jvm_path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(there):
        raise FileExistsError(path)
    tried = F.lit(True) if attempted is None else attempted
    seen = Observation()
    try:
        df.observe(seen, F.count(F.when(tried, 1)).alias("attempted"), F.count(F.when(tried & failed, 1)).alias("failed")).write.parquet(aside.toString())
        counts = seen.get
        if counts["attempted"] and counts["failed"] >= most_share * counts["attempted"]:
            raise FailureShareExceeded(f"{counts['failed']} of {counts['attempted']} rows failed, which is {most_share:.0%} or more")
        if not store.rename(aside, there):
            raise FileExistsError(path)
    finally:
        store.delete(aside, True)
    return spark.read.schema(df.schema).parquet(path)


def provenance(task: str, **facts: Any) -> Mapping[str, Any]:
    """What an artifact was made from, and a hash of it: the first 16 hexadecimal digits of SHA-256 over canonical JSON."""
    body = {"task": task, **{k: sorted(v) if k == "inputs" else v for k, v in facts.items()}}
    text = json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return {**body, "hash": hashlib.sha256(text.encode()).hexdigest()[:16]}
