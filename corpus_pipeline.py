"""The corpus pipeline: quality rules, line dedup, near dedup, personal data, packing. Each stage works on all that is left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import line_dedup, near_dedup, packing, pii, quality
from loomtext.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars is the length of the text as it is now."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; from the others, lines that too many documents of their source have."""
    kept = quality.quality(docs.select(*COLUMNS)).where("kept")
    return shaped(kept.withColumn("text", F.col("left_text")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that occurred before go; so do documents of which no word is left."""
    left = line_dedup.line_dedup(docs.select(*COLUMNS))
    return shaped(left.where((F.col("removed_chunks") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id; of rows that share id and text, one."""
    found = near_dedup.near_dedup(docs, width=5, percent=80)
    kept = found.where("kept").select(F.col("doc_id").alias("_id")).distinct()
    left = docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return shaped(left.dropDuplicates(["doc_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in angle brackets."""
    return shaped(pii.find_pii(docs.select(*COLUMNS), redact=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids: the columns of packing.pack."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Sketches, the random field and the tokenizer are beyond SQL: the tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
