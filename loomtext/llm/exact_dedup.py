"""Exact dedup by a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, stored


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09 to 0x0D; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text, 32 bytes), n_points (code points of the original text)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
    )


def best(n_points: str, doc_id: str) -> Column:
    """The greatest (code points, complement of the id): a longer text first, then a smaller id, null ids last."""
    return F.max(F.struct(F.col(n_points).alias("n_points"), F.bitwise_not(doc_id).alias("order")))


class DigestIndex:
    """A table of digests, a row for each: digest, keep_id, n_points, group_size; bucketed and sorted by digest. Beside it, in
    <table>_again, what later increments hold of digests that it has.

    Both outlive sessions where the catalog does. The joins of an increment read them bucket by bucket, without a shuffle of
    them where there are as many buckets as shuffle partitions.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int):
        self.spark, self.table, self.buckets = spark, table, buckets

    def read(self, table: str) -> DataFrame | None:
        return self.spark.table(table) if self.spark.catalog.tableExists(table) else None

    def write(self, rows: DataFrame, table: str) -> None:
        if self.buckets < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            rows = rows.coalesce(self.buckets)  # else a task has whole buckets as it is
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(table)

    def rows(self) -> DataFrame:
        """digest, keep_id, group_size over all increments: of equal texts the longest row, then the least id."""
        first, again = self.read(self.table), self.read(f"{self.table}_again")
        if again is None:
            return first.select("digest", "keep_id", "group_size")
        more = again.groupBy("digest").agg(best("n_points", "keep_id").alias("best"), F.sum("group_size").alias("more"))
        both = first.join(more, "digest", "left")
        keep = F.greatest(F.struct("n_points", F.bitwise_not("keep_id").alias("order")), "best")
        return both.select("digest", F.bitwise_not(keep["order"]).alias("keep_id"), (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def append(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds an increment: texts that the index lacks, by a sort-merge anti-join, and counts and best rows of those it has.

        Of equal texts, the row with the most code points stays, then the one with the smallest id (a null id comes after all
        others), whichever increment it came in. Equal rows are counted before the shuffle, so a text with a third of all rows
        costs one row a task.
        """
        new = (
            digests(docs, id_col=id_col, text_col=text_col)
            .groupBy("digest")
            .agg(best("n_points", "doc_id").alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.bitwise_not("best.order").alias("keep_id"), "best.n_points", "group_size")
        )
        known = self.read(self.table)
        if known is None:
            self.write(new, self.table)
            return
        new, known = stored(new, "increment"), known.select("digest").hint("merge")
        self.write(new.join(known, "digest", "left_semi"), f"{self.table}_again")
        self.write(new.join(known, "digest", "left_anti"), self.table)
        discard(new)

    def match(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs whose text the index has.

        Both sides are shuffled by the hexadecimal digest, not read by bucket: Spark can then split the rows of a text that a
        third of all documents have.
        """
        name = F.lower(F.hex("digest")).alias("text_sha256")
        mine = digests(docs, id_col=id_col, text_col=text_col).select("doc_id", name)
        return mine.join(self.rows().select(name, "keep_id", "group_size"), "text_sha256").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
        )


def exact_dedup(docs: DataFrame, table: str, *, increments: int = 2, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Indexes all of docs in a table and returns each row with the row that stays for its text: see DigestIndex.

    The index grows by increments, dealt by a hash of the id: each after the first goes through the anti-join. Null and empty
    texts are equal to each other. Rows that repeat an id and a text are all marked kept where that id stays. Other columns are
    ignored; an empty table gives no rows. By default there is a bucket for about 100,000 rows, at most as many as shuffle
    partitions.
    """
    spark = docs.sparkSession
    buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + docs.count() // 100_000)
    index = DigestIndex(spark, table, buckets)
    for k in range(increments):
        index.append(docs.where(F.pmod(F.xxhash64(id_col), F.lit(increments)) == k), id_col=id_col, text_col=text_col)
    return index.match(docs, id_col=id_col, text_col=text_col)
