"""The clean stage: text made from columns, rules applied, empty texts dropped, first of equal texts kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vx


def cleaned(c: Column) -> Column:
    return tx.normalise_space(tx.normalise_marks(tx.strip_phrases(tx.scrub_noise(tx.clean_rules(c)))))


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by `order` (nulls last) for each value of keys, by an aggregate: tasks reduce a hot key before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_best"))
    return best.select(*keys, *[F.col("_best").getField(c).alias(c) for c in others]).select(*df.columns)


def _joined(text_columns: Sequence[str]) -> Column:
    return tx.join_text([F.col(f"`{c}`").cast("string") for c in text_columns])


def column_types(rows: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The types of columns of text by their values in all rows, as clean() takes them. Runs one job, which brings back a row a column."""
    return {r["column"]: r["type"] for r in vx.infer_types(rows, columns).collect()}


def _made(source: DataFrame, text_columns: Sequence[str], index: str, version: str, date_column: str | None, types: Mapping[str, str]) -> DataFrame:
    """The cleaned table's columns, of rows that are kept."""
    names = source.columns
    source, raw = source.withColumn("_raw_text", _joined(text_columns)), F.col("_raw_text")  # read twice, so it is made once
    row_id = F.concat(F.lit(f"{version}:row:"), F.col(f"`{index}`").cast("string"))
    created = vx.coerce_timestamp(F.col(f"`{date_column}`").cast("string")) if date_column else F.lit(None).cast("string")
    more = [c for c in names if c not in {*text_columns, index, date_column}]
    further = lambda c: vx.coerce(F.col(f"`{c}`"), types[c]) if c in types else F.col(f"`{c}`")
    return source.select(
        row_id.alias("row_id"),
        row_id.alias("doc_id"),
        F.col(f"`{index}`").cast("long").alias("source_row_index"),
        raw.alias("raw_text"),
        cleaned(raw).alias("cleaned_text"),
        created.alias("created_at"),
        F.lit("keep").alias("clean_status"),
        F.lit("text kept after deterministic cleaning").alias("clean_reason"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])).alias("source_json"),
        *[further(c).alias(n) for c, n in zip(more, vx.column_aliases(more), strict=True)],
    )


def _kept(digested: DataFrame, dedup: bool) -> DataFrame:
    """The source rows (column r) of digested rows (r, place, digest of the cleaned text, null if that is empty) that stay."""
    if not dedup:
        return digested.where("digest is not null").select("r.*")
    rank = F.struct(F.col("place").isNull().alias("n"), F.col("place").alias("v"))
    return digested.groupBy("digest").agg(F.min_by("r", rank).alias("r")).where("digest is not null").select("r.*")


def _source(rows: DataFrame, index: str) -> list[Column]:
    return [F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"), F.col(f"`{index}`").cast("long").alias("place")]


def _digest(text: Column) -> Column:
    return F.when(text != "", F.unhex(F.sha2(text, 256)))


def clean(
    rows: DataFrame, text_columns: Sequence[str], *, index: str, version: str = "v", date_column: str | None = None, dedup: bool = True, types: Mapping[str, str] | None = None
) -> DataFrame:
    """The cleaned table: ids <version>:row:<index>, raw and cleaned text, created_at, the row as JSON, further columns.

    `index` is the source's row order. Rows whose cleaned text is empty go. With dedup the first row of each cleaned text stays:
    rows are reduced by the SHA-256 of that text before the shuffle, which moves the source row alone; texts and JSON are made
    afterwards. Further columns keep their names in a safe form, and their values; those in `types` (see column_types) become
    integers, floats or timestamps, null where they are none.
    """
    texts = rows.select(*_source(rows, index), cleaned(_joined(text_columns)).alias("text"))
    digested = texts.select("r", "place", _digest(F.col("text")).alias("digest"))  # reads text twice, so it is made once
    return _made(_kept(digested, dedup), text_columns, index, version, date_column, types or {})


def _counted(rows: DataFrame, text_columns: Sequence[str], index: str, date_column: str | None) -> tuple[DataFrame, list[str], list[str]]:
    """(r, place, digest, skipped, raw_chars, clean_chars, date_miss and a count for each rule and noise pattern; names of these)."""
    steps = rows.select(*_source(rows, index), _joined(text_columns).alias("t0"))
    rules, noise, k = [], [], 0
    for name in tx.CLEAN_RULES:  # a column a step: each is read twice, so Spark doesn't fold them into one another
        steps = steps.withColumn(f"t{k + 1}", tx.clean_rules(F.col(f"t{k}"), [name])).withColumn(f"rule_{name}", (F.col(f"t{k + 1}") != F.col(f"t{k}")).cast("long"))
        rules.append(f"rule_{name}")
        k += 1
    for i, pattern in enumerate(tx.NOISE):
        steps = steps.withColumn(f"t{k + 1}", tx.scrub_noise(F.col(f"t{k}"), [pattern])).withColumn(f"noise_{i}", tx.noise_hits(F.col(f"t{k}"), [pattern]).cast("long"))
        noise.append(f"noise_{i}")
        k += 1
    steps = steps.withColumn("done", tx.normalise_space(tx.normalise_marks(tx.strip_phrases(F.col(f"t{k}")))))
    missed = vx.coerce_timestamp(F.col(f"r.`{date_column}`").cast("string")).isNull() if date_column else F.lit(False)
    out = steps.select(
        "r",
        "place",
        _digest(F.col("done")).alias("digest"),
        (F.col("t0") == "").alias("skipped"),
        F.length("t0").cast("long").alias("raw_chars"),
        F.length("done").cast("long").alias("clean_chars"),
        missed.cast("long").alias("date_miss"),
        *rules,
        *noise,
        reduce(lambda a, b: a + b, [F.col(n) for n in noise]).alias("noise_hits"),
    )
    return out, rules, noise


def _input_totals(rules: Sequence[str], noise: Sequence[str]) -> list[Column]:
    """Aggregates over all input rows."""
    total = lambda c, name=None: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name or c)
    return [
        F.count(F.lit(1)).alias("input_rows"),
        F.count(F.when(F.col("digest").isNull(), 1)).alias("dropped_rows"),
        F.count(F.when(F.col("skipped"), 1)).alias("skipped_rows"),
        total("raw_chars"),
        total("noise_hits"),
        F.count(F.when(F.col("noise_hits") > 0, 1)).alias("noise_rows"),
        *[total(c) for c in (*rules, *noise)],
    ]


def clean_summary(rows: DataFrame, text_columns: Sequence[str], *, index: str, date_column: str | None = None) -> DataFrame:
    """One row: input_rows, kept_rows, dropped_rows (without text after cleaning), skipped_rows (without any), deduped_rows, raw_chars,
    cleaned_chars (of kept rows), date_misses (kept rows whose date can't be read), noise_hits, noise_rows, rule_<name> (rows that a
    rule changed), noise_<k> (matches of a noise pattern).
    """
    counted, rules, noise = _counted(rows, text_columns, index, date_column)
    sums = _input_totals(rules, noise)
    per_text = counted.groupBy("digest").agg(*sums, F.first("clean_chars").alias("size"), F.min_by("date_miss", F.struct(F.col("place").isNull(), "place")).alias("miss"))
    kept = F.col("digest").isNotNull()
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    whole = ["input_rows", "dropped_rows", "skipped_rows", "raw_chars", "noise_hits", "noise_rows", *rules, *noise]
    out = per_text.agg(*[total(c, c) for c in whole], F.count(F.when(kept, 1)).alias("kept_rows"), total(F.when(kept, F.col("size")), "cleaned_chars"), total(F.when(kept, F.col("miss")), "date_misses"))
    return out.withColumn("deduped_rows", F.col("input_rows") - F.col("dropped_rows") - F.col("kept_rows"))


def write_clean(
    rows: DataFrame, text_columns: Sequence[str], path: str, *, index: str, version: str = "v", date_column: str | None = None, dedup: bool = True, types: Mapping[str, str] | None = None, mode: str = "errorifexists"
) -> tuple[DataFrame, dict[str, int]]:
    """(the table that clean() makes, as written at path; its summary by the names of clean_summary).

    The counts are observed by the job that writes: the input is read once. Rows that a lost executor's task counted are not counted
    again unless a stage before a shuffle is run again, in which case input counts may be those of the last run.
    """
    counted, rules, noise = _counted(rows, text_columns, index, date_column)
    before, after = Observation(), Observation()
    seen = counted.observe(before, *_input_totals(rules, noise))
    made = _made(_kept(seen, dedup), text_columns, index, version, date_column, types or {})
    lost = F.col("created_at").isNull() & F.lit(date_column is not None)
    totals = [F.count(F.lit(1)).alias("kept_rows"), F.coalesce(F.sum(F.length("cleaned_text")), F.lit(0)).cast("long").alias("cleaned_chars"), F.count(F.when(lost, 1)).alias("date_misses")]
    made.observe(after, *totals).write.mode(mode).parquet(path)
    summary = {**before.get, **after.get}
    summary["deduped_rows"] = summary["input_rows"] - summary["dropped_rows"] - summary["kept_rows"]
    return rows.sparkSession.read.schema(made.schema).parquet(path), summary
