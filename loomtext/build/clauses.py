"""Clauses of documents: ids, keywords, chunks of sentences, and labels by an injected classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def clause_ids(clauses: DataFrame, *, ordinal: str | None = None) -> DataFrame:
    """clauses with clause_id.

    Without an ordinal: <doc>__<n> from 1, by clause, source and prompt version (nulls last). With one (the row's place in its
    file): <doc>-<n> from 0, by that place. The two kinds of ids are never the same clause's by number.
    """
    keys = [ordinal] if ordinal else ["clause", "source", "prompt_version"]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.col(k).asc_nulls_last() for k in keys]))
    made = F.concat(F.col("doc_id").cast("string"), F.lit("-"), (place - 1).cast("string")) if ordinal else F.concat(F.col("doc_id").cast("string"), F.lit("__"), place.cast("string"))
    return clauses.withColumn("clause_id", made)


def clause_keywords(clauses: DataFrame, *, version: str = "pattern-v1", found: Column | None = None, **rules) -> DataFrame:
    """A row for each keyword of a clause, with its rank from 1. `found` (an array column) replaces the pattern extractor."""
    words = tx.keywords(F.col("clause"), **rules) if found is None else found
    out = clauses.select("doc_id", "clause_id", "clause", "aspect", "sentiment", "source", F.posexplode(words).alias("place", "keyword"))
    return out.select("doc_id", "clause_id", "clause", "aspect", "sentiment", "keyword", "source", F.lit(version).alias("extractor_version"), (F.col("place") + 1).alias("keyword_rank_in_clause"))


def keyword_summary(clauses: DataFrame, keywords: DataFrame, top: int = 20) -> DataFrame:
    """One row: clause_count, with_keywords, unique_keywords, top_keywords (array of struct keyword, n; most first, then by word)."""
    counts = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "keyword").limit(top).agg(F.collect_list(F.struct("keyword", "n")).alias("top_keywords"))
    best = best.select(F.array_sort("top_keywords", lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"]).cast("int")).when(a["keyword"] < b["keyword"], -1).otherwise(1)).alias("top_keywords"))
    totals = clauses.agg(F.count(F.lit(1)).alias("clause_count"))
    used = keywords.agg(F.countDistinct("clause_id").alias("with_keywords"), F.countDistinct("keyword").alias("unique_keywords"))
    return totals.crossJoin(used).crossJoin(best)  # one row each


def chunk_spans(sentences: Column, *, most_sentences: int, most_chars: int, overlap: int) -> Column:
    """Array of struct s, e: chunks of an array of sentences, from place s to before e, as chunk_sentences has them.

    A fold over the sentences: where one doesn't fit, the open chunk ends before it, and the next one begins `overlap` sentences
    earlier, if that is behind the last chunk's begin and the sentence fits there; else at the sentence.
    """
    chunk = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def grown(acc: Column, start: Column, more: Column) -> Column:
        full = F.size(acc["few"]) >= 256  # so that adding one doesn't copy them all
        return F.struct(start.alias("start"), F.when(full, more).otherwise(F.concat(acc["few"], more)).alias("few"), F.when(full, F.concat(acc["many"], F.array(acc["few"]))).otherwise(acc["many"]).alias("many"))

    def fold(totals: Column) -> Column:
        at = lambda k: F.get(totals, k)
        fits = lambda start, k: (k == start) | ((k - start < most_sentences) & (at(k + 1) - at(start) <= most_chars))

        def step(acc: Column, k: Column) -> Column:
            start = acc["start"]
            back = F.when((k - overlap > start) & F.lit(overlap > 0), k - overlap).otherwise(k)
            twice = ~fits(back, k)
            closed = F.when(fits(start, k), none).when(twice, F.array(chunk(start, k), chunk(back, k))).otherwise(F.array(chunk(start, k)))
            return grown(acc, F.when(fits(start, k), start).when(twice, k).otherwise(back), closed)

        last = F.size(totals) - 1
        begin = F.struct(F.lit(0).alias("start"), none.alias("few"), F.array().cast("array<array<struct<s:int,e:int>>>").alias("many"))
        places = F.filter(F.sequence(F.lit(0), last), lambda k: k < last)
        return F.aggregate(places, begin, step, lambda acc: F.when(last > 0, F.concat(F.flatten(acc["many"]), acc["few"], F.array(chunk(acc["start"], last)))).otherwise(none))

    return tx.let(tx.totals_before(F.transform(sentences, lambda s: F.length(s))), fold)


def chunk_sentences(df: DataFrame, *, most_sentences: int = 20, most_chars: int = 4000, overlap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, sentence_start, sentence_end (exclusive), chunk: greedy windows of sentences.

    A chunk takes sentences while there are at most most_sentences and their letters, without the spaces between, at most most_chars;
    one at least. The next one starts `overlap` sentences back, or behind the chunk if that wouldn't be further on.
    """
    listed = df.select(id_col, F.coalesce(tx.sentences(F.col(text_col)), F.array().cast("array<string>")).alias("_s"))
    chunks = listed.select(id_col, "_s", F.posexplode(chunk_spans(F.col("_s"), most_sentences=max(1, most_sentences), most_chars=max(1, most_chars), overlap=max(0, overlap))).alias("_n", "_c"))
    text = F.array_join(F.slice("_s", F.col("_c.s") + 1, F.col("_c.e") - F.col("_c.s")), " ")
    return chunks.select(id_col, F.col("_n").cast("long").alias("chunk_index"), F.col("_c.s").cast("long").alias("sentence_start"), F.col("_c.e").cast("long").alias("sentence_end"), text.alias("chunk"))


def label_texts(
    rows: DataFrame, classify: Callable[[Sequence[str]], Sequence[Mapping[str, str]]], *, batch: int = 20, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text", on_error: str = "uncertain"
) -> DataFrame:
    """ids, label, reason from a classifier that takes `batch` texts a call and runs in the tasks.

    A call that fails labels its texts `on_error`; a label outside the known tiers is non_review. Callers judge the failure rate.
    """
    known = ("genuine_review", "uncertain", "non_review")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            labels, reasons = [], []
            texts = part[text_col].fillna("").tolist()
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    found = list(classify(some))
                    if len(found) != len(some):
                        raise ValueError("as many labels as texts are needed")
                    labels += [f.get("label") if f.get("label") in known else "non_review" for f in found]
                    reasons += [f.get("reason") or ("" if f.get("label") in known else "unparsed") for f in found]
                except Exception as e:  # a remote call may fail in any way; the row says so
                    labels += [on_error] * len(some)
                    reasons += [f"failed: {type(e).__name__}"] * len(some)
            yield part[list(id_cols)].assign(label=labels, reason=reasons)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return rows.select(*id_cols, text_col).mapInPandas(run, f"{fields}, label string, reason string")
