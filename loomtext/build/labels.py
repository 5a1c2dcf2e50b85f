"""Labels of documents and sentences: parsing, combining chunks, and settling two models' answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Document tiers by rank, sentiments, and the confidence below which a judge's answer needs review.
TIERS = ("non_review", "uncertain", "genuine_review")
SENTIMENTS = ("positive", "neutral", "negative")
SURE = 0.85


def gated(clean: DataFrame, labels: DataFrame, include: Sequence[str] = ("genuine_review", "uncertain"), overrides: DataFrame | None = None) -> DataFrame:
    """Cleaned rows whose tier is wanted. An override (doc_id, override_genuineness) beats final_label, which beats genuineness."""
    own = [c for c in ("final_label", "genuineness", "label") if c in labels.columns]
    tiers = labels.select(F.col("doc_id").alias("_id"), F.coalesce(*[F.col(c) for c in own]).alias("_tier"))
    if overrides is not None:
        tiers = tiers.join(overrides.select(F.col("doc_id").alias("_id"), F.col("override_genuineness").alias("_own")), "_id", "full").select("_id", F.coalesce("_own", "_tier").alias("_tier"))
    return clean.join(tiers, clean["row_id"] == F.col("_id"), "left").where(F.col("_tier").isin(*include)).drop("_id", "_tier")


def combine_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, label, genuine_spans from chunk labels: genuine if any chunk is, else uncertain if any is, else non_review."""
    rank = F.max(F.when(F.col("label") == TIERS[2], 2).when(F.col("label") == TIERS[1], 1).otherwise(0))
    spans = F.collect_list(F.when(F.col("label") == TIERS[2], F.struct("chunk_index", "sentence_start", "sentence_end")))
    return chunks.groupBy("doc_id").agg(F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank + 1).alias("label"), F.array_sort(spans).alias("genuine_spans"))


def union_spans(a: Column, b: Column) -> Column:
    """Distinct (sentence_start, sentence_end) of both, in order."""
    bare = lambda s: F.struct(s["sentence_start"].alias("sentence_start"), s["sentence_end"].alias("sentence_end"))
    return F.array_sort(F.array_distinct(F.concat(F.transform(a, bare), F.transform(b, bare))))


def in_spans(index: Column, spans: Column) -> Column:
    """Whether a sentence lies in a span; in all of them where there are none."""
    return spans.isNull() | (F.size(spans) == 0) | F.exists(spans, lambda s: (index >= s["sentence_start"]) & (index < s["sentence_end"]))


def reconcile_documents(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, label_a, label_b, and a judge's judge_decision, judge_label, judge_confidence) with final_label, resolution, needs_review.

    Equal labels agree. One missing: the other's label (partial). Both missing: uncertain, for review. Else the judge decides; its
    answer is for review if it says so, is missing, or is less than sure.
    """
    a, b = F.col("label_a"), F.col("label_b")
    unsure = F.col("judge_label").isNull() | (F.col("judge_decision") == "review") | (F.coalesce("judge_confidence", F.lit(0.0)) < SURE)
    resolution = F.when(a.isNull() & b.isNull(), "both_failed").when(a.isNull() | b.isNull(), "partial").when(a == b, "agree").otherwise("judge")
    return pairs.withColumn("resolution", resolution).withColumns(
        {
            "final_label": F.when(F.col("resolution") == "judge", F.coalesce("judge_label", F.lit("uncertain"))).otherwise(F.coalesce(a, b, F.lit("uncertain"))),
            "is_disagreement": F.col("resolution") == "judge",
            "needs_review": (F.col("resolution") == "both_failed") | ((F.col("resolution") == "judge") & F.coalesce(unsure, F.lit(True))),
        }
    )


def parse_labels(relevant: Column, sentiment: Column, aspects: Column, allowed: Sequence[str], fallback: str) -> Column:
    """struct relevant, sentiment, aspects of a model's raw answer.

    Unknown aspects go; a relevant sentence without any has the fallback; an unknown sentiment is neutral; aspects are sorted.
    """
    yes = F.coalesce(relevant, F.lit(False))
    known = F.array_sort(F.array_distinct(F.array_intersect(F.coalesce(aspects, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in allowed]))))
    kept = F.when(~yes, F.array().cast("array<string>")).when(F.size(known) == 0, F.array(F.lit(fallback))).otherwise(known)
    return F.struct(yes.alias("relevant"), F.when(sentiment.isin(*SENTIMENTS), sentiment).otherwise("neutral").alias("sentiment"), kept.alias("aspects"))


def settle_sentiment(a: Column, b: Column) -> tuple[Column, Column]:
    """(sentiment or null for the judge, how): equal agree; neutral gives way; opposites go to the judge."""
    value = F.when(a == b, a).when(a == "neutral", b).when(b == "neutral", a)
    return value, F.when(a == b, "agree").when(value.isNotNull(), "sentiment_auto").otherwise("judge")


def settle_aspects(a: Column, b: Column) -> tuple[Column, Column]:
    """(aspects or null for the judge, how): equal agree; a set within the other gives the union; else the judge."""
    a_only, b_only = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    value = F.when((a_only == 0) | (b_only == 0), F.array_sort(F.array_union(a, b)))
    return value, F.when((a_only == 0) & (b_only == 0), "agree").when(value.isNotNull(), "union").otherwise("judge")


def reconcile_sentences(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: structs of parse_labels, null where a model failed) with outcome, sentiment, aspects, resolution.

    outcome: review if both models failed, drop if neither finds the sentence relevant, judge if only one has an answer or finds it
    relevant or their answers conflict, else final, by union, sentiment_auto or agree.
    """
    a, b = F.col("a"), F.col("b")
    sentiment, by_sentiment = settle_sentiment(a["sentiment"], b["sentiment"])
    aspects, by_aspects = settle_aspects(a["aspects"], b["aspects"])
    outcome = (
        F.when(a.isNull() & b.isNull(), "review")
        .when(a.isNull() | b.isNull(), "judge")
        .when(~a["relevant"] & ~b["relevant"], "drop")
        .when(a["relevant"] != b["relevant"], "judge")
        .when((by_sentiment == "judge") | (by_aspects == "judge"), "judge")
        .otherwise("final")
    )
    final = outcome == "final"
    how = F.when(by_aspects == "union", "union").when(by_sentiment == "sentiment_auto", "sentiment_auto").otherwise("agree")
    return pairs.withColumns({"outcome": outcome, "sentiment": F.when(final, sentiment), "aspects": F.when(final, aspects), "resolution": F.when(final, how)})
