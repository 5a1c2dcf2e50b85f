"""From cleaned texts to labelled clauses: sentences, one or two models' labels, a judge for what they dispute, a row for each aspect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .asking import Ask, ask, ask_each
from .labels import SENTIMENTS, in_spans, parse_labels, reconcile_sentences

#: Fields of a classifier's and of a judge's answer.
LABEL = "relevant boolean, sentiment string, aspects array<string>, primary_area string"
VERDICT = "relevant boolean, sentiment string, aspects array<string>, chosen string, reason string"


def sentence_table(docs: DataFrame, *, spans: DataFrame | None = None, id_col: str = "row_id", text_col: str = "cleaned_text") -> DataFrame:
    """doc_id, sentence_index (from 1 in the document), sentence. With spans (doc_id, genuine_spans), of a document that has any only
    the sentences inside them; spans count sentences from 0, their end is exclusive."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.sentences(F.col(text_col))).alias("_at", "sentence"))
    if spans is not None:
        mine = spans.select(F.col("doc_id").alias("_id"), "genuine_spans")
        rows = rows.join(mine, F.col("doc_id") == F.col("_id"), "left").where(in_spans(F.col("_at"), F.col("genuine_spans")))
    return rows.select("doc_id", (F.col("_at") + 1).alias("sentence_index"), "sentence")


def label_sentences(
    sentences: DataFrame, classify: Ask, *, allowed: Sequence[str], fallback: str, areas: Sequence[str] = (), other_area: str = "etc", most_sentences: int = 40, most_chars: int = 12_000, name: str = "label"
) -> DataFrame:
    """sentences with <name>: relevant, sentiment, aspects, primary_area of each; null, with <name>_failure, where the model gave none.

    classify takes items with key and sentence, and answers with mappings of key and the fields of LABEL; calls hold sentences of
    many documents. Aspects that aren't allowed go, a relevant sentence without any has the fallback, an unknown sentiment is
    neutral. A blank area is null, an unknown one other_area.
    """
    return _labels(sentences, {name: classify}, allowed=allowed, fallback=fallback, areas=areas, other_area=other_area, most_sentences=most_sentences, most_chars=most_chars)


def _labels(sentences: DataFrame, models: Mapping[str, Ask], *, allowed: Sequence[str], fallback: str, areas: Sequence[str] = (), other_area: str = "etc", most_sentences: int = 40, most_chars: int = 12_000) -> DataFrame:
    asked = ask_each(sentences, models, LABEL, give=["sentence"], size_of="sentence", most_items=most_sentences, most_chars=most_chars)
    made = {}
    for name in models:
        raw = F.col(name)
        parsed = parse_labels(raw["relevant"], raw["sentiment"], raw["aspects"], allowed, fallback)
        area = F.trim(raw["primary_area"])
        known = F.when(area.isin(*areas), area).otherwise(F.lit(other_area)) if areas else area
        fields = [parsed[c].alias(c) for c in ("relevant", "sentiment", "aspects")]
        made[name] = F.when(raw.isNotNull(), F.struct(*fields, F.when(area != "", known).alias("primary_area")))
    return asked.withColumns(made)


def clause_rows(labelled: DataFrame, *, prompt_version: str, source: str, fallback: str, name: str = "label") -> DataFrame:
    """doc_id, sentence_index, clause, sentiment, aspect, prompt_version, source: a row for each aspect of each relevant sentence."""
    label = F.col(name)
    aspects = F.when(F.size(label["aspects"]) > 0, label["aspects"]).otherwise(F.array(F.lit(fallback)))
    rows = labelled.where(label["relevant"])
    return rows.select("doc_id", "sentence_index", F.col("sentence").alias("clause"), label["sentiment"].alias("sentiment"), F.explode(aspects).alias("aspect"), F.lit(prompt_version).alias("prompt_version"), F.lit(source).alias("source"))


def both_labels(sentences: DataFrame, model_a: Ask, model_b: Ask, **rules) -> DataFrame:
    """sentences with the labels a and b of two models (see label_sentences), asked one after the other with the same calls."""
    return _labels(sentences, {"a": model_a, "b": model_b}, **rules)


def _known(label: Column) -> Column:
    return F.coalesce(label["aspects"], F.array().cast("array<string>"))


def judge_sentences(pairs: DataFrame, judge: Ask, *, allowed: Sequence[str], most_disputed: int = 20, most_chars: int = 8_000, each_chars: int = 80) -> DataFrame:
    """pairs (doc_id, sentence_index, sentence, a, b) settled: outcome (final, drop, review), sentiment, aspects, resolution,
    needs_review, judge_result.

    What the models agree on, or what a rule settles, is final (see reconcile_sentences). The rest goes to the judge, in calls of at
    most most_disputed sentences and most_chars characters with each_chars for the candidates. Its items have key, sentence,
    candidate_1 and candidate_2; which model comes first depends on the id. A candidate is null where that model has no label. A
    sentence that the judge doesn't answer is for review, neutral, with the aspects of both. An irrelevant one is dropped. A verdict
    with an unknown aspect or sentiment, without an aspect, or with `chosen` 'review' is for review. Sentences that neither model
    labels are for review, too, as classify_missing.
    """
    rows = reconcile_sentences(pairs)
    disputed = F.col("outcome") == "judge"
    first_a = tx.parity(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("sentence_index").cast("string"))) == 0
    bare = lambda m: F.when(F.col(m).isNotNull(), F.struct(*[F.col(m)[c].alias(c) for c in ("relevant", "sentiment", "aspects")]))
    rows = rows.withColumns({"_disputed": disputed, "candidate_1": F.when(disputed, F.when(first_a, bare("a")).otherwise(bare("b"))), "candidate_2": F.when(disputed, F.when(first_a, bare("b")).otherwise(bare("a")))})
    asked = ask(rows, judge, VERDICT, give=["sentence", "candidate_1", "candidate_2"], size_of="sentence", most_items=most_disputed, most_chars=most_chars, each_chars=each_chars, wanted="_disputed", name="judge_result", drop=["candidate_1", "candidate_2"])
    said = F.col("judge_result")
    given = F.transform(_known(said), lambda x: F.trim(x))
    good = F.array_intersect(given, F.array(*[F.lit(x) for x in allowed]))
    mood = F.trim(F.coalesce(said["sentiment"], F.lit("neutral")))
    odd = (F.size(F.array_except(given, good)) > 0) | ~mood.isin(*SENTIMENTS) | (F.coalesce(F.trim(said["chosen"]), F.lit("")) == "review")
    relevant = F.coalesce(said["relevant"], F.lit(False))
    sure = ~odd & (F.size(good) > 0)
    outcome = F.when(~disputed, F.col("outcome")).when(said.isNull(), "review").when(~relevant, "drop").when(sure, "final").otherwise("review")
    settled = asked.withColumns(
        {
            "sentiment": F.when(~disputed, F.col("sentiment")).when(said.isNull() | ~mood.isin(*SENTIMENTS), "neutral").otherwise(mood),
            "aspects": F.when(~disputed, F.col("aspects")).when(said.isNull(), F.array_sort(F.array_union(_known(F.col("a")), _known(F.col("b"))))).otherwise(good),
            "resolution": F.when(F.col("outcome") == "review", "classify_missing").when(~disputed, F.col("resolution")).when(said.isNotNull() & (sure | ~relevant), "judge").otherwise("needs_review"),
            "outcome": outcome,
            "needs_review": outcome == "review",
        }
    )
    return settled.drop("_disputed")


def verified_clauses(settled: DataFrame, *, fallback: str, prompt_version: str) -> DataFrame:
    """Clauses of judged sentences: a row for each aspect of all but dropped ones, with resolution, needs_review and the three answers.

    Sentences without an aspect have the fallback; those that no model labelled have no row.
    """
    rows = settled.where(F.col("outcome").isin("final", "review") & (F.col("resolution") != "classify_missing"))
    aspects = F.when(F.size("aspects") > 0, F.col("aspects")).otherwise(F.array(F.lit(fallback)))
    kept = ["resolution", "needs_review", F.col("a").alias("model_a_result"), F.col("b").alias("model_b_result"), "judge_result"]
    return rows.select("doc_id", "sentence_index", F.col("sentence").alias("clause"), "sentiment", F.explode(aspects).alias("aspect"), *kept, F.lit(prompt_version).alias("prompt_version"), F.lit("verify").alias("source"))


def area_agreement(clauses: DataFrame, *, top: int = 10, overall: str = "overall") -> DataFrame:
    """One row: both_count, agree_count, agreement_rate, overall_ratio_a, distribution_model_a and confusion_top, from verified clauses.

    Each sentence counts once, if both models gave it an area. The distribution is of model a's areas; confusions are unordered pairs
    of different areas, the `top` most frequent, ties by name. One grouping-sets aggregate counts all three; rates are null of nothing.
    """
    area = lambda m: F.col(f"model_{m}_result.primary_area")
    first = clauses.groupBy("doc_id", "sentence_index").agg(F.min_by(F.struct(area("a").alias("a"), area("b").alias("b")), "aspect").alias("p")).select("p.a", "p.b")
    both = first.where((F.col("a") != "") & (F.col("b") != "")).withColumn("pair", F.when(F.col("a") != F.col("b"), F.concat(F.least("a", "b"), F.lit("↔"), F.greatest("a", "b"))))
    sets = both.groupingSets([[], ["a"], ["pair"]], "a", "pair").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    listed = lambda g, name: F.collect_list(F.when((F.col("g") == g) & F.col(name).isNotNull(), F.struct(F.col(name).alias("label"), "n")))
    out = sets.agg(F.sum(F.when(F.col("g") == 3, F.col("n"))).alias("both_count"), listed(1, "a").alias("areas"), listed(2, "pair").alias("pairs"))
    most_first = lambda c: F.array_sort(c, lambda x, y: F.when(x["n"] != y["n"], F.signum(y["n"] - x["n"]).cast("int")).when(x["label"] < y["label"], -1).otherwise(1))
    of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, e: t + e["n"])
    n = F.coalesce("both_count", F.lit(0))
    agree = n - of(F.col("pairs"))
    share = lambda part: F.when(n > 0, F.round(part / n, 4))
    return out.select(
        n.alias("both_count"),
        agree.alias("agree_count"),
        share(agree).alias("agreement_rate"),
        share(of(F.filter("areas", lambda e: e["label"] == overall))).alias("overall_ratio_a"),
        most_first(F.col("areas")).alias("distribution_model_a"),
        F.slice(most_first(F.col("pairs")), 1, top).alias("confusion_top"),
    )
