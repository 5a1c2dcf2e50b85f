"""Aggregates behind dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import blank_to, percent_of, source_url

# The sentiments that are always shown.
SENTIMENTS = ("positive", "neutral", "negative")


def page(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of rows: limits under 1 are 100, over 1000 are 1000; offsets under 0 are 0."""
    limit = 100 if limit <= 0 else min(limit, 1000)
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def counts(df: DataFrame, column: str) -> DataFrame:
    """label, n: rows by value; null and blank are unknown."""
    return df.groupBy(blank_to(F.col(column)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def aspect_matrix(clauses: DataFrame) -> DataFrame:
    """aspect, sentiment, n, percent of the aspect: the three sentiments always, others where they occur."""
    found = clauses.groupBy(blank_to(F.col("aspect")).alias("aspect"), blank_to(F.col("sentiment")).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))
    fixed = found.select("aspect").distinct().select("aspect", F.explode(F.array(*[F.lit(s) for s in SENTIMENTS])).alias("sentiment"))
    full = fixed.join(found, ["aspect", "sentiment"], "full").select("aspect", "sentiment", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.withColumn("percent", percent_of(F.col("n"), F.sum("n").over(Window.partitionBy("aspect"))))


def with_clean(labels: DataFrame, clean: DataFrame) -> DataFrame:
    """labels with cleaned_text, source_url and source_row_index of their document, where it is there."""
    url = source_url(F.col("source_json")) if "source_json" in clean.columns else F.lit("")
    place = F.col("source_row_index") if "source_row_index" in clean.columns else F.lit(None).cast("long")
    mine = clean.select(F.col("row_id").alias("_r"), "cleaned_text", url.alias("source_url"), place.alias("source_row_index"))
    return labels.join(mine, labels["doc_id"] == F.col("_r"), "left").drop("_r")


def genuineness_view(labels: DataFrame, clean: DataFrame, *, genuineness: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of labels with their texts, by source order and id. Verified labels show final_label, and the judge's reason first."""
    if "final_label" in labels.columns:
        reasons = [F.col(f"{m}.reason") for m in ("judge_result", "model_a_result") if m in labels.columns]
        labels = labels.withColumn("genuineness", F.col("final_label")).withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")))
    rows = with_clean(labels, clean)
    rows = rows.where(F.col("genuineness") == genuineness) if genuineness else rows
    return page(rows, [F.asc_nulls_last("source_row_index"), F.asc_nulls_last("doc_id")], limit, offset)


def clause_view(clauses: DataFrame, clean: DataFrame, *, aspect: str | None = None, sentiment: str | None = None, only_review: bool = False, only_disputed: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of clauses (with clause_id) and their texts, filtered by equality; disputed means another resolution than agree."""
    rows = clauses
    for column, value in (("aspect", aspect), ("sentiment", sentiment)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where("needs_review = true") if only_review else rows
    rows = rows.where("resolution <> 'agree'") if only_disputed else rows
    return page(with_clean(rows, clean), [F.asc_nulls_last("doc_id"), F.asc_nulls_last("clause_id")], limit, offset)


def keyword_filter(keywords: DataFrame, *, aspect: str = "", sentiment: str = "", query: str = "") -> DataFrame:
    rows = keywords.where(F.col("aspect") == aspect) if aspect else keywords
    rows = rows.where(F.col("sentiment") == sentiment) if sentiment else rows
    pattern = "%" + query.replace("\\", "\\\\") + "%"
    return rows.where(F.col("keyword").ilike(pattern) | F.col("clause").ilike(pattern)) if query else rows


def keyword_totals(keywords: DataFrame) -> DataFrame:
    """One row: occurrences, unique_keywords, clause_ids, documents."""
    return keywords.agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("keyword").alias("unique_keywords"), F.countDistinct("clause_id").alias("clause_ids"), F.countDistinct("doc_id").alias("documents")
    )


#: What stands for a clause's text where rows are shuffled: 128 bits of hashes and its length. Texts themselves are moved once each.
MARK = ("_h", "_g", "_n")


def marked(keywords: DataFrame) -> DataFrame:
    c = F.col("clause")
    return keywords.where("keyword is not null").withColumns({"_h": F.xxhash64(c), "_g": F.xxhash64(F.lit(1), c), "_n": F.length(c)})


def keyword_table(keywords: DataFrame) -> DataFrame:
    """Per keyword: count, document_count, dominant_sentiment and its ratio, top_aspect, representative_clause (longest, then first).

    Dominant values are those with the most rows, ties by value, null last. What a keyword has in a document becomes one row, whose
    first entry counts the document; then rows are counts by keyword, sentiment and aspect, of which a keyword has few. Rows have the
    lengths of their clauses; only texts as long as a keyword's longest are looked up, by their marks.
    """
    rows = marked(keywords)
    longest = F.max("_n").alias("_n")
    in_doc = rows.groupBy("keyword", "doc_id").agg(F.collect_list(F.struct("sentiment", "aspect")).alias("all"), longest)
    entries = in_doc.select("keyword", F.col("doc_id").isNotNull().alias("is_doc"), "_n", F.posexplode("all").alias("i", "e"))
    cells = entries.groupBy("keyword", "e.sentiment", "e.aspect").agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("i") == 0) & F.col("is_doc"), 1)).alias("docs"), longest)
    out = cells.groupBy("keyword").agg(F.sum("n").alias("count"), F.sum("docs").alias("document_count"), longest, F.collect_list(F.struct("sentiment", "aspect", "n")).alias("cells"))
    best = rows.groupBy("keyword").agg(longest)
    tied = rows.select("keyword", *MARK).join(best, ["keyword", "_n"], "left_semi").distinct()
    texts = rows.select(*MARK, "clause").distinct()
    clause = tied.join(texts, list(MARK)).groupBy("keyword").agg(F.min("clause").alias("clause"))

    def most(name: str) -> Column:
        total = lambda v: F.aggregate(F.filter("cells", lambda c: c[name].eqNullSafe(v)), F.lit(0).cast("long"), lambda t, c: t + c["n"])
        values = F.array_distinct(F.transform("cells", lambda c: c[name]))
        return F.array_min(F.transform(values, lambda v: F.struct((-total(v)).alias("o"), v.isNull().alias("z"), v.alias("v"))))

    found = out.join(clause, "keyword", "left").withColumns({"s": most("sentiment"), "a": most("aspect")})
    ratio = F.round((-F.col("s.o")).cast("double") / F.col("count"), 4)
    return found.select("keyword", "count", "document_count", F.col("s.v").alias("dominant_sentiment"), ratio.alias("dominant_sentiment_ratio"), F.col("a.v").alias("top_aspect"), F.col("clause").alias("representative_clause"))


def clause_summary(clauses: DataFrame) -> DataFrame:
    """kind, label, n: the total, clauses by sentiment and aspect (null and blank are unknown), and, of verified clauses, by resolution
    and those that need review; one aggregate over grouping sets."""
    known = [c for c in ("sentiment", "aspect", "resolution") if c in clauses.columns]
    review = F.col("needs_review") == F.lit(True) if "needs_review" in clauses.columns else F.lit(False)
    rows = clauses.select(*[blank_to(F.col(c)).alias(c) for c in known], review.alias("review"))
    sets = rows.groupingSets([[], *[[c] for c in known]], *known).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("review"), 1)).alias("reviews"))
    all_bits = (1 << len(known)) - 1
    own = lambda k: all_bits - (1 << (len(known) - 1 - k))
    entry = lambda kind, label, n: F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"), n.alias("n"))
    whole = [entry("total", F.lit(None), F.col("n"))] + ([entry("needs_review", F.lit(None), F.col("reviews"))] if "needs_review" in clauses.columns else [])
    entries = F.when(F.col("g") == all_bits, F.array(*whole))
    for k, c in enumerate(known):
        entries = entries.when(F.col("g") == own(k), F.array(entry(c, F.col(c), F.col("n"))))
    return sets.select(F.explode(entries).alias("e")).select("e.*")


def top_keywords(keywords: DataFrame, sentiment: str, n: int = 5) -> DataFrame:
    rows = keywords.where((F.col("sentiment") == sentiment) & F.col("keyword").isNotNull())
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "keyword").limit(n)


def word_cloud(keywords: DataFrame, n: int = 30) -> DataFrame:
    """The top keywords of each aspect and of praise and blame, with count / highest count of theirs."""
    rows = keywords.where(F.col("sentiment").isin("positive", "negative") & F.col("keyword").isNotNull())
    found = rows.groupBy("aspect", "sentiment", "keyword").agg(F.count(F.lit(1)).alias("count"))
    group = Window.partitionBy("aspect", "sentiment")
    ranked = found.withColumn("rank", F.row_number().over(group.orderBy(F.desc("count"), "keyword"))).where(F.col("rank") <= n)
    ranked = ranked.withColumn("most", F.max("count").over(group))  # of the rows that are left: rank 1 is among them
    return ranked.select("aspect", "sentiment", "keyword", "count", F.round(F.col("count").cast("double") / F.col("most"), 4).alias("weight"))


def keywords_by_clause(keywords: DataFrame, *, query: str = "") -> DataFrame:
    """clause, keywords (array by rank, then word), keyword_count, occurrence_count (clause ids); equal clause texts are one.

    Rows are grouped by their clause's mark, which its text joins at the end.
    """
    rows = marked(keywords).where("clause is not null")
    mark = list(MARK)
    texts = rows.select(*mark, "clause")
    if query:
        hits = keyword_filter(rows, query=query).select(*mark, "clause").distinct()
        rows, texts = rows.join(hits.select(*mark), mark, "left_semi"), hits
    once = rows.groupBy(*mark, "keyword").agg(F.min("keyword_rank_in_clause").alias("rank"))
    listed = once.groupBy(*mark).agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    times = rows.groupBy(*mark).agg(F.countDistinct("clause_id").alias("occurrence_count"))
    found = listed.join(times, mark).join(texts.distinct(), mark)
    return found.select("clause", F.transform("k", lambda e: e["keyword"]).alias("keywords"), F.size("k").cast("long").alias("keyword_count"), "occurrence_count")


def compare_runs(a: DataFrame, b: DataFrame, label: str = "genuineness") -> DataFrame:
    """label_a, label_b, presence, n over the documents of two runs: in both, only in a, only in b."""
    both = a.select("doc_id", F.col(label).alias("label_a")).join(b.select("doc_id", F.col(label).alias("label_b")), "doc_id", "full")
    presence = F.when(F.col("label_a").isNotNull() & F.col("label_b").isNotNull(), "both").when(F.col("label_a").isNotNull(), "only_a").otherwise("only_b")
    return both.groupBy("label_a", "label_b", presence.alias("presence")).agg(F.count(F.lit(1)).alias("n"))


def patterns(a: DataFrame, b: DataFrame, label: str = "genuineness") -> DataFrame:
    """rank, label_a, label_b, n of the documents that two runs label differently, the most frequent first, ties by label."""
    both = compare_runs(a, b, label).where("presence = 'both' and label_a <> label_b").select("label_a", "label_b", "n")
    return both.select(F.row_number().over(Window.orderBy(F.desc("n"), "label_a", "label_b")).alias("rank"), "label_a", "label_b", "n")  # a row a pair of labels


def agreement(a: DataFrame, b: DataFrame, truth: DataFrame | None = None, label: str = "genuineness", enough: float = 0.85) -> DataFrame:
    """One row: compared, matched, agreement, accuracy_a, accuracy_b (against truth), verdict."""
    rows = a.select("doc_id", F.col(label).alias("x")).join(b.select("doc_id", F.col(label).alias("y")), "doc_id")
    if truth is not None:
        rows = rows.join(truth.select("doc_id", F.col(label).alias("t")), "doc_id", "left")
    else:
        rows = rows.withColumn("t", F.lit(None).cast("string"))
    share = lambda c: F.when(F.count("t") > 0, F.count(F.when(c == F.col("t"), 1)) / F.count("t"))
    out = rows.agg(
        F.count(F.lit(1)).alias("compared"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("matched"), share(F.col("x")).alias("accuracy_a"), share(F.col("y")).alias("accuracy_b")
    ).withColumn("agreement", F.when(F.col("compared") > 0, F.col("matched") / F.col("compared")).otherwise(0.0))
    verdict = F.when(F.col("accuracy_a").isNotNull(), "ground_truth").when(F.col("agreement") >= enough, "agreement_only").otherwise("review_needed")
    return out.withColumn("verdict", verdict)
