"""Registered queries of the labelling stages. Models are planted: their answers follow from a sentence's length, in Python and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build
from .planted import grade, judge, model_a, model_b
from .views import dashboards
from .workload import LISTED, ORACLE, clean_rows, register, table

ASPECTS = ("food", "place", "price")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.sentence_table(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


RULES = {"allowed": ASPECTS, "fallback": "general", "areas": ("overall", "service", "staff")}
SENTENCES = f"listed AS (SELECT doc_id, {LISTED.format(c='text')} AS ss FROM documents), sentences AS (SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, ss[i] AS sentence, length(ss[i]) AS n FROM listed, unnest(range(1, len(ss) + 1)) u(i))"


def _label(skip: int, off: int, mood: str, aspects: str, area: str) -> str:
    relevant = f"n % {off} <> 1"
    parsed = f"CASE WHEN NOT {relevant} THEN [] WHEN len({aspects}) = 0 THEN ['general'] ELSE {aspects} END"
    return f"CASE WHEN n % {skip} <> 0 THEN {{'relevant': {relevant}, 'sentiment': {mood}, 'aspects': {parsed}, 'primary_area': {area}}} END"


A = _label(
    11,
    5,
    "['positive', 'neutral', 'negative', 'neutral'][n % 4 + 1]",
    "list_filter([CASE WHEN n % 3 = 0 THEN 'food' END, CASE WHEN n % 2 = 0 THEN 'place' END], lambda x: x IS NOT NULL)",
    "CASE n % 4 WHEN 0 THEN 'overall' WHEN 1 THEN 'service' WHEN 3 THEN 'etc' END",
)
B = _label(
    13,
    7,
    "['positive', 'neutral', 'negative', 'negative'][n // 4 % 4 + 1]",
    "list_filter([CASE WHEN n % 3 = 0 THEN 'food' END, CASE WHEN n % 4 = 0 THEN 'price' END], lambda x: x IS NOT NULL)",
    "['overall', 'staff', 'service'][n % 3 + 1]",
)

register(
    "document_labels",
    """SELECT doc_id, CASE WHEN n % 7 = 0 THEN 'uncertain' ELSE ['genuine_review', 'uncertain', 'non_review'][n % 3 + 1] END AS label,
              CASE WHEN n % 7 = 0 THEN 'failed: ConnectionError' WHEN n % 3 = 2 THEN 'unparsed' ELSE '' END AS reason FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)""",
)(lambda s, d: build.label_texts(table(s, d, "documents"), grade, batch=1))
register(
    "clause_labels",
    f"""WITH {SENTENCES}, labelled AS (SELECT *, {A} AS a FROM sentences)
    SELECT doc_id, sentence_index, sentence AS clause, a.sentiment AS sentiment, unnest(a.aspects) AS aspect, 'p1' AS prompt_version, 'planted' AS source FROM labelled WHERE a.relevant""",
)(lambda s, d: build.clause_rows(build.label_sentences(sentences(s, d), model_a, **RULES), prompt_version="p1", source="planted", fallback="general"))
register("label_failures", f"WITH {SENTENCES} SELECT 'missing' AS failure, count(*) AS n FROM sentences WHERE n % 11 = 0 HAVING count(*) > 0")(
    lambda s, d: build.failure_counts(build.label_sentences(sentences(s, d), model_a, **RULES), "label")
)


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = build.both_labels(sentences(spark, sf_dir), model_a, model_b, **RULES)
    return build.verified_clauses(build.judge_sentences(pairs, judge, allowed=ASPECTS), fallback="general", prompt_version="p1")


VERIFIED = f"""{SENTENCES}, pairs AS (SELECT *, {A} AS a, {B} AS b FROM sentences
), sorted AS (
  SELECT *, CASE WHEN a.sentiment = b.sentiment THEN a.sentiment WHEN a.sentiment = 'neutral' THEN b.sentiment WHEN b.sentiment = 'neutral' THEN a.sentiment END AS mood,
         len(list_filter(a.aspects, lambda x: NOT list_contains(b.aspects, x))) AS only_a, len(list_filter(b.aspects, lambda x: NOT list_contains(a.aspects, x))) AS only_b,
         list_sort(list_distinct(list_concat(coalesce(a.aspects, []), coalesce(b.aspects, [])))) AS all_aspects,
         ['negative', 'mixed', 'positive'][n % 3 + 1] AS said, CASE WHEN n % 10 = 5 THEN [] WHEN n % 10 = 0 THEN ['food'] ELSE ['place'] END AS told
  FROM pairs
), ruled AS (
  SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN a IS NULL OR b IS NULL THEN 'judge' WHEN NOT a.relevant AND NOT b.relevant THEN 'drop'
            WHEN a.relevant <> b.relevant OR mood IS NULL OR (only_a > 0 AND only_b > 0) THEN 'judge' ELSE 'final' END AS rule FROM sorted
), settled AS (
  SELECT *, CASE WHEN rule <> 'judge' THEN rule WHEN n % 6 = 0 THEN 'silent' WHEN n % 9 = 0 THEN 'drop' WHEN n % 10 IN (0, 5) OR said = 'mixed' OR n % 17 = 0 THEN 'unsure' ELSE 'judged' END AS how FROM ruled
), clauses AS (
  SELECT doc_id, sentence_index, sentence AS clause, a.primary_area AS pa, b.primary_area AS pb,
         CASE how WHEN 'final' THEN mood WHEN 'silent' THEN 'neutral' ELSE replace(said, 'mixed', 'neutral') END AS sentiment,
         CASE how WHEN 'final' THEN CASE WHEN only_a + only_b > 0 THEN 'union' WHEN a.sentiment <> b.sentiment THEN 'sentiment_auto' ELSE 'agree' END WHEN 'judged' THEN 'judge' ELSE 'needs_review' END AS resolution,
         how IN ('silent', 'unsure') AS needs_review, CASE WHEN how IN ('final', 'silent') THEN all_aspects ELSE told END AS aspects
  FROM settled WHERE how NOT IN ('none', 'drop')
), verified AS (
  SELECT doc_id, sentence_index, clause, sentiment, resolution, needs_review, pa, pb, unnest(CASE WHEN len(aspects) = 0 THEN ['general'] ELSE aspects END) AS aspect FROM clauses
)"""
register("verified_clauses", f"WITH {VERIFIED} SELECT doc_id, sentence_index, clause, sentiment, aspect, resolution, needs_review FROM verified")(
    lambda s, d: verified(s, d).select("doc_id", "sentence_index", "clause", "sentiment", "aspect", "resolution", "needs_review")
)
register(
    "verified_summary",
    f"""WITH {VERIFIED} SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS label, count(*) AS n FROM verified UNION ALL SELECT 'needs_review', NULL, count(*) FILTER (WHERE needs_review) FROM verified
    UNION ALL SELECT 'sentiment', sentiment, count(*) FROM verified GROUP BY 2 UNION ALL SELECT 'aspect', aspect, count(*) FROM verified GROUP BY 2 UNION ALL SELECT 'resolution', resolution, count(*) FROM verified GROUP BY 2""",
)(lambda s, d: dashboards.clause_summary(verified(s, d)))
register(
    "review_page",
    f"""WITH {VERIFIED}, ids AS (SELECT *, CAST(doc_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index * 10 + CASE aspect WHEN 'food' THEN 1 WHEN 'general' THEN 2 WHEN 'place' THEN 3 ELSE 4 END) - 1 AS VARCHAR) AS clause_id FROM verified)
    SELECT doc_id, clause_id, aspect, resolution, needs_review FROM ids WHERE sentiment = 'negative' AND needs_review AND resolution <> 'agree' ORDER BY doc_id NULLS LAST, clause_id NULLS LAST LIMIT 40 OFFSET 20""",
)(
    lambda s, d: dashboards.clause_view(
        build.clause_ids(verified(s, d).withColumn("place", F.col("sentence_index") * 10 + F.array_position(F.array(*map(F.lit, ("food", "general", "place", "price"))), F.col("aspect"))), ordinal="place"),
        clean_rows(s, d),
        sentiment="negative",
        only_review=True,
        only_disputed=True,
        limit=40,
        offset=20,
    ).select("doc_id", "clause_id", "aspect", "resolution", "needs_review")
)


def chunk_labels(spark: SparkSession, sf_dir: str, by: int) -> DataFrame:
    """Chunks of documents with a label by their length."""
    chunks = build.chunk_sentences(table(spark, sf_dir, "documents"), most_sentences=8, most_chars=600)
    label = F.element_at(F.array(*map(F.lit, ("genuine_review", "uncertain", "non_review"))), (F.length("chunk") % by % 3 + 1).cast("int"))
    return chunks.select("doc_id", "chunk_index", "sentence_start", "sentence_end", label.alias("label"))


def spans_text(c):
    return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["sentence_start"].cast("string"), s["sentence_end"].cast("string"))), "|")


_TIERS = "['genuine_review', 'uncertain', 'non_review']"
CHUNK_LABELS = f"chunks AS ({ORACLE['sentence_chunks']}), labelled AS (SELECT *, {_TIERS}[length(chunk) % 3 + 1] AS label, {_TIERS}[length(chunk) % 4 % 3 + 1] AS other FROM chunks)"
register(
    "combined_chunks",
    f"""WITH {CHUNK_LABELS} SELECT doc_id, CASE WHEN bool_or(label = 'genuine_review') THEN 'genuine_review' WHEN bool_or(label = 'uncertain') THEN 'uncertain' ELSE 'non_review' END AS label,
      coalesce(string_agg(sentence_start || '-' || sentence_end, '|' ORDER BY chunk_index) FILTER (WHERE label = 'genuine_review'), '') AS spans FROM labelled GROUP BY doc_id""",
)(lambda s, d: build.combine_chunks(chunk_labels(s, d, 3)).select("doc_id", "label", spans_text(F.col("genuine_spans")).alias("spans")))
register(
    "union_spans",
    f"""WITH {CHUNK_LABELS}, u AS (SELECT DISTINCT doc_id, sentence_start, sentence_end FROM labelled WHERE label = 'genuine_review' OR other = 'genuine_review')
    SELECT doc_id, coalesce(string_agg(sentence_start || '-' || sentence_end, '|' ORDER BY sentence_start, sentence_end), '') AS spans FROM (SELECT DISTINCT doc_id FROM chunks) LEFT JOIN u USING (doc_id) GROUP BY doc_id""",
)(
    lambda s, d: build.combine_chunks(chunk_labels(s, d, 3))
    .select("doc_id", F.col("genuine_spans").alias("a"))
    .join(build.combine_chunks(chunk_labels(s, d, 4)).select("doc_id", F.col("genuine_spans").alias("b")), "doc_id")
    .select("doc_id", spans_text(build.union_spans(F.col("a"), F.col("b"))).alias("spans"))
)
register(
    "span_sentences",
    f"""WITH {CHUNK_LABELS}, {SENTENCES}, g AS (SELECT doc_id, sentence_start AS s, sentence_end AS e FROM labelled WHERE label = 'genuine_review'),
    kept AS (SELECT doc_id, sentence_index FROM sentences WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION SELECT sentences.doc_id, sentence_index FROM sentences JOIN g ON g.doc_id = sentences.doc_id AND sentence_index - 1 >= s AND sentence_index - 1 < e)
    SELECT doc_id, count(*) AS n, CAST(sum(sentence_index) AS BIGINT) AS places FROM kept GROUP BY doc_id""",
)(
    lambda s, d: build.sentence_table(table(s, d, "documents"), spans=build.combine_chunks(chunk_labels(s, d, 3)), id_col="doc_id", text_col="text")
    .groupBy("doc_id")
    .agg(F.count(F.lit(1)).alias("n"), F.sum("sentence_index").alias("places"))
)


def flat(c: str):
    return F.array_join(F.transform(F.col(c), lambda e: F.concat_ws("=", e["label"], e["n"].cast("string"))), "|").alias(c)


register(
    "area_agreement",
    f"""WITH {VERIFIED}, once AS (SELECT DISTINCT doc_id, sentence_index, pa, pb FROM verified WHERE pa <> '' AND pb <> ''),
    areas AS (SELECT pa AS label, count(*) AS n FROM once GROUP BY 1), pairs_of AS (SELECT least(pa, pb) || '↔' || greatest(pa, pb) AS label, count(*) AS n FROM once WHERE pa <> pb GROUP BY 1)
    SELECT count(*) AS both_count, count(*) FILTER (WHERE pa = pb) AS agree_count, round(count(*) FILTER (WHERE pa = pb) / count(*), 4) AS agreement_rate, round(count(*) FILTER (WHERE pa = 'overall') / count(*), 4) AS overall_ratio_a,
           (SELECT string_agg(label || '=' || n, '|' ORDER BY n DESC, label) FROM areas) AS distribution_model_a,
           (SELECT string_agg(label || '=' || n, '|' ORDER BY n DESC, label) FROM (SELECT * FROM pairs_of ORDER BY n DESC, label LIMIT 10)) AS confusion_top FROM once""",
)(lambda s, d: build.area_agreement(verified(s, d)).select("both_count", "agree_count", "agreement_rate", "overall_ratio_a", flat("distribution_model_a"), flat("confusion_top")))
