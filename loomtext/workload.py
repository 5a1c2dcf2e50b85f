"""Registered queries over the given tables, and the SQL that must agree with them.

The tables stand in for those of a review analysis: documents for docs (created_at is derived from doc_id), labels for document
labels, conversations for clauses (role is the aspect, the length of the text gives a sentiment), tokens of clauses for keywords.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build, operators
from .catalog import Catalog
from .functions import text as tx
from .functions import values as vx
from .operators import search
from .plans.run import frame
from .views import dashboards, exports, overlay, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stand-ins, each in Spark and in SQL.


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int))")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"), day.alias("created_at"), "lang", "source", "n_chars")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("toxic") == 1, "non_review").when(F.col("quality") == 1, "genuine_review").otherwise("uncertain")
    return table(spark, sf_dir, "labels").select("doc_id", tier.alias("genuineness"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("reason"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = F.element_at(F.array(F.lit("positive"), F.lit("neutral"), F.lit("negative")), F.length("text") % 3 + 1)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("text").alias("clause"), mood.alias("sentiment"), F.col("role").alias("aspect"), F.lit("p1").alias("prompt_version"), F.lit("turns").alias("source"), "turn"
    )


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.clause_keywords(build.clause_ids(clauses(spark, sf_dir)))


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a cleaned table keyed like labels."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("cleaned_text"), F.col("doc_id").alias("source_row_index"), F.to_json(F.struct("lang", "source")).alias("source_json"))


WORDS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
ENDS = ", ".join(f"'{p}'" for p in tx.PARTICLES)
CUT = f"CASE WHEN length(t) >= 3 AND right(t, 1) IN ({ENDS}) THEN left(t, length(t) - 1) ELSE t END"
DOCS = "docs AS (SELECT doc_id, text AS raw_text, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS created_at, lang, source, n_chars FROM documents)"
LABELS = "label_rows AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'non_review' WHEN quality = 1 THEN 'genuine_review' ELSE 'uncertain' END AS genuineness, 'q' || CAST(quality AS VARCHAR) AS reason FROM labels)"
CLAUSES = "clauses AS (SELECT conv_id AS doc_id, text AS clause, ['positive', 'neutral', 'negative'][CAST(length(text) % 3 AS INTEGER) + 1] AS sentiment, role AS aspect, 'p1' AS prompt_version, 'turns' AS source, turn FROM conversations)"
CLAUSE_IDS = CLAUSES + ", clause_ids AS (SELECT *, CAST(doc_id AS VARCHAR) || '__' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY clause NULLS LAST, source NULLS LAST, prompt_version NULLS LAST) AS VARCHAR) AS clause_id FROM clauses)"
KEYWORDS = (
    CLAUSE_IDS
    + f""", good AS (
      SELECT *, list_distinct_ordered AS words FROM (
        SELECT *, list_filter([{CUT} FOR t IN regexp_extract_all(lower(clause), '[0-9A-Za-z가-힣]{{2,}}')], lambda t: t NOT IN ({WORDS}) AND length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')) AS list_distinct_ordered
        FROM clause_ids)
    ), firsts AS (
      SELECT doc_id, clause_id, clause, aspect, sentiment, source, word AS keyword, min(i) AS i
      FROM (SELECT *, words[i] AS word FROM good, unnest(range(1, len(words) + 1)) u(i)) GROUP BY ALL
    ), keyword_rows AS (
      SELECT doc_id, clause_id, clause, aspect, sentiment, keyword, source, CAST(row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY i) AS INTEGER) AS keyword_rank_in_clause FROM firsts
    )"""
)
CLEAN = """clean_rows AS (SELECT doc_id AS row_id, text AS cleaned_text, doc_id AS source_row_index FROM documents)"""


# Filters (FLT) and plans of one step.


def planned(tables: dict[str, Query], *steps: dict[str, Any]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog.of({name: make(spark, sf_dir) for name, make in tables.items()})
        return frame({"plan_version": "v2", "steps": list(steps)}, catalog)

    return run


def given(name: str) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, name)


def docs_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label, null where there is none."""
    return operators.join(docs(spark, sf_dir).drop("raw_text"), labels(spark, sf_dir), ["doc_id"], "left")


LABELLED = f"{DOCS}, {LABELS}, labelled AS (SELECT docs.doc_id, created_at, lang, source, n_chars, genuineness, reason FROM docs LEFT JOIN label_rows USING (doc_id))"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"

FILTERS: tuple[tuple[str, str, str, Any, str], ...] = (
    ("flt_eq", "o_orderstatus", "eq", "F", "o_orderstatus = 'F'"),
    ("flt_neq", "o_orderstatus", "neq", "F", "o_orderstatus <> 'F'"),
    ("flt_gt", "o_totalprice", "gt", 200000.0, "o_totalprice > 200000.0"),
    ("flt_gte", "o_custkey", "gte", 700, "o_custkey >= 700"),
    ("flt_lt", "o_totalprice", "lt", 50000.0, "o_totalprice < 50000.0"),
    ("flt_lte", "o_custkey", "lte", 100, "o_custkey <= 100"),
    ("flt_in", "o_orderpriority", "in", ["1-URGENT", "2-HIGH"], "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("flt_not_in", "o_orderstatus", "not_in", ["F", "O"], "o_orderstatus NOT IN ('F', 'O')"),
    ("flt_between", "o_totalprice", "between", [1000.0, 150000.0], "o_totalprice BETWEEN 1000.0 AND 150000.0"),
    ("flt_contains", "o_orderpriority", "contains", "-_I", "o_orderpriority LIKE '%-_I%'"),
    ("flt_typed_cast", "o_orderdate", "gte", "1996-06-01", "o_orderdate >= CAST('1996-06-01' AS TIMESTAMP)"),
)
for _name, _column, _how, _value, _where in FILTERS:
    register(_name, f"SELECT {ORDER_COLUMNS} FROM orders WHERE {_where}")(
        planned(
            {"orders": given("orders")},
            {"id": "f", "skill": "filter", "params": {"input": "orders", "column": _column, "operator": _how, "value": _value}},
            {"id": "p", "skill": "present", "params": {"input": "f", "columns": ORDER_COLUMNS.split(", ")}},
        )
    )
for _name, _how, _where in (("flt_is_null", "is_null", "genuineness IS NULL"), ("flt_not_null", "not_null", "genuineness IS NOT NULL")):
    register(_name, f"WITH {LABELLED} SELECT doc_id, lang, genuineness FROM labelled WHERE {_where}")(
        planned(
            {"labelled": docs_with_labels},
            {"id": "f", "skill": "filter", "params": {"input": "labelled", "column": "genuineness", "operator": _how}},
            {"id": "p", "skill": "present", "params": {"input": "f", "columns": ["doc_id", "lang", "genuineness"]}},
        )
    )


# Aggregation (AGG-01..08).

METRICS = (
    ("agg_count_star", {"name": "n", "function": "count", "column": "*"}, "count(*)"),
    ("agg_count_col", {"name": "n", "function": "count", "column": "genuineness"}, "count(genuineness)"),
    ("agg_sum", {"name": "n", "function": "sum", "column": "n_chars"}, "CAST(sum(n_chars) AS BIGINT)"),
    ("agg_avg", {"name": "n", "function": "avg", "column": "n_chars"}, "avg(n_chars)"),
    ("agg_min", {"name": "n", "function": "min", "column": "n_chars"}, "min(n_chars)"),
    ("agg_max", {"name": "n", "function": "max", "column": "created_at"}, "max(created_at)"),
)
for _name, _metric, _sql in METRICS:
    register(_name, f"WITH {LABELLED} SELECT lang, {_sql} AS n FROM labelled GROUP BY lang")(
        planned({"labelled": docs_with_labels}, {"id": "a", "skill": "aggregate", "params": {"input": "labelled", "group_by": ["lang"], "metrics": [_metric]}})
    )
register("agg_total", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_quantity) AS m FROM lineitem WHERE l_quantity > 1000")(
    planned(
        {"lineitem": given("lineitem")},
        {"id": "f", "skill": "filter", "params": {"input": "lineitem", "column": "l_quantity", "operator": "gt", "value": 1000}},
        {
            "id": "a",
            "skill": "aggregate",
            "params": {"input": "f", "group_by": [], "metrics": [{"name": "n", "function": "count"}, {"name": "s", "function": "sum", "column": "l_linenumber"}, {"name": "m", "function": "max", "column": "l_quantity"}]},
        },
    )
)
register(
    "agg_multi",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(l_quantity) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL",
)(
    planned(
        {"lineitem": given("lineitem")},
        {
            "id": "a",
            "skill": "aggregate",
            "params": {
                "input": "lineitem",
                "group_by": ["l_returnflag", "l_linestatus"],
                "metrics": [
                    {"name": "n", "function": "count", "column": "*"},
                    {"name": "lines", "function": "sum", "column": "l_linenumber"},
                    {"name": "least", "function": "min", "column": "l_quantity"},
                    {"name": "most", "function": "max", "column": "l_extendedprice"},
                ],
            },
        },
    )
)


# Joins and comparison (JON).

for _name, _how, _sql in (("join_inner", "inner", "JOIN"), ("join_left", "left", "LEFT JOIN"), ("join_right", "right", "RIGHT JOIN"), ("join_outer", "outer", "FULL JOIN")):
    register(
        _name,
        f"""WITH {DOCS}, {LABELS}, l AS (SELECT doc_id, lang, source FROM docs WHERE n_chars > 1000), r AS (SELECT doc_id, reason AS source, genuineness FROM label_rows)
        SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, l.lang, l.source, r.source AS right_source, r.genuineness FROM l {_sql} r ON l.doc_id = r.doc_id""",
    )(
        planned(
            {"l": lambda s, d: docs(s, d).where("n_chars > 1000").select("doc_id", "lang", "source"), "r": lambda s, d: labels(s, d).select("doc_id", F.col("reason").alias("source"), "genuineness")},
            {"id": "j", "skill": "join", "params": {"left": "l", "right": "r", "on": ["doc_id"], "how": _how}},
        )
    )


def count_by(source: str, name: str, groups: list[str]) -> dict[str, Any]:
    return {"id": name, "skill": "aggregate", "params": {"input": source, "group_by": groups, "metrics": [{"name": "count", "function": "count", "column": "*"}]}}


register(
    "compare_keyed",
    """WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE value > 90 GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1)
    SELECT coalesce(a.event_type, b.event_type) AS event_type, a.n AS high_count, b.n AS rest_count FROM a FULL JOIN b ON a.event_type = b.event_type""",
)(
    planned(
        {"events": given("events")},
        {"id": "h", "skill": "filter", "params": {"input": "events", "column": "value", "operator": "gt", "value": 90}},
        {"id": "o", "skill": "filter", "params": {"input": "events", "column": "event_type", "operator": "neq", "value": "click"}},
        count_by("h", "hc", ["event_type"]),
        count_by("o", "oc", ["event_type"]),
        {"id": "c", "skill": "compare", "params": {"left": "hc", "right": "oc", "join_key": ["event_type"], "left_label": "high", "right_label": "rest"}},
    )
)
register("compare_scalar", "SELECT (SELECT count(*) FROM clauses) AS all_count, (SELECT count(*) FROM clauses WHERE sentiment = 'positive') AS positive_count".replace("SELECT (", f"WITH {CLAUSES} SELECT (", 1))(
    planned(
        {"clauses": lambda s, d: build.clause_ids(clauses(s, d))},
        count_by("clauses", "every", []),
        {"id": "pos", "skill": "filter", "params": {"input": "clauses", "column": "sentiment", "operator": "eq", "value": "positive"}},
        count_by("pos", "good", []),
        {"id": "c", "skill": "compare", "params": {"left": "every", "right": "good", "join_key": [], "left_label": "all", "right_label": "positive"}},
    )
)


# Calculation (CAL).


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: orders, and orders that are urgent (null where there are none)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urgent"), (F.count(F.when(F.col("o_orderstatus") == "F", 1))).alias("done"))


SUMS = "sums AS (SELECT o_custkey, count(*) AS n, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS BIGINT) AS urgent, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done FROM orders GROUP BY 1)"
CALCULATIONS = (
    ("calc_add", {"operation": "add", "left": "n", "right": "urgent"}, "coalesce(n, 0) + coalesce(urgent, 0)"),
    ("calc_subtract", {"operation": "subtract", "left": "done", "right": "urgent"}, "coalesce(done, 0) - coalesce(urgent, 0)"),
    ("calc_multiply", {"operation": "multiply", "left": "n", "right": "urgent"}, "n * urgent"),
    ("calc_divide", {"operation": "divide", "left": "n", "right": "done"}, "CASE WHEN done IS NULL OR done = 0 THEN NULL ELSE CAST(n AS DOUBLE) / CAST(done AS DOUBLE) END"),
    ("calc_percent_change", {"operation": "percent_change", "base": "done", "current": "urgent"}, "CASE WHEN done IS NULL OR done = 0 THEN NULL ELSE CAST(coalesce(urgent, 0) - done AS DOUBLE) * 100.0 / CAST(done AS DOUBLE) END"),
    ("calc_ratio", {"operation": "ratio", "numerator": "urgent", "denominator": "n"}, "CASE WHEN n = 0 THEN NULL ELSE CAST(urgent AS DOUBLE) / CAST(n AS DOUBLE) END"),
    ("calc_share", {"operation": "share_of_total", "value": "n"}, "CAST(n AS DOUBLE) / CAST(nullif(sum(n) OVER (), 0) AS DOUBLE)"),
    ("calc_share_partition", {"operation": "share_of_total", "value": "n", "partition_by": ["done"]}, "CAST(n AS DOUBLE) / CAST(nullif(sum(n) OVER (PARTITION BY done), 0) AS DOUBLE)"),
)
for _name, _expression, _sql in CALCULATIONS:
    register(_name, f"WITH {SUMS} SELECT o_custkey, n, urgent, done, {_sql} AS x FROM sums")(
        planned({"sums": sums}, {"id": "c", "skill": "calculate", "params": {"input": "sums", "expressions": [{"name": "x", **_expression}]}})
    )


# Sorting (SRT): top-k results with ties broken by a key.

register("sort_desc", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 50")(
    planned({"orders": given("orders")}, {"id": "s", "skill": "sort", "params": {"input": "orders", "by": ["o_custkey", "o_orderkey"], "order": "desc", "limit": 50}}, {"id": "p", "skill": "present", "params": {"input": "s", "columns": ["o_custkey", "o_orderkey"]}})
)
register("sort_asc_nulls", f"WITH {LABELLED} SELECT doc_id, genuineness FROM labelled ORDER BY genuineness NULLS LAST, doc_id LIMIT 100")(
    planned({"labelled": docs_with_labels}, {"id": "s", "skill": "sort", "params": {"input": "labelled", "by": ["genuineness", "doc_id"], "order": "asc", "limit": 100}}, {"id": "p", "skill": "present", "params": {"input": "s", "columns": ["doc_id", "genuineness"]}})
)
register("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 25 OFFSET 40")(
    lambda s, d: dashboards.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.asc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")], 25, 40)
)


# Recipes (RCP).


def recipe(name: str, source: str, make: Query, sql: str, **params: Any) -> None:
    skill = params.pop("skill", name)
    register(name, sql)(planned({source: make}, {"id": "r", "skill": skill, "params": {"input": source, **params}}))


recipe("distribution", "docs", lambda s, d: docs(s, d).drop("raw_text"), "SELECT lang, count(*) AS count, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS ratio FROM documents GROUP BY lang", group_by=["lang"])
recipe(
    "event_window_count",
    "docs",
    lambda s, d: docs(s, d).drop("raw_text"),
    f"WITH {DOCS} SELECT created_at, count(*) AS count FROM docs WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-19' GROUP BY 1",
    event_date="2024-01-11",
    before_days=3,
)
recipe(
    "top_n",
    "orders",
    given("orders"),
    "SELECT o_custkey, count(*) AS count FROM orders WHERE o_totalprice >= 1000 GROUP BY 1 ORDER BY count DESC, o_custkey DESC LIMIT 15",
    group_by=["o_custkey"],
    filters=[{"column": "o_totalprice", "op": ">=", "value": 1000}],
    limit=15,
)
recipe(
    "sample_rows",
    "docs",
    docs,
    f"WITH {DOCS} SELECT lang, source, n_chars FROM docs WHERE lang = 'en' ORDER BY doc_id, lang, source, n_chars LIMIT 10",
    columns=["lang", "source", "n_chars"],
    filters=[{"column": "lang", "op": "eq", "value": "en"}],
)
PERIODS = {"date_column": "ts", "period_a": {"start": "2024-01-01", "end": "2024-01-15"}, "period_b": {"start": "2024-01-15", "end": "2024-01-29"}}
A_PART, B_PART = ("SELECT {g} count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '" + a + "' AND TIMESTAMP '" + b + "'" for a, b in (("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-01-29")))
RATE = "CASE WHEN a.n IS NULL OR a.n = 0 THEN NULL ELSE CAST(coalesce(b.n, 0) - a.n AS DOUBLE) * 100.0 / CAST(a.n AS DOUBLE) END AS delta_rate"
recipe(
    "period_compare_count_total",
    "events",
    given("events"),
    f"WITH a AS ({A_PART.format(g='')}), b AS ({B_PART.format(g='')}) SELECT a.n AS a_count, b.n AS b_count, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta_count, {RATE} FROM a CROSS JOIN b",
    skill="period_compare_count",
    **PERIODS,
)
recipe(
    "period_compare_count_group",
    "events",
    given("events"),
    f"WITH a AS ({A_PART.format(g='event_type,')} GROUP BY 1), b AS ({B_PART.format(g='event_type,')} GROUP BY 1) SELECT coalesce(a.event_type, b.event_type) AS event_type, a.n AS a_count, b.n AS b_count, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta_count, {RATE} FROM a FULL JOIN b ON a.event_type = b.event_type",
    skill="period_compare_count",
    group_by=["event_type"],
    **PERIODS,
)
recipe(
    "period_compare_distribution",
    "events",
    given("events"),
    f"""WITH a AS (SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS r FROM ({A_PART.format(g='event_type,')} GROUP BY 1)), b AS (SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS r FROM ({B_PART.format(g='event_type,')} GROUP BY 1))
    SELECT coalesce(a.event_type, b.event_type) AS event_type, a.n AS a_count, a.r AS a_ratio, b.n AS b_count, b.r AS b_ratio, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta_count, coalesce(b.r, 0) - coalesce(a.r, 0) AS delta_ratio FROM a FULL JOIN b ON a.event_type = b.event_type""",
    group_by=["event_type"],
    **PERIODS,
)


# Text and cleaning (STR, DAT, JSN, TYP, BLD).

SPACES = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[^\S\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), ' ' || chr(10))"
register("clean_whitespace", f"SELECT doc_id, {SPACES.format(c='text')} AS cleaned FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", tx.normalise_space(F.col("text")).alias("cleaned")))
register("punctuation", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[!?.]{2,}', '.', 'g'), '[_\-=/]{3,}', ' ', 'g') AS cleaned FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.normalise_marks(F.col("text")).alias("cleaned"))
)
register(
    "clean_rules",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', ' ', 'gi'), '&nbsp;', ' ', 'gi'), 'https?://\S+', ' ', 'gi'), 'www\.\S+', ' ', 'gi') AS cleaned FROM pages""",
)(lambda s, d: table(s, d, "pages").select("page_id", tx.clean_rules(F.col("html"), ["html_artifact", "url_cleanup"]).alias("cleaned")))
register("text_join", "SELECT doc_id, trim(concat_ws(chr(10) || chr(10), nullif(trim(lang), ''), nullif(trim(source), ''), nullif(trim(text, ' ' || chr(10)), ''))) AS joined FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.join_text([F.col("lang"), F.col("source"), F.col("text")]).alias("joined"))
)
register("clean_dedup", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")(lambda s, d: build.first_of_each(table(s, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"]))
register(
    "tokens_count",
    f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_filter([{CUT} FOR t IN regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]{{2,}}')], lambda t: t NOT IN ({WORDS}))) AS token FROM documents) GROUP BY token",
)(lambda s, d: search.token_counts(table(s, d, "documents"), tx.tokens(F.col("text"))))
register("particle_strip", f"SELECT doc_id, {CUT.replace('(t)', '(source)').replace('(t,', '(source,').replace('ELSE t ', 'ELSE source ')} AS cut FROM (SELECT doc_id, source || ['은', 'x', '는'][CAST(doc_id % 3 AS INTEGER) + 1] AS source FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.cut_particle(F.concat("source", F.element_at(F.array(F.lit("은"), F.lit("x"), F.lit("는")), (F.col("doc_id") % 3 + 1).cast("int")))).alias("cut"))
)
register("punctuation_only", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, '[0-9A-Za-z가-힣]')) AS kept FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")(
    lambda s, d: table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("line").rlike("[0-9A-Za-z가-힣]"), 1)).alias("kept"))
)
STAMPS = "CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y/%m/%d') ELSE 'Invalid date' END"


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, F.date_format("ts", "yyyy/MM/dd")).otherwise("Invalid date")
    return table(spark, sf_dir, "events").select("event_id", text.alias("stamp"))


register(
    "coerce_timestamp",
    "SELECT event_id, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN NULL ELSE strftime(ts, '%Y-%m-%dT00:00:00Z') END AS stamp FROM events",
)(lambda s, d: stamps(s, d).select("event_id", vx.coerce_timestamp(F.col("stamp")).alias("stamp")))
register("cast_date", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events")(lambda s, d: stamps(s, d).select("event_id", vx.to_date(F.col("stamp")).alias("day")))
register("json_extract", """SELECT event_id, json_extract_string(props, '$."k"') AS k FROM events""")(lambda s, d: table(s, d, "events").select("event_id", vx.json_field(F.col("props"), "k").alias("k")))
register("source_url", "SELECT page_id, CASE WHEN regexp_matches(trim(url), '^https?://[^ \t\r\n]*$') THEN trim(url) ELSE '' END AS found FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", vx.source_url(F.to_json(F.struct(F.lit("no link").alias("a"), F.col("url").alias("b")))).alias("found"))
)
register(
    "infer_types",
    """WITH v AS (
         SELECT unnest(['o_orderkey', 'o_totalprice', 'o_orderdate', 'o_orderstatus']) AS "column",
                trim(unnest([CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderstatus])) AS v
         FROM orders
       ), n AS (
         SELECT "column", count(*) FILTER (WHERE v <> '') AS filled, count(*) FILTER (WHERE regexp_matches(v, '^[0-9]{4}-') AND try_cast(v AS TIMESTAMP) IS NOT NULL) AS times,
                count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+')) AS wholes, count(*) FILTER (WHERE v <> '' AND try_cast(v AS DOUBLE) IS NOT NULL) AS reals
         FROM v GROUP BY "column"
       )
       SELECT "column", CASE WHEN filled = 0 THEN 'string' WHEN times >= 0.9 * filled THEN 'timestamp' WHEN wholes = filled THEN 'integer' WHEN reals = filled THEN 'float' ELSE 'string' END AS type FROM n""",
)(
    lambda s, d: vx.infer_types(table(s, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"), order_by=["o_orderkey"])
)
register("coerce_values", "SELECT event_id, event_id AS whole, value AS real FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", vx.coerce(F.col("event_id").cast("string"), "integer").alias("whole"), vx.coerce(F.col("value").cast("string"), "float").alias("real"))
)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with what real sources have besides: links, markup, noise, and dates and numbers as text."""
    k = F.col("doc_id") % 6
    tail = F.when(k == 0, "<BR />x. 네트워크 오류가 발생했습니다.").when(k == 1, " https://a.b/c?d WWW.x.y z").when(k == 2, " 재생1:23 재생12:34").when(k == 3, " 3km NAVER Corp. 지도 보기! 50m NAVER Corp. 끝").when(k == 4, "&nbsp;존재하지 않는 이미지입니다...").otherwise("")
    day = F.when(F.col("doc_id") % 3 == 0, "2024-01-05 10:00:00").when(F.col("doc_id") % 3 == 1, "2024/02/07").otherwise("unknown")
    number = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.concat("text", tail).alias("body"), day.alias("day"), F.concat(number, F.lit(",000")).alias("Score (all)"), F.concat(number, F.lit(".5")).alias("price"))


REVIEWS = """reviews AS (SELECT doc_id AS place, text || ['<BR />x. 네트워크 오류가 발생했습니다.', ' https://a.b/c?d WWW.x.y z', ' 재생1:23 재생12:34', ' 3km NAVER Corp. 지도 보기! 50m NAVER Corp. 끝', '&nbsp;존재하지 않는 이미지입니다...', ''][CAST(doc_id % 6 AS INTEGER) + 1] AS body,
  ['2024-01-05T10:00:00Z', '2024-02-07T00:00:00Z', NULL][CAST(doc_id % 3 AS INTEGER) + 1] AS created_at, doc_id FROM documents)"""


def _cleaning() -> str:
    """CTEs s0, s1, ...: a step of cleaning each, t0 the text before and tn the text after; the last is `done`."""
    rule = lambda c, patterns: c if not patterns else rule(f"regexp_replace({c}, '{patterns[0]}', ' ', 'gi')", patterns[1:])
    patterns = [[p.replace("\\u200b-\\u200d\\ufeff", "\\x{200B}-\\x{200D}\\x{FEFF}") for p in ps] for ps in tx.CLEAN_RULES.values()]
    steps = ["s0 AS (SELECT *, trim(coalesce(body, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t0 FROM reviews)"]
    for k, ps in enumerate(patterns):
        steps.append(f"s{k + 1} AS (SELECT *, {rule(f't{k}', ps)} AS t{k + 1} FROM s{k})")
    for k, p in enumerate(tx.NOISE, len(patterns)):
        steps.append(f"s{k + 1} AS (SELECT *, regexp_replace(t{k}, '{p}', ' ', 'g') AS t{k + 1}, len(regexp_extract_all(t{k}, '{p}')) AS noise_{k - len(patterns)} FROM s{k})")
    n = len(patterns) + len(tx.NOISE)
    phrases = "|".join(tx.KNOWN_PHRASES)
    marks = rf"regexp_replace(regexp_replace(regexp_replace(t{n}, '{phrases}', ' ', 'g'), '[!?.]{{2,}}', '.', 'g'), '[_\-=/]{{3,}}', ' ', 'g')"
    steps.append(f"done AS (SELECT *, {SPACES.format(c=marks)} AS cleaned FROM s{n})")
    return ", ".join(steps)


CLEANING = _cleaning()
register(
    "noise_scrub",
    f"WITH {REVIEWS}, {CLEANING} SELECT place, t{len(tx.CLEAN_RULES) + len(tx.NOISE)} AS cleaned, CAST({' + '.join(f'noise_{i}' for i in range(len(tx.NOISE)))} AS INTEGER) AS hits FROM done",
)(
    lambda s, d: reviews(s, d)
    .select("place", tx.clean_rules(tx.join_text([F.col("body")])).alias("body"))
    .select("place", tx.scrub_noise(F.col("body")).alias("cleaned"), tx.noise_hits(F.col("body")).alias("hits"))
)
register(
    "clean_table",
    f"""WITH {REVIEWS}, {CLEANING} SELECT 'v1:row:' || place AS row_id, 'v1:row:' || place AS doc_id, place AS source_row_index, t0 AS raw_text, cleaned AS cleaned_text, created_at, 'keep' AS clean_status, doc_id * 1000 AS score_all, doc_id + 0.5::DOUBLE AS price,
      ['2024-01-05 10:00:00', '2024/02/07', 'unknown'][CAST(doc_id % 3 AS INTEGER) + 1] AS day_given
    FROM done WHERE cleaned <> '' QUALIFY row_number() OVER (PARTITION BY cleaned ORDER BY place) = 1""",
)(
    lambda s, d: build.clean(reviews(s, d), ["body"], index="place", version="v1", date_column="day", types={"Score (all)": "integer", "price": "float"})
    .withColumn("day_given", vx.json_field(F.col("source_json"), "day"))
    .drop("source_json", "clean_reason")
)
register(
    "clean_summary",
    f"""WITH {REVIEWS}, {CLEANING}, d AS (SELECT *, {" + ".join(f"noise_{i}" for i in range(len(tx.NOISE)))} AS hits, cleaned <> '' AND row_number() OVER (PARTITION BY cleaned ORDER BY place) = 1 AS kept FROM done)
    SELECT count(*) AS input_rows, count(*) FILTER (WHERE kept) AS kept_rows, count(*) FILTER (WHERE cleaned = '') AS dropped_rows, count(*) FILTER (WHERE t0 = '') AS skipped_rows, count(*) FILTER (WHERE cleaned <> '' AND NOT kept) AS deduped_rows,
           CAST(sum(length(t0)) AS BIGINT) AS raw_chars, CAST(sum(length(cleaned)) FILTER (WHERE kept) AS BIGINT) AS cleaned_chars, count(*) FILTER (WHERE kept AND created_at IS NULL) AS date_misses,
           CAST(sum(hits) AS BIGINT) AS noise_hits, count(*) FILTER (WHERE hits > 0) AS noise_rows,
           {", ".join(f"count(*) FILTER (WHERE t{k + 1} <> t{k}) AS rule_{name}" for k, name in enumerate(tx.CLEAN_RULES))}, {", ".join(f"CAST(sum(noise_{i}) AS BIGINT) AS noise_{i}" for i in range(len(tx.NOISE)))} FROM d""",
)(lambda s, d: build.clean_summary(reviews(s, d), ["body"], index="place", date_column="day"))
WHITE = "' ' || chr(9) || chr(10) || chr(13)"
register(
    "sentence_rows",
    rf"""WITH p AS (
      SELECT id, i, pieces[i] AS piece
      FROM (SELECT conv_id || '-' || turn AS id, regexp_extract_all(text, '(?s).*?(?:[.!?。！？]\s+|\n+|\z)') AS pieces FROM conversations), unnest(range(1, len(pieces) + 1)) u(i)
    ), w AS (
      SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(piece) - length(ltrim(piece, {WHITE})) AS start, trim(piece, {WHITE}) AS sentence FROM p
    )
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS sentence_index, sentence, CAST(start AS INTEGER) AS start, CAST(start + length(sentence) AS INTEGER) AS "end" FROM w WHERE regexp_matches(sentence, '[0-9A-Za-z가-힣]')""",
)(lambda s, d: tx.sentence_rows(table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "id", "text"))
#: Sentences of a text as an array: parted behind full stops and the like, and at newlines; without a letter or digit they go.
LISTED = rf"list_filter([trim(p, {WHITE}) FOR p IN string_split_regex(regexp_replace({{c}}, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '\n+')], lambda s: regexp_matches(s, '[0-9A-Za-z가-힣]'))"
register(
    "sentence_chunks",
    f"""WITH RECURSIVE l AS (SELECT doc_id, {LISTED.format(c='text')} AS ss FROM documents), t AS (SELECT doc_id, ss, len(ss) AS n, [length(s) FOR s IN ss] AS ls FROM l WHERE len(ss) > 0), c AS (
      SELECT doc_id, ss, n, ls, 0 AS k, 0 AS s, greatest(1, len(list_filter(range(1, least(8, n) + 1), lambda j: list_sum(ls[1:j]) <= 600))) AS e FROM t
      UNION ALL
      SELECT doc_id, ss, n, ls, k + 1, f, f + greatest(1, len(list_filter(range(1, least(8, n - f) + 1), lambda j: list_sum(ls[f + 1:f + j]) <= 600)))
      FROM (SELECT *, CASE WHEN e - 1 > s THEN e - 1 ELSE e END AS f FROM c WHERE e < n)
    )
    SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, CAST(s AS BIGINT) AS sentence_start, CAST(e AS BIGINT) AS sentence_end, array_to_string(ss[s + 1:e], ' ') AS chunk FROM c""",
)(lambda s, d: build.chunk_sentences(table(s, d, "documents"), most_sentences=8, most_chars=600))
QUESTION = ["the", "the", "thand", "of", "la", "que", "estion"]
INDEXED = f"""counts AS (SELECT doc_id, t AS token, count(*) AS n FROM (SELECT doc_id, unnest([{CUT} FOR t IN regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]{{2,}}')]) AS t FROM documents) GROUP BY ALL),
  norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY 1), asked AS (SELECT token, count(*) AS m FROM (SELECT unnest({QUESTION}) AS token) GROUP BY 1),
  scores AS (SELECT doc_id, sum(n) AS overlap, sum(n * m) / (any_value(norm) * (SELECT sqrt(sum(m * m)) FROM asked)) AS cosine FROM counts JOIN asked USING (token) JOIN norms USING (doc_id) GROUP BY 1)"""


def indexed(spark: SparkSession, sf_dir: str) -> search.TokenIndex:
    return search.TokenIndex.of(table(spark, sf_dir, "documents"), tx.tokens(F.col("text"), ()))


register("overlap_ranking", f"WITH {INDEXED} SELECT CAST(row_number() OVER (ORDER BY overlap DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(overlap AS BIGINT) AS overlap, round(cosine, 9) AS cosine FROM scores ORDER BY overlap DESC, doc_id LIMIT 25")(
    lambda s, d: indexed(s, d).search(QUESTION, k=25).withColumn("cosine", F.round("cosine", 9))
)
register("cosine_ranking", f"WITH {INDEXED} SELECT CAST(row_number() OVER (ORDER BY round(cosine, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(overlap AS BIGINT) AS overlap, round(cosine, 9) AS cosine FROM scores ORDER BY round(cosine, 9) DESC, doc_id LIMIT 25")(
    lambda s, d: indexed(s, d).similar(QUESTION, k=25).withColumn("cosine", F.round("cosine", 9))
)
register(
    "term_deltas",
    f"""WITH t AS (SELECT lang, unnest([{CUT} FOR t IN regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]{{2,}}')]) AS term FROM documents), c AS (SELECT term, count(*) FILTER (WHERE lang = 'en') AS current_count, count(*) FILTER (WHERE lang = 'fr') AS previous_count FROM t WHERE lang IN ('en', 'fr') GROUP BY 1)
    SELECT *, current_count - previous_count AS delta FROM c ORDER BY abs(delta) DESC, current_count DESC, term LIMIT 20""",
)(lambda s, d: search.term_deltas(*[table(s, d, "documents").where(F.col("lang") == lang).select(F.explode(tx.tokens(F.col("text"), ())).alias("term")) for lang in ("en", "fr")]))
register("json_values", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'click' AS yes, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN user_id END AS inner_n, event_id % 3 = 2 AS no_inner FROM events""")(
    lambda s, d: table(s, d, "events")
    .withColumn("inner", F.when(F.col("event_id") % 3 == 0, F.expr("named_struct('n', 'x12', 'yes', cast(null as string))")).when(F.col("event_id") % 3 == 1, F.expr("named_struct('n', cast(user_id as string), 'yes', 'no')")).otherwise(F.expr("named_struct('n', cast(null as string), 'yes', cast(null as string))")))
    .withColumn("json", F.to_json(F.struct(vx.json_field(F.col("props"), "k").alias("k"), F.when(F.col("event_type") == "click", " TRUE ").otherwise("1").alias("yes"), "inner")))
    .select("event_id", vx.json_value(F.col("json"), "k long, yes boolean, inner struct<n: int, yes: boolean>").alias("v"))
    .select("event_id", "v.k", "v.yes", F.col("v.inner.n").cast("long").alias("inner_n"), F.col("v.inner").isNull().alias("no_inner"))
)


def undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events whose date is under a late key of their JSON, in some rows, and under an earlier key not at all."""
    day = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd"))
    fields = F.struct(F.lit("soon").alias("작성일"), F.col("event_type").alias("date"), F.when(F.col("event_id") % 2 == 0, day).alias("pub_date"), F.date_format("ts", "yyyy/MM/dd").alias("published_at"), "value")
    return table(spark, sf_dir, "events").select("event_id", F.lit("n/a").alias("created_at"), F.to_json(fields).alias("source_json"))


register("report_day", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS day FROM events")(lambda s, d: vx.with_day(undated(s, d)).select("event_id", "day"))
register("report_period", "SELECT min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, CAST(min(CAST(ts AS DATE)) AS VARCHAR) || ' ~ ' || CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS period FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0")(
    lambda s, d: reports.data_period(vx.with_day(undated(s, d)), "day")
)
register("clause_ids", f"WITH {CLAUSE_IDS} SELECT doc_id, clause_id, clause FROM clause_ids")(lambda s, d: build.clause_ids(clauses(s, d)).select("doc_id", "clause_id", "clause"))
register("clause_ids_by_place", f"WITH {CLAUSES} SELECT doc_id, turn, CAST(doc_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn NULLS LAST) - 1 AS VARCHAR) AS clause_id FROM clauses")(
    lambda s, d: build.clause_ids(clauses(s, d), ordinal="turn").select("doc_id", "turn", "clause_id")
)
register("keyword_rows", f"WITH {KEYWORDS} SELECT doc_id, clause_id, keyword, keyword_rank_in_clause FROM keyword_rows")(lambda s, d: keyword_rows(s, d).select("doc_id", "clause_id", "keyword", "keyword_rank_in_clause"))
register(
    "keyword_counts",
    f"""WITH {KEYWORDS}, n AS (SELECT keyword, count(*) AS n FROM keyword_rows GROUP BY 1 ORDER BY n DESC, keyword LIMIT 20)
    SELECT (SELECT count(*) FROM clauses) AS clause_count, count(DISTINCT clause_id) AS with_keywords, count(DISTINCT keyword) AS unique_keywords, (SELECT string_agg(keyword || '=' || n, '|' ORDER BY n DESC, keyword) FROM n) AS top_keywords FROM keyword_rows""",
)(lambda s, d: build.keyword_summary(clauses(s, d), keyword_rows(s, d)).withColumn("top_keywords", F.array_join(F.transform("top_keywords", lambda e: F.concat_ws("=", e["keyword"], e["n"].cast("string"))), "|")))

# Labels of two runs (BLD-11..14, JON-13, AGG-20). Run B flips some labels by document id.


def flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("doc_id") % 5 == 0, "uncertain").when(F.col("doc_id") % 7 == 0, "non_review").otherwise(F.col("genuineness"))
    return labels(spark, sf_dir).where("doc_id % 11 <> 3").withColumn("genuineness", other)


FLIPPED = LABELS + ", flipped AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'uncertain' WHEN doc_id % 7 = 0 THEN 'non_review' ELSE genuineness END AS genuineness FROM label_rows WHERE doc_id % 11 <> 3)"
register(
    "run_comparison",
    f"""WITH {FLIPPED} SELECT a.genuineness AS label_a, b.genuineness AS label_b, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS presence, count(*) AS n
    FROM label_rows a FULL JOIN flipped b ON a.doc_id = b.doc_id GROUP BY ALL""",
)(lambda s, d: dashboards.compare_runs(labels(s, d), flipped(s, d)))
register(
    "run_agreement",
    f"""WITH {FLIPPED}, j AS (SELECT a.genuineness AS x, b.genuineness AS y FROM label_rows a JOIN flipped b USING (doc_id))
    SELECT count(*) AS compared, count(*) FILTER (WHERE x = y) AS matched, CAST(NULL AS DOUBLE) AS accuracy_a, CAST(NULL AS DOUBLE) AS accuracy_b, count(*) FILTER (WHERE x = y) / count(*) AS agreement,
           CASE WHEN count(*) FILTER (WHERE x = y) / count(*) >= 0.85 THEN 'agreement_only' ELSE 'review_needed' END AS verdict FROM j""",
)(lambda s, d: dashboards.agreement(labels(s, d), flipped(s, d)))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people said of some documents of the first run."""
    return labels(spark, sf_dir).where("doc_id % 4 = 1").withColumn("genuineness", F.when(F.col("doc_id") % 3 == 0, "uncertain").otherwise(F.col("genuineness")))


register(
    "run_accuracy",
    f"""WITH {FLIPPED}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'uncertain' ELSE genuineness END AS t FROM label_rows WHERE doc_id % 4 = 1),
    j AS (SELECT a.genuineness AS x, b.genuineness AS y, t FROM label_rows a JOIN flipped b USING (doc_id) LEFT JOIN t USING (doc_id))
    SELECT count(*) AS compared, count(*) FILTER (WHERE x = y) AS matched, count(*) FILTER (WHERE x = t) / count(t) AS accuracy_a, count(*) FILTER (WHERE y = t) / count(t) AS accuracy_b, count(*) FILTER (WHERE x = y) / count(*) AS agreement, 'ground_truth' AS verdict FROM j""",
)(lambda s, d: dashboards.agreement(labels(s, d), flipped(s, d), truth(s, d)))
register(
    "run_patterns",
    f"""WITH {FLIPPED}, p AS (SELECT a.genuineness AS label_a, b.genuineness AS label_b, count(*) AS n FROM label_rows a JOIN flipped b USING (doc_id) WHERE a.genuineness <> b.genuineness GROUP BY ALL)
    SELECT CAST(row_number() OVER (ORDER BY n DESC, label_a, label_b) AS INTEGER) AS rank, * FROM p""",
)(lambda s, d: dashboards.patterns(labels(s, d), flipped(s, d)))
register(
    "label_reconcile",
    f"""WITH {FLIPPED} SELECT doc_id, a.genuineness AS label_a, b.genuineness AS label_b,
      CASE WHEN b.genuineness IS NULL THEN 'partial' WHEN a.genuineness = b.genuineness THEN 'agree' ELSE 'judge' END AS resolution,
      CASE WHEN b.genuineness IS NULL OR a.genuineness = b.genuineness THEN a.genuineness ELSE b.genuineness END AS final_label,
      b.genuineness IS NOT NULL AND a.genuineness <> b.genuineness AS is_disagreement,
      b.genuineness IS NOT NULL AND a.genuineness <> b.genuineness AND doc_id % 2 = 0 AS needs_review
    FROM label_rows a LEFT JOIN flipped b USING (doc_id)""",
)(
    lambda s, d: build.reconcile_documents(
        labels(s, d)
        .select("doc_id", F.col("genuineness").alias("label_a"))
        .join(flipped(s, d).select("doc_id", F.col("genuineness").alias("label_b")), "doc_id", "left")
        .withColumns({"judge_label": F.col("label_b"), "judge_decision": F.lit("final"), "judge_confidence": F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(0.9)})
    ).drop("judge_label", "judge_decision", "judge_confidence")
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' raw answers about each turn, derived from its place and text."""
    c = clauses(spark, sf_dir)
    k = F.col("turn") + F.length("clause")
    aspects = lambda m: F.filter(F.array(F.when(k % m != 0, F.lit("food")), F.when(k % (m + 1) == 0, F.lit("place")), F.lit("other?")), lambda x: x.isNotNull())
    parse = lambda m, mood: build.parse_labels(k % m != 1, mood, aspects(m), ["food", "place", "price"], "general")
    return c.select("doc_id", "turn", parse(5, F.col("sentiment")).alias("a"), parse(7, F.when(k % 4 == 0, "bad word").when(k % 4 == 1, "negative").otherwise(F.col("sentiment"))).alias("b"))


def _answers_sql(m: int, mood: str) -> str:
    known = f"list_sort(list_filter([CASE WHEN k % {m} <> 0 THEN 'food' END, CASE WHEN k % {m + 1} = 0 THEN 'place' END], lambda x: x IS NOT NULL))"
    return f"k % {m} <> 1 AS r{m}, {mood} AS s{m}, CASE WHEN k % {m} = 1 THEN [] WHEN len({known}) = 0 THEN ['general'] ELSE {known} END AS p{m}"


ANSWERS = f"""{CLAUSES}, answers AS (SELECT doc_id, turn, {_answers_sql(5, "sentiment")}, {_answers_sql(7, "CASE WHEN k % 4 = 0 THEN 'neutral' WHEN k % 4 = 1 THEN 'negative' ELSE sentiment END")} FROM (SELECT *, turn + length(clause) AS k FROM clauses)),
settled AS (SELECT *, CASE WHEN s5 = s7 THEN s5 WHEN s5 = 'neutral' THEN s7 WHEN s7 = 'neutral' THEN s5 END AS mood,
  len(list_filter(p5, lambda x: NOT list_contains(p7, x))) AS only5, len(list_filter(p7, lambda x: NOT list_contains(p5, x))) AS only7 FROM answers),
judged AS (SELECT *, CASE WHEN NOT r5 AND NOT r7 THEN 'drop' WHEN r5 <> r7 THEN 'judge' WHEN mood IS NULL OR (only5 > 0 AND only7 > 0) THEN 'judge' ELSE 'final' END AS outcome FROM settled)"""
register(
    "sentence_reconcile",
    f"""WITH {ANSWERS} SELECT doc_id, turn, outcome, CASE WHEN outcome = 'final' THEN mood END AS sentiment,
      CASE WHEN outcome = 'final' THEN array_to_string(list_sort(list_distinct(list_concat(p5, p7))), ',') END AS aspects,
      CASE WHEN outcome = 'final' THEN CASE WHEN only5 + only7 > 0 THEN 'union' WHEN s5 <> s7 THEN 'sentiment_auto' ELSE 'agree' END END AS resolution FROM judged""",
)(lambda s, d: build.reconcile_sentences(answers(s, d)).select("doc_id", "turn", "outcome", "sentiment", F.when(F.col("aspects").isNotNull(), F.array_join("aspects", ",")).alias("aspects"), "resolution"))
register("gated_docs", f"WITH {LABELS}, {CLEAN} SELECT row_id, genuineness FROM clean_rows JOIN label_rows ON row_id = doc_id WHERE genuineness IN ('genuine_review', 'uncertain')")(
    lambda s, d: build.gated(clean_rows(s, d), labels(s, d)).join(labels(s, d).select(F.col("doc_id").alias("row_id"), "genuineness"), "row_id").select("row_id", "genuineness")
)

# Dashboards (DSH, WIN, AGG-09..15).

register("label_counts", f"WITH {LABELLED} SELECT coalesce(nullif(trim(genuineness), ''), 'unknown') AS label, count(*) AS n FROM labelled GROUP BY 1")(lambda s, d: dashboards.counts(docs_with_labels(s, d), "genuineness"))
register(
    "aspect_sentiment_matrix",
    f"""WITH {CLAUSES}, f AS (SELECT aspect, sentiment, count(*) AS n FROM clauses GROUP BY ALL), k AS (SELECT DISTINCT aspect, s AS sentiment FROM f, (VALUES ('positive'), ('neutral'), ('negative')) v(s)),
    m AS (SELECT aspect, sentiment, coalesce(n, 0) AS n FROM k LEFT JOIN f USING (aspect, sentiment))
    SELECT aspect, sentiment, n, floor(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY aspect) * 1000 + 0.5) / 10 AS percent FROM m""",
)(lambda s, d: dashboards.aspect_matrix(clauses(s, d)))
register("genuineness_page", f"WITH {LABELS}, {CLEAN} SELECT doc_id, genuineness, cleaned_text FROM label_rows LEFT JOIN clean_rows ON doc_id = row_id WHERE genuineness = 'genuine_review' ORDER BY source_row_index NULLS LAST, doc_id LIMIT 20 OFFSET 5")(
    lambda s, d: dashboards.genuineness_view(labels(s, d), clean_rows(s, d), genuineness="genuine_review", limit=20, offset=5).select("doc_id", "genuineness", "cleaned_text")
)
register("clause_page", f"WITH {CLAUSE_IDS} SELECT doc_id, clause_id, clause FROM clause_ids WHERE aspect = 'user' ORDER BY doc_id NULLS LAST, clause_id NULLS LAST LIMIT 30 OFFSET 10")(
    lambda s, d: dashboards.clause_view(build.clause_ids(clauses(s, d)), clean_rows(s, d), aspect="user", limit=30, offset=10).select("doc_id", "clause_id", "clause")
)
register(
    "keyword_table",
    f"""WITH {KEYWORDS}, f AS (SELECT * FROM keyword_rows),
    b AS (SELECT keyword, count(*) AS count, count(DISTINCT doc_id) AS document_count FROM f GROUP BY 1),
    r AS (SELECT keyword, clause AS representative_clause FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY length(clause) DESC, clause) AS rn FROM f) WHERE rn = 1),
    s AS (SELECT keyword, sentiment AS dominant_sentiment, c FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY c DESC, sentiment) AS rn FROM (SELECT keyword, sentiment, count(*) AS c FROM f GROUP BY ALL)) WHERE rn = 1),
    a AS (SELECT keyword, aspect AS top_aspect FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY c DESC, aspect) AS rn FROM (SELECT keyword, aspect, count(*) AS c FROM f GROUP BY ALL)) WHERE rn = 1)
    SELECT keyword, count, document_count, dominant_sentiment, round(CAST(c AS DOUBLE) / count, 4) AS dominant_sentiment_ratio, top_aspect, representative_clause FROM b JOIN s USING (keyword) JOIN a USING (keyword) JOIN r USING (keyword)""",
)(lambda s, d: dashboards.keyword_table(keyword_rows(s, d)))
register("keyword_totals", f"WITH {KEYWORDS} SELECT count(*) AS occurrences, count(DISTINCT keyword) AS unique_keywords, count(DISTINCT clause_id) AS clause_ids, count(DISTINCT doc_id) AS documents FROM keyword_rows")(
    lambda s, d: dashboards.keyword_totals(keyword_rows(s, d))
)
register("top_keywords", f"WITH {KEYWORDS} SELECT keyword, count(*) AS count FROM keyword_rows WHERE sentiment = 'positive' GROUP BY 1 ORDER BY count DESC, keyword LIMIT 5")(lambda s, d: dashboards.top_keywords(keyword_rows(s, d), "positive"))
register(
    "word_cloud",
    f"""WITH {KEYWORDS}, c AS (SELECT aspect, sentiment, keyword, count(*) AS count FROM keyword_rows WHERE sentiment IN ('positive', 'negative') GROUP BY ALL)
    SELECT aspect, sentiment, keyword, count, round(CAST(count AS DOUBLE) / most, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY aspect, sentiment ORDER BY count DESC, keyword) AS rn, max(count) OVER (PARTITION BY aspect, sentiment) AS most FROM c) WHERE rn <= 30""",
)(lambda s, d: dashboards.word_cloud(keyword_rows(s, d)))
register(
    "keywords_by_clause",
    f"""WITH {KEYWORDS}, k AS (SELECT clause, keyword, min(keyword_rank_in_clause) AS rk FROM keyword_rows GROUP BY ALL), g AS (SELECT clause, string_agg(keyword, '|' ORDER BY rk, keyword) AS keywords, count(*) AS keyword_count FROM k GROUP BY 1), o AS (SELECT clause, count(DISTINCT clause_id) AS occurrence_count FROM keyword_rows GROUP BY 1)
    SELECT clause, keywords, keyword_count, occurrence_count FROM g JOIN o USING (clause)""",
)(lambda s, d: dashboards.keywords_by_clause(keyword_rows(s, d)).withColumn("keywords", F.array_join("keywords", "|")))
register(
    "clauses_with_keyword",
    f"""WITH {KEYWORDS}, hit AS (SELECT DISTINCT clause FROM keyword_rows WHERE keyword ILIKE '%tion%' OR clause ILIKE '%tion%'), k AS (SELECT clause, keyword, min(keyword_rank_in_clause) AS rk FROM keyword_rows JOIN hit USING (clause) GROUP BY ALL),
    g AS (SELECT clause, string_agg(keyword, '|' ORDER BY rk, keyword) AS keywords, count(*) AS keyword_count FROM k GROUP BY 1), o AS (SELECT clause, count(DISTINCT clause_id) AS occurrence_count FROM keyword_rows GROUP BY 1)
    SELECT clause, keywords, keyword_count, occurrence_count FROM g JOIN o USING (clause)""",
)(lambda s, d: dashboards.keywords_by_clause(keyword_rows(s, d), query="tion").withColumn("keywords", F.array_join("keywords", "|")))
register("keyword_search", f"WITH {KEYWORDS} SELECT doc_id, clause_id, keyword FROM keyword_rows WHERE aspect = 'user' AND (keyword ILIKE '%th%e%' OR clause ILIKE '%th%e%')")(
    lambda s, d: dashboards.keyword_filter(keyword_rows(s, d), aspect="user", query="th%e").select("doc_id", "clause_id", "keyword")
)
RULES = (
    {"rule_type": "block", "source_term": "of", "active": True},
    {"rule_type": "block", "source_term": "in", "active": False},
    {"rule_type": "synonym", "source_term": "is", "target_term": "be", "active": True},
    {"rule_type": "synonym", "source_term": "are", "target_term": "be", "active": True},
    {"rule_type": "synonym", "source_term": "to", "target_term": "to", "active": True},
)
register("keyword_overlay", f"WITH {KEYWORDS} SELECT CASE WHEN keyword IN ('is', 'are') THEN 'be' ELSE keyword END AS keyword, count(*) AS n FROM keyword_rows WHERE keyword <> 'of' GROUP BY 1")(
    lambda s, d: overlay.apply_rules(keyword_rows(s, d), RULES).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
)


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id", F.lit("non_review").alias("override_genuineness"), F.lit(None).cast("string").alias("override_reason"))


register("override_overlay", f"WITH {LABELS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'non_review' ELSE genuineness END AS genuineness, reason, doc_id % 3 = 0 AS overridden FROM label_rows")(lambda s, d: overlay.override_labels(labels(s, d), overrides(s, d)))
register(
    "override_shift",
    f"""WITH {LABELS}, x AS (SELECT genuineness AS b, CASE WHEN doc_id % 3 = 0 THEN 'non_review' ELSE genuineness END AS a FROM label_rows),
    e AS (SELECT b AS label, 1 AS nb, 0 AS na, (b = 'non_review') <> (a = 'non_review') AS m FROM x UNION ALL SELECT a, 0, 1, (b = 'non_review') <> (a = 'non_review') FROM x)
    SELECT label, CAST(sum(nb) AS BIGINT) AS n_before, CAST(sum(na) AS BIGINT) AS n_after, CAST(sum(CAST(m AS INTEGER)) AS BIGINT) AS crossed FROM e GROUP BY 1""",
)(lambda s, d: overlay.count_shift(labels(s, d), overrides(s, d)))
register(
    "clause_override_matrix",
    f"""WITH {CLAUSE_IDS}, o AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE aspect END AS aspect, sentiment FROM clause_ids),
    f AS (SELECT aspect, sentiment, count(*) AS n FROM o GROUP BY ALL), k AS (SELECT DISTINCT aspect, s AS sentiment FROM f, (VALUES ('positive'), ('neutral'), ('negative')) v(s)), m AS (SELECT aspect, sentiment, coalesce(n, 0) AS n FROM k LEFT JOIN f USING (aspect, sentiment))
    SELECT aspect, sentiment, n, floor(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY aspect) * 1000 + 0.5) / 10 AS percent FROM m""",
)(
    lambda s, d: dashboards.aspect_matrix(
        overlay.override_labels(build.clause_ids(clauses(s, d)), build.clause_ids(clauses(s, d)).where("doc_id % 4 = 0").select("clause_id", F.lit("moved").alias("override_aspect")), key="clause_id", columns=("aspect", "sentiment"))
    )
)

# Reports (RPT).

register("channel_genuine", f"WITH {DOCS}, {LABELS} SELECT source AS channel, count(*) AS n FROM docs JOIN label_rows USING (doc_id) WHERE genuineness = 'genuine_review' GROUP BY 1")(lambda s, d: reports.channel_genuine(docs(s, d), labels(s, d), "source"))
register(
    "best_filled_key",
    """SELECT key FROM (SELECT unnest(['nothing', 'k', 'also nothing']) AS key, unnest([1, 2, 3]) AS place, props FROM events)
       GROUP BY key, place ORDER BY count(*) FILTER (WHERE trim(json_extract_string(props, '$."' || key || '"')) <> '') DESC, place LIMIT 1""",
)(lambda s, d: reports.best_filled(table(s, d, "events"), "props", ["nothing", "k", "also nothing"]))
register("field_values", """SELECT DISTINCT trim(json_extract_string(props, '$."k"')) AS value FROM events WHERE trim(json_extract_string(props, '$."k"')) <> ''""")(lambda s, d: reports.field_values(table(s, d, "events"), "props", "k"))
register("data_period", "SELECT min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) || ' ~ ' || CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS period FROM orders")(
    lambda s, d: reports.data_period(table(s, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")), "day")
)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over two years by id."""
    day = F.when(F.col("doc_id") % 2 == 0, "2023/05/01").otherwise("2024-02-01")
    return docs(spark, sf_dir).select("doc_id", "lang", day.alias("created_at"))


register("recent_year_stats", f"WITH {LABELS}, r AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 1) SELECT count(*) AS documents, (SELECT count(*) FROM label_rows JOIN r USING (doc_id) WHERE genuineness = 'genuine_review') AS genuine_documents FROM r")(
    lambda s, d: reports.recent_year_stats(dated(s, d), labels(s, d), "created_at")
)
register("semi_recent_year", f"WITH {LABELS} SELECT doc_id, genuineness FROM label_rows WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 1)")(
    lambda s, d: labels(s, d).join(reports.recent_year(dated(s, d), "created_at", "doc_id"), "doc_id", "left_semi").select("doc_id", "genuineness")
)
register("distribution_panel", "SELECT lang AS label, count(*) AS n, floor(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 1000 + 0.5) / 10 AS percent FROM documents GROUP BY lang ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, n DESC, label LIMIT 3")(
    lambda s, d: reports.distribution_panel(table(s, d, "documents"), "lang", order=["de"], top=3)
)
register("stacked_panel", f"WITH {LABELLED} SELECT lang AS label, count(*) FILTER (WHERE genuineness = 'genuine_review') AS genuine_review, count(*) FILTER (WHERE genuineness = 'non_review') AS non_review FROM labelled GROUP BY 1")(
    lambda s, d: reports.stacked_panel(docs_with_labels(s, d), "lang", "genuineness", ["genuine_review", "non_review"])
)
register("rank_panel", "SELECT CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank, label, n FROM (SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) ORDER BY n DESC, label LIMIT 7")(
    lambda s, d: reports.rank_panel(table(s, d, "documents"), "source", 7)
)
register("export_clauses", f"WITH {CLAUSES}, {LABELS} SELECT c.doc_id, CAST(c.doc_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY turn NULLS LAST) - 1 AS VARCHAR) AS clause_id, clause, genuineness FROM clauses c LEFT JOIN label_rows USING (doc_id)")(
    lambda s, d: exports.clause_rows(clauses(s, d), clean_rows(s, d), labels(s, d), ordinal="turn").select("doc_id", "clause_id", "clause", "genuineness")
)
register("export_genuineness", f"WITH {LABELS}, {CLEAN} SELECT doc_id, genuineness, reason, cleaned_text FROM label_rows LEFT JOIN clean_rows ON doc_id = row_id")(
    lambda s, d: exports.genuineness_rows(labels(s, d), clean_rows(s, d)).select("doc_id", "genuineness", "reason", "cleaned_text")
)



def report_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    documents = operators.join(dated(spark, sf_dir), labels(spark, sf_dir), ["doc_id"], "left").select("doc_id", "genuineness", F.col("lang").alias("channel"), vx.to_date(F.col("created_at")).alias("day"))
    return reports.with_years({"documents": documents, "clauses": clauses(spark, sf_dir), "keywords": keyword_rows(spark, sf_dir)})


def _section(section: str, panel: int, metric: str, cells: str, *, weight: str = "n", fixed: str = "1", top: int = 1000, stacked: bool = False) -> str:
    whole = "PARTITION BY label" if stacked else ""
    return f"""SELECT '{section}' AS section, {panel} AS panel, '{metric}' AS metric, CAST(rank AS INTEGER) AS rank, label, series, n, floor(CAST(n AS DOUBLE) / greatest(whole, 1) * 1000 + 0.5) / 10 AS percent
      FROM (SELECT *, dense_rank() OVER (ORDER BY {fixed}, w DESC, label) AS rank FROM (SELECT *, sum(n) OVER ({whole}) AS whole, sum({weight}) OVER (PARTITION BY label) AS w FROM ({cells}))) WHERE rank <= {top}"""


_ONE = "SELECT CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS series, count(*) AS n FROM {}"
_BY = "SELECT {0} AS label, CAST(NULL AS VARCHAR) AS series, count(*) AS n FROM {1} GROUP BY 1"
_BOTH = "SELECT aspect AS label, sentiment AS series, count(*) AS n FROM late_clauses GROUP BY 1, 2"
SECTIONS = (
    ("doc_overview", 1, "genuine_docs_total", _ONE.format("all_docs WHERE genuineness = 'genuine_review'")),
    ("doc_overview", 2, "genuine_docs_recent_year", _ONE.format("all_docs WHERE genuineness = 'genuine_review' AND y = 2024")),
    ("doc_overview", 3, "clauses_total", _ONE.format("clauses")),
    ("doc_overview", 4, "clauses_recent_year", _ONE.format("late_clauses")),
    ("channel_distribution", 1, "channel_genuine_distribution", _BY.format("lang", "all_docs WHERE genuineness = 'genuine_review' AND y = 2024"), {"top": 8}),
    ("sentiment_distribution", 1, "sentiment_distribution", _BY.format("sentiment", "late_clauses"), {"fixed": "CASE label WHEN 'positive' THEN 1 WHEN 'neutral' THEN 2 WHEN 'negative' THEN 3 ELSE 4 END"}),
    ("aspect_distribution", 1, "aspect_distribution", _BY.format("aspect", "late_clauses")),
    ("aspect_sentiment", 1, "aspect_sentiment", _BOTH, {"stacked": True}),
    ("aspect_sentiment", 2, "aspect_sentiment", _BOTH, {"stacked": True, "top": 6, "weight": "CASE WHEN series = 'positive' THEN n ELSE 0 END"}),
    ("aspect_sentiment", 3, "aspect_sentiment", _BOTH, {"stacked": True, "top": 6, "weight": "CASE WHEN series = 'negative' THEN n ELSE 0 END"}),
    ("keyword_distribution", 1, "keywords_positive", _BY.format("keyword", "late_keywords WHERE sentiment = 'positive'"), {"top": 10}),
    ("keyword_distribution", 2, "keywords_negative", _BY.format("keyword", "late_keywords WHERE sentiment = 'negative'"), {"top": 10}),
)
register(
    "report_sections",
    f"WITH {KEYWORDS}, {LABELS}, all_docs AS (SELECT doc_id, lang, genuineness, CASE WHEN doc_id % 2 = 1 THEN 2024 ELSE 2023 END AS y FROM documents LEFT JOIN label_rows USING (doc_id)), late_docs AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 1), "
    + "late_clauses AS (SELECT clauses.* FROM clauses JOIN late_docs USING (doc_id)), late_keywords AS (SELECT keyword_rows.* FROM keyword_rows JOIN late_docs USING (doc_id)) "
    + " UNION ALL ".join(_section(*s[:4], **(s[4] if len(s) > 4 else {})) for s in SECTIONS),
)(lambda s, d: reports.report_sections(report_tables(s, d)))

# The golden chain: counts per aspect in two halves of the turns, side by side, with their change, biggest first.

register(
    "aspect_delta",
    f"""WITH {CLAUSES}, a AS (SELECT aspect, count(*) AS n FROM clauses WHERE turn < 2 GROUP BY 1), b AS (SELECT aspect, count(*) AS n FROM clauses WHERE turn >= 2 GROUP BY 1)
    SELECT coalesce(a.aspect, b.aspect) AS aspect, a.n AS first_count, b.n AS last_count, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta_count,
           CASE WHEN a.n IS NULL OR a.n = 0 THEN NULL ELSE CAST(coalesce(b.n, 0) - a.n AS DOUBLE) * 100.0 / CAST(a.n AS DOUBLE) END AS delta_rate FROM a FULL JOIN b ON a.aspect = b.aspect""",
)(
    planned(
        {"clauses": lambda s, d: build.clause_ids(clauses(s, d))},
        {"id": "early", "skill": "filter", "params": {"input": "clauses", "column": "turn", "operator": "lt", "value": 2}},
        {"id": "late", "skill": "filter", "params": {"input": "clauses", "column": "turn", "operator": "gte", "value": 2}},
        count_by("early", "ec", ["aspect"]),
        count_by("late", "lc", ["aspect"]),
        {"id": "c", "skill": "compare", "params": {"left": "ec", "right": "lc", "join_key": ["aspect"], "left_label": "first", "right_label": "last"}},
        {
            "id": "d",
            "skill": "calculate",
            "params": {"input": "c", "expressions": [{"name": "delta_count", "operation": "subtract", "left": "last_count", "right": "first_count"}, {"name": "delta_rate", "operation": "percent_change", "base": "first_count", "current": "last_count"}]},
        },
        {"id": "s", "skill": "sort", "params": {"input": "d", "by": ["delta_count", "aspect"], "order": "desc"}},
        {"id": "p", "skill": "present", "params": {"input": "s", "format": "table"}},
    )
)

from . import workload_labels  # noqa: E402, F401  (registers its queries)
from . import workload_files  # noqa: E402, F401
