"""Findings of the third round: queries against their SQL on rows that the given tables lack, and work that must not grow."""

import duckdb

import __spark_entry__ as entry
from pyspark.sql import functions as F

from loomtext import build
from loomtext.functions import text as tx
from loomtext.functions import values as vx
from loomtext.views import dashboards


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL, sorted, over the tables as parquet files."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = entry.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    key = lambda r: [(v is not None, v if v is not None else 0) for v in r]
    return sorted((tuple(r) for r in found.collect()), key=key), sorted(con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall(), key=key)


def test_garbage_flags_of_texts_without_text_or_with_advertising(spark, tmp_path):
    texts = [None, "", "Только кириллица", "Sponsored: an advertisement", "소정의 수수료", "Previous imageNext image", "fine", "!!", "광고"]
    rows = [(6 * k + j, t) for k, t in enumerate(texts) for j in range(6)]
    got, want = against_sql(spark, tmp_path, "garbage_flags", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want and len(got) == 54 and {r[1] for r in got} == {"", "platform_placeholder"}


class Rows:
    """Stands for a table of (id, sentence): takes the function that a task would run."""

    columns = ["id", "sentence"]

    def __init__(self, schema):
        self.schema = schema

    def mapInArrow(self, run, schema):
        return run


def test_answers_leave_a_task_in_the_batches_that_came(spark):
    import pyarrow as pa

    calls = []

    def count(items):
        calls.append(len(items))
        return [{"key": i["key"], "n": "bad" if i["sentence"] == "s700" else i["id"]} for i in items if i["sentence"] != "s701"]

    run = build.ask(Rows(spark.createDataFrame([], "id long, sentence string").schema), count, "n long", give=["id", "sentence"], size_of="sentence", most_items=7)
    table = pa.table({"id": list(range(1000)), "sentence": [f"s{k}" for k in range(1000)]})
    made = list(run(iter(table.to_batches(max_chunksize=250))))
    assert [b.num_rows for b in made] == [250] * 4 and max(calls) == 7 and len(calls) == 143
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(1000))
    assert [(r["id"], r["answer_failure"]) for r in rows if r["answer_failure"]] == [(700, "unreadable"), (701, "missing")]
    assert all(r["answer"] == {"n": r["id"]} for r in rows if r["id"] not in (700, 701)) and rows[700]["answer"] is rows[701]["answer"] is None


def test_two_models_take_one_pass_over_the_rows(spark):
    rows = spark.createDataFrame([(1, 1, "a")], "doc_id long, sentence_index int, sentence string")
    both = build.both_labels(rows, lambda items: [], lambda items: [], allowed=["x"], fallback="general")
    assert both._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert {r.a_failure for r in both.collect()} == {r.b_failure for r in both.collect()} == {"missing"}


KEYWORD_ROWS = "doc_id long, clause_id string, clause string, aspect string, sentiment string, keyword string, keyword_rank_in_clause int"


def keyword_rows(spark):
    texts = ["ab tion", "bb tion", "bb tion", "aa tion", None, "w", "tion"]
    return spark.createDataFrame([(k // 2, f"{k // 2}__{k % 2}", t, "a", "s", w, i) for k, t in enumerate(texts) for i, w in enumerate((t or "w").split()[::-1], 1)], KEYWORD_ROWS)


def test_the_longest_clause_is_the_first_of_its_length(spark):
    got = {r.keyword: (r.representative_clause, r["count"], r.document_count) for r in dashboards.keyword_table(keyword_rows(spark)).collect()}
    assert got == {"tion": ("aa tion", 5, 3), "ab": ("ab tion", 1, 1), "bb": ("bb tion", 2, 2), "aa": ("aa tion", 1, 1), "w": ("w", 2, 1)}


def test_keywords_are_shuffled_without_their_clauses(spark, tmp_path):
    keyword_rows(spark).write.parquet(f"{tmp_path}/k")
    rows = spark.read.parquet(f"{tmp_path}/k")
    for query in ("", "ion"):
        found = dashboards.keywords_by_clause(rows, query=query)
        want = {"ab tion": (["tion", "ab"], 2, 1), "bb tion": (["tion", "bb"], 2, 2), "aa tion": (["tion", "aa"], 2, 1), "w": (["w"], 1, 1), "tion": (["tion"], 1, 1)}
        assert {r.clause: (r.keywords, r.keyword_count, r.occurrence_count) for r in found.collect()} == {c: v for c, v in want.items() if query in c}
        assert "hashpartitioning(clause#" not in found._jdf.queryExecution().executedPlan().toString()


def test_ends_are_stripped_without_a_search_of_the_text(spark):
    odd = [chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([(f"{c}{c}a{c}b{c}",) for c in odd] + [("",), (" \n",), (None,)], "t string")
    assert rows.where(~tx.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in rows.select(tx.strip(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def test_flags_for_any_case_only_for_letters_with_cases():
    patterns = ["존재하지 않는", *tx.CLEAN_RULES["zero_width_cleanup"], "<br", "[가-힣]x"]
    assert [tx._any_case(p)[:5] for p in patterns] == ["(?U)존", "(?U)[", "(?iuU", "(?iuU"]


def test_only_texts_that_begin_with_a_year_are_tried_as_timestamps(spark):
    texts = ["2024-01-05", "2024/02/07", " 2024-01-05 10:00:00 ", "2024-01-05T10:00:00Z", "2024-01-05T10:00:00+09:00", "+12024-01-05", "-2024-01-05", "24-01-05", "173665.47", "12345", "F", "", "2024.01.05", "20240105", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    tried = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in vx.TIMESTAMPS])
    assert rows.where(~vx.coerce_timestamp(F.col("t")).eqNullSafe(F.date_format(tried, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).count() == 0
    assert vx.YEAR_FIRST in rows.select(vx.coerce_timestamp(F.col("t")))._jdf.queryExecution().analyzed().toString()
