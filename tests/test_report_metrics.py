"""The metric catalogue and the basic report against plain counting."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.views import reports

DAYS = {"a": "2023-01-01", "b": "2024-05-05", "c": "2024-06-06", "d": None}


@pytest.fixture(scope="module")
def tables(spark):
    docs = [("a", "genuine_review", "x"), ("b", "genuine_review", " "), ("c", "non_review", "x"), ("d", "genuine_review", None)]
    clauses = [("a", "food", "positive"), ("b", "food", "negative"), ("b", "food", "positive"), ("c", None, "positive"), ("d", "price", "neutral"), ("z", "price", "neutral")]
    keywords = [("a", "k", "positive"), ("b", "k", "positive"), ("b", None, "positive"), ("c", "l", "positive"), ("b", "m", "negative")]
    return {
        "documents": spark.createDataFrame([(d, g, c, datetime.date.fromisoformat(DAYS[d]) if DAYS[d] else None) for d, g, c in docs], "doc_id string, genuineness string, channel string, day date"),
        "clauses": spark.createDataFrame(clauses, "doc_id string, aspect string, sentiment string"),
        "keywords": spark.createDataFrame(keywords, "doc_id string, keyword string, sentiment string"),
    }


def test_ten_metrics_of_all_years_and_the_latest(tables):
    counts = reports.count_metrics(reports.with_years(tables), [(m, False) for m in reports.METRICS] + [("aspect_sentiment", True)])
    got = {}
    for r in counts.collect():
        got.setdefault((r.metric, r.latest), {})[(r.label, r.series)] = r.n
    assert got == {
        ("genuine_docs_total", False): {(None, None): 3},
        ("genuine_docs_recent_year", True): {(None, None): 1},
        ("clauses_total", False): {(None, None): 6},
        ("clauses_recent_year", True): {(None, None): 3},
        ("sentiment_distribution", False): {("positive", None): 3, ("negative", None): 1, ("neutral", None): 2},
        ("aspect_distribution", False): {("food", None): 3, ("unknown", None): 1, ("price", None): 2},
        ("aspect_sentiment", False): {("food", "positive"): 2, ("food", "negative"): 1, ("unknown", "positive"): 1, ("price", "neutral"): 2},
        ("aspect_sentiment", True): {("food", "positive"): 1, ("food", "negative"): 1, ("unknown", "positive"): 1},
        ("channel_genuine_distribution", False): {("x", None): 1, ("unknown", None): 2},
        ("keywords_positive", False): {("k", None): 2, ("l", None): 1},
        ("keywords_negative", False): {("m", None): 1},
    }


def test_each_table_is_read_once(spark, tables, tmp_path):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    plan = reports.count_metrics(reports.with_years(read), [(m, False) for m in reports.METRICS if "recent" not in m])._jdf.queryExecution().sparkPlan().toString()
    scans = Counter(name for line in plan.splitlines() if "FileScan" in line for name in tables if f"/{name}]" in line)
    assert scans["clauses"] == scans["keywords"] == 1, plan


def test_sections_of_what_is_there(tables):
    made = reports.report_sections(reports.with_years(tables))
    rows = [tuple(r) for r in made.orderBy("section", "panel", "rank", "series").collect()]
    assert [r for r in rows if r[0] == "doc_overview"] == [
        ("doc_overview", 1, "genuine_docs_total", 1, None, None, 3, 100.0),
        ("doc_overview", 2, "genuine_docs_recent_year", 1, None, None, 1, 100.0),
        ("doc_overview", 3, "clauses_total", 1, None, None, 6, 100.0),
        ("doc_overview", 4, "clauses_recent_year", 1, None, None, 3, 100.0),
    ]
    assert [r[3:] for r in rows if r[0] == "sentiment_distribution"] == [(1, "positive", None, 2, 66.7), (2, "negative", None, 1, 33.3)]
    assert [r[1:] for r in rows if r[0] == "aspect_sentiment" and r[1] == 3] == [
        (3, "aspect_sentiment", 1, "food", "negative", 1, 50.0),
        (3, "aspect_sentiment", 1, "food", "positive", 1, 50.0),
        (3, "aspect_sentiment", 2, "unknown", "positive", 1, 100.0),
    ]
    less = reports.report_sections(reports.with_years({"documents": tables["documents"]}))
    assert {r.section for r in less.collect()} == {"doc_overview", "channel_distribution"} and less.where("metric like 'clauses%'").count() == 0
    one = (reports.Section("s", "clauses", (reports.Panel("aspect_distribution", top=1),)),)
    assert [tuple(r) for r in reports.report_sections(reports.with_years(tables), one).collect()] == [("s", 1, "aspect_distribution", 1, "food", None, 3, 50.0)]
    nothing = {n: t.where(F.lit(False)) for n, t in tables.items()}
    assert {(r.section, r.n) for r in reports.report_sections(reports.with_years(nothing)).collect()} == {("doc_overview", 0)}
    with pytest.raises(ValueError, match="no section"):
        reports.report_sections({})
