"""Token search against brute force; days under late keys; lenient JSON."""

import datetime
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from loomtext.functions import values as vx
from loomtext.operators import search


def test_rankings_equal_brute_force(spark):
    rnd = random.Random(1)
    docs = [(k, [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12))]) for k in range(200)] + [(900, None), (901, [None, "a"])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)
    index = search.TokenIndex.of(df, F.col("tokens"))
    query = ["a", "b", "b", "z"]
    asked = Counter(query)
    plain = []
    for doc, tokens in docs:
        n = Counter(t for t in tokens or [] if t)
        overlap = sum(n[t] for t in asked)
        if overlap:
            cosine = sum(n[t] * m for t, m in asked.items()) / math.sqrt(sum(x * x for x in n.values())) / math.sqrt(sum(m * m for m in asked.values()))
            plain.append((doc, overlap, round(cosine, 9)))
    for got, by in ((index.search(query, k=30), 1), (index.similar(query, k=30), 2)):
        rows = [(r["rank"], r.doc_id, r.overlap, round(r.cosine, 9)) for r in got.orderBy("rank").collect()]
        assert [r[1:] for r in rows] == sorted(plain, key=lambda p: (-p[by], p[0]))[:30] and [r[0] for r in rows] == list(range(1, 31))
    assert index.search([], k=5).count() == 0 and index.similar(["nowhere"]).count() == 0


def test_counts_in_one_aggregate(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["b"],), ([],), (None,)], "t array<string>")
    counts = search.token_counts(df, F.col("t"))
    assert {r.token: (r.n, r.docs) for r in counts.collect()} == {"a": (2, 1), "b": (2, 2)}
    assert search.token_counts(df, F.col("t"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_deltas_and_taxonomies(spark):
    now, before = (spark.createDataFrame([(w,) for w in words], "term string") for words in (["a", "a", "b", "c", None], ["b", "b", "d", "c"]))
    assert [tuple(r) for r in search.term_deltas(now, before, top=3).collect()] == [("a", 2, 0, 2), ("b", 1, 2, -1), ("d", 0, 1, -1)]
    df = spark.createDataFrame([("The food court was Open", ["food", "court", "open"]), ("nothing", ["nothing"]), ("", [])], "text string, tokens array<string>")
    rules = {"eating": ["foods", "FOOD court"], "place": ["court"], "time": ["open"], "none": [" "]}
    assert [r[0] for r in df.select(search.taxonomy_matches(F.col("text"), F.col("tokens"), rules, most=2)).collect()] == [["eating", "place"], [], []]


def test_a_day_from_the_first_key_that_has_any(spark):
    day = datetime.date(2024, 3, 5)
    rows = [("1", "", '{"작성일": "no", "date": "2024/03/05", "pub_date": null}'), ("2", None, '{"date": "x", "published_at": "2020-01-01"}'), ("3", "soon", "[1]"), ("4", "", None), ("5", "", '{"date": "2024-03-05T10:00:00Z"}')]
    df = spark.createDataFrame(rows, "id string, created_at string, source_json string")
    assert {r.id: r.day for r in vx.with_day(df).collect()} == {"1": day, "2": None, "3": None, "4": None, "5": day}
    own = vx.with_day(df.union(spark.createDataFrame([("6", "2024-03-05", "{}")], df.schema)))
    assert {r.id: r.day for r in own.collect()} == {**dict.fromkeys("12345"), "6": day}
    assert [r.day for r in vx.with_day(df.select("id")).collect()] == [None] * 5
    assert vx.with_day(df.where("id = 9")).count() == 0


def test_lenient_json(spark):
    texts = ['{"a": "True ", "b": " 7 ", "o": {"x": null, "y": null}, "l": [{"x": "1", "y": false}, null]}', '{"b": 1.5, "o": {"x": 3}}', "null", "", "no json", None, '{"b": "99999999999999999999", "o": null, "a": 1}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [r[0] and r[0].asDict(True) for r in df.select(vx.json_value(F.col("j"), "a boolean, b long, o struct<x: int, y: boolean>, l array<struct<x: string, y: boolean>>")).collect()]
    assert got == [
        {"a": True, "b": 7, "o": None, "l": [{"x": "1", "y": False}, None]},
        {"a": False, "b": None, "o": {"x": 3, "y": False}, "l": None},
        None,
        None,
        None,
        None,
        {"a": False, "b": None, "o": None, "l": None},
    ]
