"""Sentences to clauses through injected models: batches and their limits, failures, the judge, agreement, publishing."""

import os

import pytest
from pyspark.sql import functions as F

from loomtext import build, sources

ALLOWED = ["food", "place", "price"]


def test_batches_run_across_documents_under_both_limits(spark, tmp_path):
    seen = str(tmp_path)

    def echo(items):
        import os
        import uuid

        with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
            f.write(" ".join(str(len(i["sentence"] or "")) for i in items))
        return [{"key": i["key"], "n": len(i["sentence"] or "")} for i in items]

    rows = spark.createDataFrame([(k // 3, "x" * (30 if k % 17 else 500)) for k in range(101)] + [(99, None)], "doc long, sentence string").coalesce(1)
    got = build.ask(rows, echo, "n long", give=["sentence"], size_of="sentence", most_items=8, most_chars=400, each_chars=10).collect()
    calls = [[int(n) for n in open(os.path.join(seen, f)).read().split()] for f in os.listdir(seen)]
    assert sum(map(len, calls)) == 102
    assert all(len(c) <= 8 and (len(c) == 1 or sum(c) + 10 * len(c) <= 400) for c in calls) and max(map(len, calls)) == 8
    assert [r.answer.n for r in got] == [len(r.sentence or "") for r in got] and not any(r.answer_failure for r in got)


def test_answers_are_matched_by_key_and_failures_are_rows(spark):
    def odd(items):
        if any(i["sentence"] == "boom" for i in items):
            raise TimeoutError
        for i in reversed(items):
            if i["sentence"] != "skip":
                yield {"key": i["key"], "relevant": "no boolean" if i["sentence"] == "bad" else True, "sentiment": i["sentence"], "more": 1}
                yield {"key": i["key"], "relevant": False, "sentiment": "second"}
        yield "no mapping"
        yield {"key": 999}

    rows = spark.createDataFrame([(k, w) for k, w in enumerate(["a", "skip", "bad", "b", "boom", "c"])], "id long, sentence string").coalesce(1)
    got = build.ask(rows, odd, "relevant boolean, sentiment string", give=["sentence"], size_of="sentence", most_items=4).collect()
    assert [(r.sentence, r.answer and (r.answer.relevant, r.answer.sentiment), r.answer_failure) for r in got] == [
        ("a", (True, "a"), None),
        ("skip", None, "missing"),
        ("bad", None, "unreadable"),
        ("b", (True, "b"), None),
        ("boom", None, "failed: TimeoutError"),
        ("c", None, "failed: TimeoutError"),
    ]
    counts = {r.failure: r.n for r in build.failure_counts(build.ask(rows, odd, "relevant boolean", give=["sentence"], size_of="sentence", most_items=1)).collect()}
    assert counts == {"missing": 1, "unreadable": 1, "failed: TimeoutError": 1}


def test_rows_that_are_not_wanted_pass_by(spark):
    def only(items):
        assert all(i["id"] % 10 == 0 for i in items)
        return [{"key": i["key"], "x": i["id"]} for i in items]

    rows = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("yes"), F.lit("t").alias("t")).repartition(3)
    got = {r.id: r.answer.x if r.answer else None for r in build.ask(rows, only, "x long", give=["id"], size_of="t", most_items=7, wanted="yes").collect()}
    assert got == {k: k if k % 10 == 0 else None for k in range(1000)}
    assert build.ask(rows.where("id < 0"), only, "x long", give=["id"], size_of="t").count() == 0


def planted():
    def model(items):
        for i in items:
            s = i["sentence"]
            yield {"key": i["key"], "relevant": "bad" not in s, "sentiment": "positive" if "good" in s else "strange", "aspects": [w for w in s.split() if w in ("food", "price", "zoo")], "primary_area": "staff" if "staff" in s else " "}

    return model


def test_a_row_for_each_aspect_of_relevant_sentences(spark):
    docs = spark.createDataFrame([("d1", "good food price here. bad one.\nzoo again staff"), ("d2", None), ("d3", " \n."), ("d4", "none")], "row_id string, cleaned_text string")
    labelled = build.label_sentences(build.sentence_table(docs), planted(), allowed=ALLOWED, fallback="general", areas=["overall"])
    got = sorted((r.doc_id, r.sentence_index, r.sentiment, r.aspect) for r in build.clause_rows(labelled, prompt_version="p", source="s", fallback="general").collect())
    assert got == [("d1", 1, "positive", "food"), ("d1", 1, "positive", "price"), ("d1", 3, "neutral", "general"), ("d4", 1, "neutral", "general")]
    assert [r.label.primary_area for r in labelled.orderBy("doc_id", "sentence_index").collect()] == [None, None, "etc", None]


def test_spans_keep_sentences_inside(spark):
    docs = spark.createDataFrame([("d1", "a1\nb1\nc1\nd1"), ("d2", "a1\nb1")], "row_id string, cleaned_text string")
    spans = spark.createDataFrame([("d1", [(0, 1, 2), (0, 3, 4)])], "doc_id string, genuine_spans array<struct<chunk_index:int,sentence_start:int,sentence_end:int>>")
    got = sorted((r.doc_id, r.sentence_index) for r in build.sentence_table(docs, spans=spans).collect())
    assert got == [("d1", 2), ("d1", 4), ("d2", 1), ("d2", 2)]


LABELS = "struct<relevant:boolean,sentiment:string,aspects:array<string>,primary_area:string>"


def test_the_judge_settles_what_models_dispute(spark):
    yes, no = lambda mood, *aspects: (True, mood, list(aspects), None), (False, "neutral", [], None)
    cases = {
        "agreed": (yes("positive", "food"), yes("positive", "food")),
        "wider": (yes("positive", "food"), yes("neutral", "food", "place")),
        "neither": (no, no),
        "none": (None, None),
        "one": (None, yes("positive", "food")),
        "silent": (yes("positive", "food"), yes("negative", "price")),
        "drop": (yes("positive", "food"), no),
        "unknown": (yes("positive", "food"), yes("negative", "food")),
        "unsure": (yes("positive", "food"), yes("negative", "food")),
        "bare": (yes("positive", "food"), yes("negative", "food")),
        "clear": (yes("positive", "food"), yes("negative", "food")),
    }
    verdicts = {
        "one": (True, "positive", ["food"], "1"),
        "drop": (False, "negative", ["zoo"], "2"),
        "unknown": (True, "odd", ["food", "zoo"], "1"),
        "unsure": (True, "negative", ["food"], "review"),
        "bare": (True, "negative", [], "1"),
        "clear": (True, "negative", ["price", " food "], "2"),
    }

    def judge(items):
        for i in items:
            assert (i["candidate_1"] is None) + (i["candidate_2"] is None) <= 1
            if i["sentence"] in verdicts:
                relevant, mood, aspects, chosen = verdicts[i["sentence"]]
                yield {"key": i["key"], "relevant": relevant, "sentiment": mood, "aspects": aspects, "chosen": chosen, "reason": None}

    pairs = spark.createDataFrame([(k, 1, s, a, b) for k, (s, (a, b)) in enumerate(cases.items())], f"doc_id long, sentence_index int, sentence string, a {LABELS}, b {LABELS}")
    settled = build.judge_sentences(pairs, judge, allowed=ALLOWED, most_disputed=3, most_chars=200)
    got = {r.sentence: (r.outcome, r.sentiment, r.aspects, r.resolution, r.needs_review) for r in settled.collect()}
    assert got == {
        "agreed": ("final", "positive", ["food"], "agree", False),
        "wider": ("final", "positive", ["food", "place"], "union", False),
        "neither": ("drop", None, None, None, False),
        "none": ("review", None, None, "classify_missing", True),
        "one": ("final", "positive", ["food"], "judge", False),
        "silent": ("review", "neutral", ["food", "price"], "needs_review", True),
        "drop": ("drop", "negative", [], "judge", False),
        "unknown": ("review", "neutral", ["food"], "needs_review", True),
        "unsure": ("review", "negative", ["food"], "needs_review", True),
        "bare": ("review", "negative", [], "needs_review", True),
        "clear": ("final", "negative", ["price", "food"], "judge", False),
    }
    rows = build.verified_clauses(settled, fallback="general", prompt_version="p").collect()
    assert sorted((r.clause, r.aspect) for r in rows if r.clause in ("bare", "clear", "none", "drop", "wider")) == [("bare", "general"), ("clear", "food"), ("clear", "price"), ("wider", "food"), ("wider", "place")]


def test_area_agreement(spark):
    rows = [("d", 1, "x", "overall", "overall"), ("d", 1, "y", "overall", "overall"), ("d", 2, "x", "staff", "overall"), ("e", 1, "x", "overall", "staff"), ("e", 2, "x", "", "staff"), ("e", 3, "x", None, "a"), ("e", 4, "x", "staff", "room")]
    df = spark.createDataFrame(rows, "doc_id string, sentence_index int, aspect string, a string, b string")
    clauses = df.select("doc_id", "sentence_index", "aspect", F.struct(F.col("a").alias("primary_area")).alias("model_a_result"), F.struct(F.col("b").alias("primary_area")).alias("model_b_result"))
    r = build.area_agreement(clauses).first()
    assert (r.both_count, r.agree_count, r.agreement_rate, r.overall_ratio_a) == (4, 1, 0.25, 0.5)
    assert [tuple(x) for x in r.distribution_model_a] == [("overall", 2), ("staff", 2)]
    assert [tuple(x) for x in r.confusion_top] == [("overall↔staff", 2), ("room↔staff", 1)]
    none = build.area_agreement(clauses.where("doc_id = 'z'")).first()
    assert (none.both_count, none.agree_count, none.agreement_rate, none.confusion_top) == (0, 0, None, [])


@pytest.mark.parametrize(("bad", "published"), [(4, True), (5, False), (10, False)])
def test_a_failing_classifier_leaves_no_table(spark, tmp_path, bad, published):
    def classify(texts):
        if int(texts[0]) < bad:
            raise ConnectionError
        return [{"label": "uncertain"} for _ in texts]

    docs = spark.createDataFrame([(str(k), str(k)) for k in range(10)], "doc_id string, text string").repartition(3)
    labels = build.label_texts(docs, classify, batch=1)
    path = f"{tmp_path}/labels"
    go = lambda: sources.publish(labels, path, failed=F.col("reason").startswith("failed:"))
    if published:
        assert go().count() == 10
        with pytest.raises(FileExistsError):
            go()
    else:
        with pytest.raises(sources.FailureShareExceeded, match=f"{bad} of 10"):
            go()
    assert os.listdir(tmp_path) == (["labels"] if published else [])


def test_an_empty_build_is_published(spark, tmp_path):
    assert sources.publish(spark.range(0), f"{tmp_path}/x", failed=F.lit(True)).count() == 0
