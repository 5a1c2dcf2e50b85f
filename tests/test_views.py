"""Dashboards, overlays, reports, exports and files on small tables with known answers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext import sources
from loomtext.views import dashboards, exports, overlay, reports


@pytest.fixture(scope="module")
def keywords(spark):
    rows = [
        ("d1", "d1-0", "good food", "food", "food", "positive", 1),
        ("d1", "d1-0", "good food", "good", "food", "positive", 2),
        ("d2", "d2-0", "good food", "food", "food", "positive", 1),
        ("d2", "d2-1", "long queue at gate", "queue", "operation", "negative", 1),
        ("d3", "d3-0", "dear food", "dear", "food", "negative", 1),
    ]
    return spark.createDataFrame(rows, "doc_id string, clause_id string, clause string, keyword string, aspect string, sentiment string, keyword_rank_in_clause long")


def test_keyword_dashboard(keywords):
    assert tuple(dashboards.keyword_totals(keywords).first()) == (5, 4, 4, 3)
    assert [tuple(r) for r in dashboards.top_keywords(keywords, "positive", 2).collect()] == [("food", 2), ("good", 1)]
    food = dashboards.keyword_table(keywords).where("keyword = 'food'").first()
    assert tuple(food)[1:6] == (2, 2, "positive", 1.0, "food") and food.representative_clause == "good food"
    grouped = {r.clause: (list(r.keywords), r.occurrence_count) for r in dashboards.keywords_by_clause(keywords, query="GOOD").collect()}
    assert grouped == {"good food": (["food", "good"], 2)}
    assert {(r.keyword, r.weight) for r in dashboards.word_cloud(keywords).where("aspect = 'food' and sentiment = 'positive'").collect()} == {("food", 1.0), ("good", 0.5)}


def test_rules(keywords):
    rules = [
        {"rule_type": "block", "source_term": "dear", "active": True},
        {"rule_type": "synonym", "source_term": "good", "target_term": "food", "active": True},
        {"rule_type": "synonym", "source_term": "dear", "target_term": "food", "active": True},
        {"rule_type": "block", "source_term": "queue"},
    ]
    assert sorted(r.keyword for r in overlay.apply_rules(keywords, rules).collect()) == ["food", "food", "food", "queue"]
    assert overlay.apply_rules(keywords, []).count() == 5


def test_matrix_fills_sentiments(spark):
    df = spark.createDataFrame([("a", "positive"), ("a", "positive"), ("a", None), (" ", "negative")], "aspect string, sentiment string")
    got = {(r.aspect, r.sentiment): (r.n, r.percent) for r in dashboards.aspect_matrix(df).collect()}
    assert got[("a", "positive")] == (2, 66.7) and got[("a", "neutral")] == (0, 0.0) and got[("a", "unknown")] == (1, 33.3) and got[("unknown", "negative")] == (1, 100.0)


@pytest.fixture(scope="module")
def labelled(spark):
    labels = spark.createDataFrame([("a", "genuine_review", "r"), ("b", "non_review", None), ("c", "genuine_review", None)], "doc_id string, genuineness string, reason string")
    clean = spark.createDataFrame([("b", "tb", '{"u": "http://x.y"}', 0), ("a", "ta", None, 1)], "row_id string, cleaned_text string, source_json string, source_row_index long")
    return labels, clean


def test_label_view_and_overrides(spark, labelled):
    labels, clean = labelled
    assert [(r.doc_id, r.source_url) for r in dashboards.genuineness_view(labels, clean).collect()] == [("b", "http://x.y"), ("a", ""), ("c", None)]
    assert dashboards.genuineness_view(labels, clean, limit=1, offset=2).first().doc_id == "c"
    changes = spark.createDataFrame([("a", "non_review", None)], "doc_id string, override_genuineness string, override_reason string")
    got = {r.doc_id: (r.genuineness, r.reason, r.overridden) for r in overlay.override_labels(labels, changes).collect()}
    assert got == {"a": ("non_review", "r", True), "b": ("non_review", None, False), "c": ("genuine_review", None, False)}
    assert {r.label: (r.n_before, r.n_after, r.crossed) for r in overlay.count_shift(labels, changes).collect()} == {"genuine_review": (2, 1, 1), "non_review": (1, 2, 1)}


def test_run_agreement_against_truth(spark, labelled):
    other = spark.createDataFrame([("a", "non_review"), ("b", "non_review"), ("z", "non_review")], "doc_id string, genuineness string")
    r = dashboards.agreement(labelled[0], other, truth=other).first()
    assert (r.compared, r.matched, r.agreement, r.accuracy_a, r.accuracy_b, r.verdict) == (2, 1, 0.5, 0.5, 1.0, "ground_truth")
    assert {(x.presence, x.n) for x in dashboards.compare_runs(labelled[0], other).collect()} == {("both", 1), ("only_a", 1), ("only_b", 1)}


def test_panels_and_reports(spark, labelled):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    assert [(r.label, r.n, r.percent) for r in reports.distribution_panel(df, "c", order=["y"], top=2).collect()] == [("y", 1, 25.0), ("x", 2, 50.0)]
    assert [tuple(r) for r in reports.rank_panel(df, "c").collect()] == [(1, "x", 2), (2, "y", 1)]
    report = reports.Report().add("counts", ["labels"], lambda t: dashboards.counts(t, "genuineness")).add("missing", ["nowhere"], lambda t: t)
    scope = spark.createDataFrame([("a",)], "doc_id string")
    made = report.build({"labels": labelled[0]}, scope=scope)
    assert set(made) == {"counts"} and [tuple(r) for r in made["counts"].collect()] == [("genuine_review", 1)]


def test_exports(labelled):
    assert [r.doc_id for r in exports.genuineness_rows(*labelled).collect()] == ["b", "a", "c"]
    assert [r.doc_id for r in exports.genuineness_rows(labelled[0], None).collect()] == ["a", "b", "c"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi"\nthere'), (1, None)], "id long, t string")
    sources.write_csv(df, f"{tmp_path}/x.csv", ["id"], one_file=True)
    assert [tuple(r) for r in sources.read_rows(spark, f"{tmp_path}/x.csv").collect()] == [("1", None), ("2", 'say "hi"\nthere')]
    sources.write_jsonl(df, f"{tmp_path}/x.jsonl", ["id"])
    assert sources.READERS["jsonl"](spark, f"{tmp_path}/x.jsonl", "t string, id long").columns == ["t", "id"]
    sources.write_parquet(df.limit(0), f"{tmp_path}/x.parquet", ["id", "more"])
    assert sources.read_rows(spark, f"{tmp_path}/x.parquet").columns == ["id", "more"]
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n\n[2]\nbroken\n{"a": 3}\n')
    assert sorted(r.a for r in sources.read_rows(spark, f"{tmp_path}/y.jsonl").collect()) == [1, 3]
    (tmp_path / "y.txt").write_text(" one \ntwo　\n")
    assert [r.text for r in sources.read_rows(spark, f"{tmp_path}/y.txt").collect()] == ["one", "two"]
    (tmp_path / "y.tsv").write_text("a\tb\n1\t2.5\n")
    seen = sources.preview(spark, f"{tmp_path}/y.tsv")
    assert (seen["status"], seen["row_count"], seen["columns"]) == ("ready", 1, [("a", "int"), ("b", "double")])
    assert sources.preview(spark, f"{tmp_path}/none.csv")["status"] == "missing" and sources.source_status(spark, f"{tmp_path}/y.doc") == "unsupported"
    assert sources.sound_file(spark, f"{tmp_path}/x.jsonl") and not sources.sound_file(spark, f"{tmp_path}/none.jsonl")
    with pytest.raises(ValueError, match="unsupported"):
        sources.read_rows(spark, "x.doc")


def test_workbook(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f"""<worksheet xmlns="{main}"><sheetData>
    <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t></t></is></c><c r="C1" t="s"><v>1</v></c></row>
    <row r="2"><c r="A2"><v>7</v></c><c r="B2"><v>9</v></c></row><row r="3"/><row r="4"><c r="C4" t="s"><v>2</v></c></row></sheetData></worksheet>"""
    strings = f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>본</t></r><r><t>문</t></r></si><si><t>값</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", strings)
    df = sources.read_rows(spark, f"{tmp_path}/w.xlsx")
    assert df.columns == ["id", "본문"] and sorted(map(tuple, df.collect())) == [("", "값"), ("7", "")]
    other = f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="AB1" t="inlineStr"><is><t>far</t></is></c></row><row r="2"><c r="AB2"><v>5</v></c></row></sheetData></worksheet>'
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as z:  # the second file is the first sheet
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", other)
        z.writestr("xl/sharedStrings.xml", strings)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="b" sheetId="2" r:id="r2"/><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
    assert [r.asDict() for r in sources.read_rows(spark, f"{tmp_path}/o.xlsx").collect()] == [{"far": "5"}]


def test_json_lines_in_the_jvm_and_split_csv(spark, tmp_path):
    (tmp_path / "y.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n{"a": 2.5}\n  {"b": null}  \n{"a": broken}\n"text"\n')
    df = sources.read_rows(spark, f"{tmp_path}/y.jsonl")
    assert sorted((r.a or 0, r.b and r.b.c) for r in df.collect()) == [(0, None), (1.0, "x"), (2.5, None)]
    assert "RDD" not in df._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "z.csv").write_text('a,b\n1,"x, ""y"""\n2,\n')
    from loomtext.sources.read import read_csv

    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/z.csv", multi_line=False).collect()] == [("1", 'x, "y"'), ("2", None)]


def test_provenance_ignores_the_order_of_inputs():
    a, b = (sources.provenance("clean", model="m", inputs=i) for i in (["x", "y"], ["y", "x"]))
    assert a["hash"] == b["hash"] != sources.provenance("clean", model="n", inputs=["x", "y"])["hash"]


def test_page_limits(spark):
    df = spark.range(1500)
    assert dashboards.page(df, [F.col("id")], 0).count() == 100 and dashboards.page(df, [F.col("id")], 5000, -3).count() == 1000
