"""The pipeline's stages: each works on what the one before kept, and its decisions take effect."""

import random

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    rnd = random.Random(12)
    words = [f"word{k}" for k in range(500)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    paragraphs = lambda: "\n".join(prose(30) for _ in range(6))
    out = [(i, paragraphs(), "en", f"s{i % 2}", 0) for i in range(30)]
    near = out[3][1].split(" ")
    near[7] = "changed"
    passage = "\n".join(prose(20) for _ in range(14))
    return [
        *out,
        (100, out[2][1], "en", "s0", 0),
        (101, " ".join(near).replace("\n", " "), "en", "s1", 0),
        (102, out[3][1].replace("\n", " "), "en", "s1", 0),
        (103, "too short", "en", "s0", 0),
        (104, prose(8) * 1 + " same same" * 60, "en", "s0", 0),
        (105, prose(60) + " mail ann.lee@mail.example.com now", "en", "s1", 0),
        (106, paragraphs() + "\n" + passage, "en", "s1", 0),
        (107, paragraphs() + "\n" + passage + "\n" + prose(40), "en", "s0", 0),
        (108, None, "en", None, 0),
    ]


def test_stages(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, ""), name)
        assert docs.columns == COLUMNS
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.where("n_chars <> length(text)").count() == 0
    clean = set(range(30)) - {3}
    assert seen["quality_rules"].keys() == {r[0] for r in rows()} - {103, 104, 108}
    assert clean <= seen["near_dedup"].keys()
    assert len(seen["line_dedup"][107]) < len(seen["quality_rules"][107]) - 800 and seen["line_dedup"][106] == seen["quality_rules"][106]
    assert len({3, 101, 102} & seen["near_dedup"].keys()) == 1
    assert "<email>" in seen["personal_data"][105] and all(seen["personal_data"][i] == seen["near_dedup"][i] for i in clean)
    pieces = cp.STAGES[-1][1](spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == seen["personal_data"].keys()


def test_odd_rows_go_through_all_stages(spark):
    good = rows()[0][1]
    odd = [
        (1, good, None, None, None, 5, "x"),
        (1, good, None, None, None, 5, "x"),
        (None, good.replace("word1", "other"), "en", "s", 1, None, None),
        (2, "", "en", "s", 0, 1, "y"),
        (3, None, None, None, None, None, None),
        (4, " \n\t ", "en", "s", 4, 1, "y"),
        (5, "\n".join(f"long line number {k} with its own words a{k} b{k}" for k in range(20_000)), "en", "s", 0, 1, "y"),
    ]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string")
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in cp.STAGES[:-1]:
            kept = cp.stored(stage(spark, kept, ""), name)
            assert kept.columns == COLUMNS
        ids = sorted((r.doc_id or 0) for r in kept.collect())
        pieces = cp.STAGES[-1][1](spark, kept, "").collect()
        assert ids == ([0, 1, 5] if table is docs else []) and {p.doc_id or 0 for p in pieces} == set(ids)


def test_the_stages_are_those_of_the_contract():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "personal_data", "packing"] and cp.ORACLE_SQL is None
