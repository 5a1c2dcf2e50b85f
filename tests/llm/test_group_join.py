"""Operator 13 against all pairs by brute force, with copies, chains, passages that many share, and hot groups."""

import random

import pytest

from loomtext.llm import group_join as gj

from .test_near_dedup import corpus, plain


def more(rows):
    rnd = random.Random(7)
    vocabulary = [f"v{k}" for k in range(900)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage = prose(70)
    texts = []
    for k in range(60):  # half a document is the same passage, the rest its own
        texts.append(" ".join(prose(30) + passage + prose(30)))
        texts.append(" ".join(passage + prose(14 + k % 5)))  # at the edge of the threshold with each other
    for base in (prose(100), prose(400)):
        for _ in range(40):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), rnd.randint(0, 3)):
                copy[at] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
            texts.append(" ".join(copy[: rnd.randint(75, 100) * len(copy) // 100]))
    return rows + [(1000 + k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent", "small"), [(5, 80, False), (5, 80, True), (3, 60, True), (2, 100, False)])
def test_components_like_all_pairs(spark, monkeypatch, width, percent, small):
    if small:  # groups, and the queries of one, in several tasks
        for name, value in (("MEMBERS", 3), ("TOKENS", 500), ("QUERIES", 4)):
            monkeypatch.setattr(gj, name, value)
    rows = more(corpus())
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, n int").repartition(3)
    rounds = 0 if small else 2  # without star rounds all links come from opened groups
    got = gj.similar_documents(docs, width=width, percent=percent, star_rounds=rounds).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows, width, percent)


@pytest.mark.parametrize("percent", [50, 80, 93, 100])
def test_similar_sets_share_what_the_sieves_ask_for(percent):
    rnd = random.Random(percent)
    for _ in range(400):
        n = rnd.randint(1, 60)
        both = -(-n * percent // 100)
        a, b = set(range(n)), set(range(n - both, n)) | {1000 + k for k in range(rnd.randint(0, 12))}
        if 100 * len(a & b) < percent * len(a | b):
            continue
        place = {x: rnd.random() for x in a | b}
        cut = lambda s, place=place: set(sorted(s, key=place.get)[: len(s) - gj.required(len(s), percent) + gj.spare(len(s), percent)])
        common = len(cut(a) & cut(b))
        assert common >= max(gj.spare(gj.required(len(s), percent), percent) for s in (a, b))


def test_texts_of_megabytes_and_empty_tables(spark):
    long = " ".join(f"x{k}" for k in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "y " + long[: len(long) // 2]), (4, None), (5, "")]
    got = gj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert gj.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
