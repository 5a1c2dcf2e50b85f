"""Operator 11 against all pairs by brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import spelling as sp


def plain_words(rows, drop):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, drop=None):
    words = plain_words(rows, drop)
    best = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        top = min(close, key=lambda x: (-words[x], x), default=None)
        best[w] = (top if top and words[top] >= 5 * n else None, len(close))
    out = []
    for w, n in words.items():
        form, close = best[w]
        root = w
        while best[root][0]:
            root = best[root][0]
        out.append((w, form, root, n, close, words[form] if form else None))
    return sorted(out)


def corpus(seed, size):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice(["en", "th", "on", "é", "ß", "a", "÷", "r"]) for _ in range(rnd.randint(3, 7))) for _ in range(size)]
    texts = [None, "", " \n", "short words only", "a" * 30_000 + " x"] + ["Z" * 40_000 + " " + "Z" * 40_001] * 6
    for k in range(size):
        w = list(stems[rnd.randrange(len(stems))])
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "e", "n", "ÿ", "q"])
        texts.append(" ".join([("".join(w)).title()] * rnd.choice([1, 5, 5, 30]) + [stems[k]] * rnd.choice([5, 26, 200])))
    return [*enumerate(texts), (None, texts[-1]), (7, texts[-1]), (7, texts[-1])]


@pytest.mark.parametrize(("cell", "sample"), [(1000, 50_000), (8, 100), (8, 50_000)])
def test_words_like_all_pairs(spark, cell, sample):
    rows = corpus(3, 250)
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n string, word int").repartition(3)
    got = sp.spelling_variants(docs, drop_one_in=7, cell=cell, sample=sample).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == plain(rows, 7)
    assert any(r.root != r.form for r in got if r.form) and any(r.n_near == 0 for r in got)


def test_a_tree_finds_all_that_is_near():
    rnd = random.Random(5)
    words = list({"".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 8))).encode("latin-1") for _ in range(1500)})
    found = Counter((q, p) for a, b in sp.near_pairs(words, words, leaf=4) for q, p in zip(a.tolist(), b.tolist(), strict=True))
    assert max(found.values()) == 1  # each pair once
    text = [w.decode("latin-1") for w in words]
    few = rnd.sample(range(len(words)), 60)
    for i in few:
        assert {p for q, p in found if q == i} == {j for j in range(len(text)) if near(text[i], text[j])}


def test_search_prunes_boxes():
    counts = np.array([[k % 10, k // 10] for k in range(100)], "i2")
    tree = sp.KdTree(counts, 4)
    visits = sum(len(at) for _, at in tree.search(counts, 1, 1))
    assert visits < 100 * len(tree.rows) / 3


def test_chains_end_at_their_root(spark):
    chain = [("w1", "w2"), ("w2", "w3"), ("w3", "w4"), ("w4", "w5"), ("w5", "w6"), ("x", "w3")]
    got = {r.word: r.root for r in sp.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == dict.fromkeys(["w1", "w2", "w3", "w4", "w5", "x"], "w6")


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "tiny")]):
        assert sp.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
