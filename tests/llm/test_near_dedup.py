"""Operator 4 against all pairs by brute force, with copies, chains, hot groups and empty texts."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from loomtext.llm import near_dedup as nd
from loomtext.llm.shingles import shingle_sets


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text, width):
    w = words_of(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain(rows, width, percent):
    """(doc_id, set size, component id) by comparing all pairs that share a shingle."""
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    of = lambda i: min((d for d in least[find(i)] if d is not None), default=None)
    return sorted(((d, len(sets[i]), of(i)) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = ["", " \n", "one", "one two", "Ünïcode WORD Here", "one", None]
    for _ in range(25):
        texts.append(" ".join(prose(rnd.randint(3, 300))))
    hot = prose(150)
    for _ in range(60):  # near copies, some linked only through others
        copy = list(hot)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        texts.append(" ".join(copy).upper() if rnd.random() < 0.2 else " \n".join(copy))
    chain = prose(120)
    for _ in range(8):
        texts.append(" ".join(chain))
        for _ in range(2):
            chain[rnd.randrange(len(chain))] = rnd.choice(vocabulary)
    texts += [" ".join(hot)] * 40
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return [*rows, (None, "no id at all here"), (3, "one two"), (None, " ".join(hot))]


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, None), (5, 80, 16)])
def test_components_like_all_pairs(spark, monkeypatch, width, percent, block):
    if block:  # groups over two blocks take the way of pairs of blocks
        monkeypatch.setattr(nd, "SKETCH_BLOCK", block)
        monkeypatch.setattr(nd, "SET_BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, root int").repartition(3)
    got = nd.near_dedup(docs, width=width, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_shingles_are_those_of_words():
    texts = ["a b c d", "A B  C\tD", "a", "a b", "", "\x0b", "x\x00y z w", "ab c d", "a bc d"] + ["w " * 5000]
    for width in (3, 5):
        sets = [frozenset(s.tolist()) for s in shingle_sets([t.encode() for t in texts], width)]
        expected = [plain_set(t, width) for t in texts]
        assert [len(s) for s in sets] == [len(s) for s in expected]
        for a, x in zip(sets, expected, strict=True):
            for b, y in zip(sets, expected, strict=True):
                assert (a == b) == (x == y)


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        values = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
        common = rng.integers(500, 2500)
        a, b = values[:common], np.concatenate([values[200:common], values[common : common + 200]])
        a, b = np.sort(a), np.sort(b)
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(nd.sketch(v), "<u2") for v in (a, b))
        errors.append(nd.estimates(x, y[None, :], len(a), np.array([len(b)]))[0][0] - truth)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def test_a_forest_joins_what_links_join():
    rnd = random.Random(9)
    links = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(30)}
    linked = lambda i, rest: np.array([(i, k) in links or (k, i) in links for k in rest.tolist()], bool)
    edges = nd.forest(40, linked)
    parent = list(range(40))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    other = list(range(40))
    for a, b in edges:
        assert find(parent, a) != find(parent, b)
        parent[find(parent, a)] = find(parent, b)
    for a, b in links:
        other[find(other, a)] = find(other, b)
    assert all((find(parent, a) == find(parent, b)) == (find(other, a) == find(other, b)) for a in range(40) for b in range(40))


def test_empty_table(spark):
    assert nd.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
