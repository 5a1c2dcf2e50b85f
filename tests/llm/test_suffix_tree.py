"""Operator 6 against a plain scorer of the same tree, and on held-out text that has context."""

import math
import random
import zlib
from collections import Counter

import pytest

from loomtext.llm import suffix_tree
from loomtext.llm.shared import stored
from loomtext.llm.suffix_tree import count_words, held_out, suffix_tree_scores, train_tree


def corpus():
    rnd = random.Random(6)
    follow = {a: [rnd.choice("abcdefgh") for _ in range(2)] for a in "abcdefgh"}
    out = []
    for i in range(120):
        word, text = "a", []
        for _ in range(rnd.randint(0, 120)):
            text.append(word.upper() if rnd.random() < 0.1 else word)
            word = rnd.choice(follow[word]) if rnd.random() < 0.9 else f"rare{rnd.randrange(300)}"
            word = word if word in follow else rnd.choice("abcdefgh") if rnd.random() < 0.5 else "h"
        out.append((i, " ".join(text) + (f" rare{i % 50} É\x0b x" if i % 4 == 0 else "")))
    return [*out, (900, None), (901, ""), (None, "a b c"), (5, "a b"), (902, "a " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.0, 1) for i, t in corpus()], "doc_id long, text string, score double, word int").repartition(3)


def test_base_scores_like_a_plain_version_and_a_better_score(docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for i, t in corpus() if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    log = lambda w: math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1)))
    got = suffix_tree_scores(docs).collect()
    key = lambda r: (str(r[0]), r[1])
    expected = sorted(((i, len(tokens(t)), held(i), sum(counts[w] > 0 for w in tokens(t)), sum(map(log, tokens(t)))) for i, t in corpus()), key=key)
    for r, (i, n, out, known, base) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), expected, strict=True):
        assert (r.doc_id, r.n_tokens, r.held_out, r.n_known, r.train_tokens) == (i, n, out, known, total)
        assert r.base_score == pytest.approx(base)
    unseen = [r for r in got if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) + 50


def test_each_state_is_a_distribution(docs):
    train = docs.where(~held_out(docs["doc_id"])).selectExpr("coalesce(text, '') text")
    model = train_tree(train, stored(count_words(train), "t"), depth=3, divergence=1.0, min_count=5)
    held = []
    for level in model.levels:
        m = {r.context: r.n for r in level.states.collect()}
        rest = {r.context: r.rest for r in level.states.collect()}
        held.append(len(rest))
        for r in level.entries.collect():
            assert 0 < r.ratio and 1 < r.n <= m[r.context]
            rest[r.context] += (r.n - 1) / m[r.context]
        assert all(v == pytest.approx(1) for v in rest.values())
    assert held[0]


def test_without_training_text(spark):
    one = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = suffix_tree_scores(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert suffix_tree_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hand", [10**6, 150])
def test_like_a_plain_tree_over_all_words(spark, monkeypatch, hand):
    """Contexts and words far under any share of the tokens count: 400 words seen 12 times each, by a plain version of the tree.

    hand: rows of a table at hand. With few or none of them, words, states and entries are joined; scores stay as they are."""
    monkeypatch.setattr(suffix_tree, "AT_HAND", hand)
    rnd = random.Random(9)
    texts = [(i, " ".join(f"w{x} then{x % 20} and z{x if rnd.random() < 0.8 else rnd.randrange(400)} u{rnd.randrange(900)}" for x in rnd.sample(range(400), 80))) for i in range(75)]
    texts += [(2000, None), (2001, "w1 then1"), (None, " w1 then1\x0b z1 never then2 z3 then2 w9 "), (None, "w1 then1 z1"), (3, "w5 then5 z5"), (3, "w5 then5 z5")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: (*(t or "").split(), "")
    train = [tokens(t) for i, t in texts if not held(i)]
    counts = Counter(w for ws in train for w in ws)
    total = sum(counts.values())
    alone = lambda w: (counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))
    tree: dict = {}
    for ws in train:
        for k in (1, 2, 3):
            for t in range(k, len(ws)):
                tree.setdefault(ws[t - k : t], Counter())[ws[t]] += 1
    states: set = set()

    def p(c, w):
        if not c:
            return alone(w)
        if c not in states:
            return p(c[1:], w)
        m = sum(tree[c].values())
        return max(0, tree[c][w] - 1) / m + len(tree[c]) / m * p(c[1:], w)

    for k in (1, 2, 3):
        for c in [c for c in tree if len(c) == k and sum(tree[c].values()) >= 5 and (k == 1 or c[1:] in states)]:
            m, gain = sum(tree[c].values()), 0.0
            for w, n in tree[c].items():
                distinct = len(tree[c]) - (n == 1)  # without one occurrence of w
                left = max(0, n - 2) / (m - 1) + distinct / (m - 1) * p(c[1:], w)
                gain += n * math.log(left / p(c[1:], w)) if left else 0.0
            if max(tree[c].values()) > 1 and gain > math.log(total):
                states.add(c)

    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in suffix_tree_scores(docs).collect())
    assert {len(c) for c in states} == {1, 2, 3} and len(states) > 400
    plain = sorted((str(i), len(tokens(t)), sum(math.log10(p(tokens(t)[max(0, k - 3) : k], w)) for k, w in enumerate(tokens(t)))) for i, t in texts)
    assert len(got) == len(plain)
    for g, e in zip(got, plain, strict=True):
        assert g[:2] == e[:2] and g[2] == pytest.approx(e[2])


def test_open_symbols_leave_in_packs(spark, monkeypatch):
    """Next symbols whose entries aren't at hand are no rows: 300 words after each of two, half of whose entries may be open."""
    monkeypatch.setattr(suffix_tree, "AT_HAND", 310)
    seen = {}
    monkeypatch.setattr(suffix_tree, "stored", lambda df, name, *more: seen.setdefault(name, []).append(out := stored(df, name)) or out)
    rnd = random.Random(4)
    texts = [(i, " ".join(f"{'ab'[i % 2]} x{k}" for k in rnd.sample(range(300), 150))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    assert suffix_tree_scores(docs).count() == 80
    assert seen["parts"][0].count() < 2_000  # packs and texts; 24,080 symbols


def test_words_leave_in_packs_and_slices_change_nothing(spark, monkeypatch):
    """Words that aren't at hand are no rows: 80 texts of 200 words, of which each is in two texts. Joins and requests in three slices."""
    texts = [(i, " ".join(f"a b c x{i // 2}y{k} b c" for k in range(200))) for i in range(80)] + [(None, "a b c"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    key = lambda r: (str(r.doc_id), r.n_tokens)
    whole = sorted(suffix_tree_scores(docs).collect(), key=key)
    monkeypatch.setattr(suffix_tree, "AT_HAND", 100)
    monkeypatch.setattr(suffix_tree, "SLICE", 1_000, raising=False)
    seen = {}
    monkeypatch.setattr(suffix_tree, "stored", lambda df, name, *more: seen.setdefault(name, []).append(out := stored(df, name)) or out)
    sliced = sorted(suffix_tree_scores(docs).collect(), key=key)
    assert sum(x.count() for x in seen["parts"]) < 2_000  # 16,000 pairs of a text and a word
    assert len(seen["parts"]) == 3
    for a, b in zip(whole, sliced, strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known, a.held_out, a.train_tokens) == (b.doc_id, b.n_tokens, b.n_known, b.held_out, b.train_tokens)
        assert (a.base_score, a.score) == (pytest.approx(b.base_score), pytest.approx(b.score))


def test_packs_give_back_their_records():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (1, 2, 1000):
        key = np.sort(rnd.integers(-(1 << 63), (1 << 63) - 1, n))
        key[[0, -1]] = -(1 << 63), (1 << 63) - 1 if n > 1 else -(1 << 63)
        other, mixed_up = rnd.integers(-5, 5, n), rnd.permutation(n)
        assert [x.tolist() for x in suffix_tree.opened(suffix_tree.squeezed([key, other]), 2)] == [key.tolist(), other.tolist()]
        got = zip(*suffix_tree.opened(suffix_tree.squeezed([key[mixed_up], other[mixed_up]]), 2), strict=True)
        assert sorted(got) == sorted(zip(key.tolist(), other.tolist(), strict=True))
