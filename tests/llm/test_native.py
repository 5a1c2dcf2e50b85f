"""Operators 2 and 9 against plain versions, and that their plans hold no Python."""

import hashlib
import random
import re
import time
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from loomtext.llm.line_dedup import line_dedup
from loomtext.llm.quality import quality

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def texts():
    rnd = random.Random(8)
    w = [f"w{k}" for k in range(60)]
    line = lambda: " ".join(rnd.choice(w) for _ in range(rnd.randint(0, 12)))
    shared = [[line() for _ in range(12)] for _ in range(4)] + [["", "", "\t"]] * 2 + [[" ".join(f"p{k}x{j}" for j in range(55))] for k in range(2)]
    out = []
    for _ in range(60):
        lines = [line() for _ in range(rnd.randint(1, 8))]
        if rnd.random() < 0.6:
            at = rnd.randint(0, len(lines))
            lines[at:at] = rnd.choice(shared)
        out.append("\n".join(lines))
    return [*out, "", " \n ", "a b c d e f g h " * 30, "one\ttwo\x0bthree", "#*$ %&|<> x" * 20, out[0], out[0], "x " * 50_000]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (None, "no id\nwith lines\nand more"), (700, None), (3, "other text under a used id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "h" if (i or 0) % 3 else None, 9, 8) for i, t in rows], "doc_id long, text string, source string, n_lines int, kept int").repartition(3)


def plain_chunks(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    at = lambda k: h[k] if k >= 0 else 0
    long = [len(x) >= 19 and x.count(" ") >= 9 for x in lines] + [False]
    ends = [k for k in range(len(h)) if (at(k) + 31 * at(k - 1) + 961 * at(k - 2)) % 4 == 0 or long[k] or long[k + 1] or k == len(h) - 1]
    return [lines[a + 1 : b + 1] for a, b in zip([-1, *ends[:-1]], ends, strict=True)]


def test_line_dedup_like_a_plain_version(docs, rows):
    from_spark = {(r.doc_id, r.t): r.h for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    seen, left = set(), {}
    distinct = {(i, t or "") for i, t in rows}
    for i, t in sorted(distinct, key=lambda x: (x[0] is None, x[0] or 0, from_spark[x])):
        chunks = plain_chunks(t)
        keys = ["\n".join(c) for c in chunks]
        again = []
        for key in keys:
            again.append(bool(words(key)) and key in seen)
            seen.add(key)
        gone = set()
        for old, run in groupby(range(len(keys)), lambda k: again[k]):
            run = list(run)
            if old and (any(len(chunks[k]) > 1 for k in run) or sum(len(re.split("[ \n]", keys[k])) for k in run) >= 40):
                gone.update(run)
        left[i, t] = "\n".join(key for k, key in enumerate(keys) if k not in gone)
    got = line_dedup(docs.withColumn("was", F.coalesce("text", F.lit("")))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == left[r.doc_id, r.was]
        assert r.n_lines == len(r.was.split("\n")) and r.n_chunks == len(plain_chunks(r.was))
    assert sum(r.removed_lines for r in got) > 50


def plain_quality(rows, min_docs, share, lost):
    by_host = {}
    for i, t in rows:
        by_host.setdefault("h" if (i or 0) % 3 else "", set()).add(t or "")
    norm = lambda line: " ".join(words(line)).lower()
    frequent = {}
    for host, ts in by_host.items():
        counts = {}
        for t in ts:
            for n in {norm(x) for x in t.split("\n") if words(x)}:
                counts[n] = counts.get(n, 0) + 1
        frequent[host] = {n for n, c in counts.items() if c > min_docs and c > share * len(ts) ** 0.5}
    out = []
    for i, t in rows:
        t = t or ""
        w, lines = words(t), t.split("\n")
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        times = {}
        for x in wins:
            times[x] = times.get(x, 0) + 1
        covered = {k + d for k, x in enumerate(wins) if times[x] > 1 for d in range(8)}
        real = [x for x in lines if words(x)]
        bad = frequent["h" if (i or 0) % 3 else ""]
        gone = [x for x in real if norm(x) in bad]
        n_lost = sum(len(words(x)) for x in gone)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(real) - len(set(real)), len(covered), failed, len(gone), n_lost, not failed and n_lost <= lost * len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_docs", "share", "lost"), [(10, 1.0, 0.7), (2, 0.5, 0.3)])
def test_quality_like_a_plain_version(docs, rows, min_docs, share, lost):
    got = quality(docs, min_docs=min_docs, root_factor=share, max_lost_share=lost)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_lines", "lost_words", "kept"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == plain_quality(rows, min_docs, share, lost)


def test_frequent_lines_that_are_not_broadcast(docs, rows):
    got = quality(docs, min_docs=2, root_factor=0.5, broadcast_lines=0).select("doc_id", "n_words", "lost_words", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], r[1], r[8], r[9]) for r in plain_quality(rows, 2, 0.5, 0.7)), key=str)


def test_passages_of_over_50_words_go_and_short_lines_stay(spark):
    """A passage goes whole wherever it stands, in one line or in eight; single lines that repeat stay."""
    rnd = random.Random(3)
    line = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    passages = [[line(n) for n in sizes] for sizes in ([51], [26, 25], [18, 17, 17], [41, 12], [13] * 4, [10] * 6, [30, 20, 10, 15, 11, 12, 10, 10])]
    stays = [line(39), line(12), "short line"]
    rows, own = [], {}
    for i in range(len(passages) * 8):
        lines = [stays[i % 3]] + [line(rnd.randint(3, 70)) for _ in range(rnd.randint(1, 5))]
        at = rnd.randint(2, len(lines))
        own[i] = lines
        rows.append((i, "\n".join(lines[:at] + passages[i % len(passages)] + lines[at:])))
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[i] == rows[i][1] for i in range(len(passages)))
    assert all(got[i] == "\n".join(own[i]) for i in range(len(passages), len(rows)))


def test_columns_with_clashing_names(spark):
    names = ["_host", "_lines", "_t", "_id", "_gone", "_ends", "_words", "own0", "own1", "line", "host", "a.b"]
    rows = [(i, f"some words here {i}\nand\nmore", "s", *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for got in (quality(docs), line_dedup(docs)):
        assert {(r["doc_id"], *[r[n] for n in names]) for r in got.collect()} == {(r[0], *r[3:]) for r in rows}


def test_no_python_in_the_plans(docs):
    for df in (quality(docs), line_dedup(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality(none).count() == 0 and line_dedup(none).count() == 0


def test_many_frequent_lines_take_linear_time(spark):
    took = []
    for size in (4_000, 40_000):
        text = "\n".join(f"line number {k} of many" for k in range(size))
        docs = spark.createDataFrame([(i, f"{text}\nown words {i} " * (i < 9), "h") for i in range(8)], "doc_id long, text string, source string")
        began = time.perf_counter()
        got = quality(docs, min_docs=5, root_factor=0.5).collect()
        took.append(time.perf_counter() - began)
        assert {(r.n_frequent_lines, r.lost_words) for r in got} == {(size, 5 * size)} and {r.left_text for r in got} == {f"own words {i} " for i in range(8)}
    assert took[1] < 20 * max(took[0], 1), took
