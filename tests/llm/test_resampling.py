"""Operator 12 against a plain version, and its parts alone."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import resampling as rs


def plain_features(text, width=2):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, buckets=10_000, percent=25, width=2):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, text in rows for f in plain_features(text, width)[1])
    t = Counter(of(f) for text in target for f in plain_features(text, width)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out, able = [], []
    for doc, text in rows:
        words, found = plain_features(text, width)
        weight = sum(gain[of(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        row = [doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if words >= 20:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return sorted(map(tuple, out), key=str)


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "ÉTÉ", "日本", "x" * 500, "0", "İi"]
    prose = lambda n: rnd.choice(" \n\t-").join(rnd.choice(vocabulary) for _ in range(n))
    texts = [None, "", " .,\n", "one", "É", "\x00a\x7fb\x85c", "ten " * 40_000] + [prose(rnd.randint(1, 120)) for _ in range(150)]
    rows = [*enumerate(texts), (None, texts[-1]), (None, prose(50)), (9, texts[9]), (9, texts[9]), (-4, prose(40))]
    return rows, [prose(30) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_like_a_plain_version(spark, width):
    rows, target = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rank int, score int").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = rs.importance(docs, wanted, width=width).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, target, width=width)


def test_runs_of_words_have_their_crc():
    rows, _ = corpus(2)
    texts = [t or "" for _, t in rows]
    got = [Counter() for _ in texts]
    for found, doc in rs.features(pa.array([t.encode() for t in texts], pa.binary()), 3, 1 << 30):
        for b, d in zip(found.tolist(), doc.tolist(), strict=True):
            got[d][b] += 1
    assert got == [Counter(zlib.crc32(f.encode()) % (1 << 30) for f in plain_features(t, 3)[1]) for t in texts]


def test_radix_ranks_are_those_of_a_sort(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 5, 5, -3, None, rnd.randrange(-(1 << 62), 1 << 62)]), rnd.randrange(-50, 50), k) for k in range(3000)]
    rows += [(7, 7, 5000 + k) for k in range(1500)] + [(-(1 << 63), 1, 9001), ((1 << 63) - 1, 1, 9002)]
    df = spark.createDataFrame(rows, "a long, b long, k long").repartition(5)
    for columns in ([("b", False), ("a", True), ("k", True)], [("a", False), ("k", False)], [("k", True)]):
        ranked, n = rs.radix_ranks(df, columns, digit_bits=7, block_rows=100)
        key = lambda r, columns=columns: [(r[c] is None, 0 if r[c] is None else r[c] if up else -r[c]) for c, up in columns]
        got = sorted(ranked.collect(), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(n)) and n == len(rows)
        assert [key(r) for r in got] == sorted(key(r) for r in got)


def test_equal_rows_share_their_ranks(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("a"))
    ranked, n = rs.radix_ranks(df, [("a", True)], block_rows=64)
    assert sorted((r["rank"], r.a) for r in ranked.collect()) == [(k, int(k >= 2500)) for k in range(5000)]


def test_weights_lean_to_the_target(spark):
    near, far = ["red green blue " * 10] * 30, ["one two three " * 10] * 90
    docs = spark.createDataFrame(list(enumerate(near + far)), "doc_id long, text string")
    drawn = rs.resample(docs, spark.createDataFrame([("blue red green",)] * 20, "text string"), percent=20)
    assert drawn.columns == ["doc_id", "text"] and drawn.count() == 24
    assert np.mean([r.doc_id < 30 for r in drawn.collect()]) > 0.9


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")
    assert rs.importance(none, some).count() == 0
    assert rs.importance(some, none, percent=100).first()["rank"] == 1
