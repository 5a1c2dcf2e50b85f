"""Operator 10 against a plain version, over increments, with ties and nulls."""

import hashlib
import re
import uuid

import pytest

from loomtext.llm.exact_dedup import DigestIndex, digests, exact_dedup

ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "c"), (5, None), (6, ""), (7, " \t\n"), (8, "c"), (9, "é x"), (10, "éx"), (None, "c"), (None, "only"), (12, "x" * 200_000)]


@pytest.fixture
def table(spark):
    name = "digests_" + uuid.uuid4().hex
    yield name
    for each in (name, f"{name}_again"):
        spark.sql(f"DROP TABLE IF EXISTS {each}")


def plain(rows):
    key = lambda t: hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i))
    return sorted(((i, min(groups[key(t)])[2], len(groups[key(t)]), key(t)) for i, t in rows), key=str)


def test_against_a_plain_version(spark, table):
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in ROWS], "doc_id long, text string, digest binary, keep_id int")
    got = exact_dedup(docs, table, buckets=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_increments_give_what_one_gives(spark, table):
    index = DigestIndex(spark, table, 3)
    parts = [ROWS[:4], [*ROWS[4:9], (1, "a b"), (20, "a   b"), (0, "c")], [*ROWS[9:], (30, " a  b  "), (30, " a  b  ")], []]
    for part in parts:
        index.append(spark.createDataFrame(part, "doc_id long, text string"))
    every = [r for part in parts for r in part]
    got = index.match(spark.createDataFrame(every, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(every)
    assert index.rows().count() == index.read(table).count() == len({r.text_sha256 for r in got})


def test_the_anti_join_reads_the_index_by_bucket(spark, table):
    index = DigestIndex(spark, table, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index.append(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    new = spark.createDataFrame([(3, "c")], "doc_id long, text string")
    joined = digests(new).join(index.read(table).select("digest").hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_empty_table(spark, table):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string"), table, buckets=2).count() == 0
