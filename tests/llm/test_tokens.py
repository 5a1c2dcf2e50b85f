"""Operators 1, 3, 7 and 8 against the libraries, on whole small tables with odd texts."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import Row

from loomtext.llm import byte_bpe, packing, shared, token_count, token_files

JSON, RANKS, PIECES = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, length string"  # two columns that the operators' own names clash with


def odd_texts(n=150):
    rnd = random.Random(7)
    letters = " \n\t\r\x0b\x1c\x85\xa0᠎​ 　﻿▁ab'sSé9!.,😀\x00字l"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(n)]
    return ["", " ", "a ", "\n\n a", "aaaa" * 300, "=-" * 200, "don't 's", "the cat " * 3000, "same", "same", *made]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(odd_texts())] + [(None, "no id", None, None), (500, None, None, None), (7, "same", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def library(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    out = shared.scratch(spark, "t")
    token_files.write_token_files(docs, out, JSON, 2, shards=4)
    got = token_files.digest_token_files(spark, out).collect()
    expected, start = [], 0
    tie = {(r.doc_id, r.text): r.tie for r in docs.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) tie").collect()}
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, tie[r.doc_id, r.text or ""]))
    for r in rows:
        ids = [*library(tokenizer, r.text), 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_token_files_of_an_empty_table(spark, docs):
    out = shared.scratch(spark, "t")
    token_files.write_token_files(docs.limit(0), out, JSON, 2, shards=2)
    assert token_files.digest_token_files(spark, out).count() == 0


def test_byte_bpe_like_tiktoken(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode_ids(docs, RANKS, P.PATTERN)
    expected = sorted((r.doc_id or -1, tuple(encoding.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in encoded.collect()) == expected
    decoded = byte_bpe.decode_ids(encoded, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in decoded) == sorted((r.text or "").encode() for r in docs.collect())
    assert byte_bpe.round_trip(docs, RANKS, P.PATTERN).where("decoded_sha256 is null").count() == 0


def test_round_trip_by_value(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        expected.append((r.doc_id or -1, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = byte_bpe.round_trip(docs, RANKS, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted(expected)


def test_packing_is_best_fit_decreasing(docs):
    rows = packing.pack(docs.coalesce(1), JSON, 1, window=64, block_tokens=1 << 40).collect()
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    plain = []
    for n in sorted((r.length for r in rows), reverse=True):
        fits = [k for k, left in enumerate(plain) if left >= n]
        k = min(fits, key=plain.__getitem__) if fits else len(plain)
        plain[k:] = plain[k:] or [64]
        plain[k] -= n
    assert sorted(filled.values()) == sorted(64 - left for left in plain)
    full = {}
    for r in rows:
        full.setdefault((r.doc_id, r.doc_tokens), set()).add((r.start, r.length))
    for (_, n), pieces in full.items():
        assert pieces == {(s, min(64, n - s)) for s in range(0, n, 64)}


def test_empty_tables(docs):
    none = docs.limit(0)
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).count() == token_count.count_tokens(none, PIECES).count() == packing.pack(none, JSON, 1).count() == 0


def test_piece_counts_like_sentencepiece(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_count.count_tokens(docs, PIECES, limit=3000)
    expected = sorted((r.doc_id or -1, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 3000) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == expected


def test_packing_is_gapless_and_whole(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    rows = packing.pack(docs, JSON, 1, window=64, block_tokens=500, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    texts = docs.collect()
    assert sum(r.length for r in rows) == sum(len(library(tokenizer, r.text)) + 1 for r in texts)
    whole = {(r.doc_id, len(ids := [*library(tokenizer, r.text), 1])): ids for r in texts}
    for key, pieces in by_doc.items():
        assert [i for _, ids in sorted(pieces) for i in ids][: key[1]] == whole[key] or key[0] == 7
    assert sum(r.length for r in rows) / (64 * len(by_sequence)) > 0.9


def test_tightest_window_against_a_plain_search():
    rnd = random.Random(3)
    windows, plain = packing.OpenWindows(50), {}
    for _ in range(2000):
        n = rnd.randint(1, 50)
        fits = [left for left in plain.values() if left >= n]
        sequence, used = windows.place(n)
        if fits:
            assert 50 - used == min(fits) == plain[sequence]
        else:
            assert used == 0
        plain[sequence] = 50 - used - n
        plain = {k: v for k, v in plain.items() if v}


def test_rows_keep_clashing_columns_out(docs):
    assert Row(*token_count.count_tokens(docs, PIECES).columns) == Row("doc_id", "n_bytes", "n_tokens", "over_limit")
