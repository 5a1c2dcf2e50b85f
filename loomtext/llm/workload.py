"""The training-data queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, group_join, line_dedup, near_dedup, packing, pii, quality, resampling, shared, spelling, suffix_tree, token_count, token_files

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared.scratch(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), out, BYTE_BPE, 2)
    return token_files.digest_token_files(spark, out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.line_dedup(documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), width=3, percent=85)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(documents(spark, sf_dir).select("doc_id", "text")))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(documents(spark, sf_dir))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_BPE, 1)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "lost_words")
    return quality.quality(documents(spark, sf_dir)).select("doc_id", *columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = shared.scratch(spark, "digests").rpartition("/")[2].replace("-", "_")
    return exact_dedup.exact_dedup(documents(spark, sf_dir), table)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir), drop_one_in=199)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.similar_documents(documents(spark, sf_dir), width=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_pii": op5_pii,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_token_count": op7_token_count,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_resampling": op12_resampling,
    "op13_group_join": op13_group_join,
    "pipeline": corpus_pipeline.run,
}

#: crc_table (256 numbers by the rule of the polynomial), and the CRC-32 of a text's UTF-8 bytes as an expression over it.
CRC_TABLE = "crc_table AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS t FROM range(256) r(i)))"
CRC = "xor(4294967295, list_reduce(list_transform(range(1, strlen({s}) + 1), lambda i: CAST('0x' || substr(hex({s}), 2 * i - 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295))"

ORACLE: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH d AS (
          SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
        ), l AS (
          SELECT doc_id, text, i, lines[i] AS line, len(lines) AS n_lines
          FROM (SELECT *, string_split(text, chr(10)) AS lines FROM d) s, unnest(range(1, len(lines) + 1)) u(i)
        ), h AS (
          SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS number, length(line) >= 19 AND length(line) - length(replace(line, ' ', '')) >= 9 AS long FROM l
        ), b AS (
          SELECT *, (number + 31 * coalesce(lag(number, 1) OVER w, 0) + 961 * coalesce(lag(number, 2) OVER w, 0)) % 4 = 0 OR i = n_lines OR long OR coalesce(lead(long) OVER w, false) AS last
          FROM h WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
        ), k AS (
          SELECT *, coalesce(sum(CAST(last AS INT)) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b
        ), c AS (
          SELECT doc_id, text, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY ALL
        ), a AS (
          SELECT *, length(chunk) - length(translate(chunk, ' ' || chr(10), '')) + 1 AS words,
                 regexp_matches(chunk, '[^\x20\x09-\x0D]') AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS again FROM c
        ), p AS (
          SELECT *, k - row_number() OVER (PARTITION BY doc_id, text, again ORDER BY k) AS run FROM a
        ), r AS (
          SELECT *, again AND (max(n) OVER w > 1 OR sum(words) OVER w >= 40) AS gone FROM p WINDOW w AS (PARTITION BY doc_id, text, again, run)
        )
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS removed_chunks,
               CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS removed_lines,
               CAST(length(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS BIGINT) AS n_chars_left,
               sha256(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS text_sha256
        FROM r GROUP BY doc_id, text
    """,
    "op9_quality": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source,
                 list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
          FROM documents
        ), l AS (
          SELECT r, source, i, line, array_to_string(ws, ' ') AS norm, len(ws) AS n
          FROM (SELECT r, source, i, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
                FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d))
          WHERE len(ws) > 0
        ), t AS (
          SELECT min(r) AS r, source FROM d GROUP BY source, text
        ), hosts AS (
          SELECT source, count(*) AS n_host FROM t GROUP BY source
        ), frequent AS (
          SELECT source, norm FROM (SELECT source, lower(norm) AS norm, count(DISTINCT r) AS n FROM l WHERE r IN (SELECT r FROM t) GROUP BY ALL)
          JOIN hosts USING (source) WHERE n > 10 AND n > sqrt(n_host)
        ), lost AS (
          SELECT r, count(*) AS n_frequent_lines, CAST(sum(n) AS BIGINT) AS lost_words
          FROM l WHERE (source, lower(norm)) IN (SELECT (source, norm) FROM frequent) GROUP BY r
        ), dup AS (
          SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r
        ), w AS (
          SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win FROM d, unnest(range(1, len(words) - 6)) u(i)
        ), rep AS (
          SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS times FROM w) WHERE times > 1
        ), cov AS (
          SELECT r, CAST(sum(least(8, i - coalesce(before, i - 8))) AS BIGINT) AS n_repeat_words
          FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM rep) GROUP BY r
        ), f AS (
          SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 coalesce(n_frequent_lines, 0) AS n_frequent_lines, coalesce(lost_words, 0) AS lost_words
          FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN lost USING (r)
        )
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_words <= 0.7 * n_words AS kept
        FROM f
    """,
    "op10_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_points,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents
        ), g AS (
          SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op11_spelling_variants": rf"""
        WITH RECURSIVE {CRC_TABLE}, runs AS (
          SELECT id, run, count(*) AS n
          FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                       unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
          GROUP BY ALL
        ), hashed AS (
          SELECT run, n, {CRC.format(s="(id || ':' || run)")} AS h FROM runs, crc_table
        ), words AS (
          SELECT word, CAST(sum(n) AS BIGINT) AS n
          FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), cut AS (
          SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)
        ), near AS (
          SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
          UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)
        ), ranked AS (
          SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
          FROM near JOIN words o ON o.word = other
        ), formed AS (
          SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
          FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1
        ), steps AS (
          SELECT word, word AS here FROM formed
          UNION ALL SELECT steps.word, f.form FROM steps JOIN formed f ON f.word = steps.here WHERE f.form IS NOT NULL
        )
        SELECT formed.word, form, here AS root, n, n_near, form_n
        FROM formed JOIN steps USING (word) WHERE here IN (SELECT word FROM formed WHERE form IS NULL)
    """,
    "op12_resampling": rf"""
        WITH {CRC_TABLE}, texts AS (
          SELECT row_number() OVER () AS r, doc_id AS id, text, true AS mine FROM documents UNION ALL SELECT row_number() OVER (), item_id, text, false FROM benchmark
        ), lists AS (
          SELECT r, id, mine, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM texts
        ), runs AS (
          SELECT r, id, mine, run, count(*) AS n
          FROM (SELECT r, id, mine, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS run FROM lists) GROUP BY ALL
        ), hashed AS (
          SELECT run, {CRC.format(s="run")} % 10000 AS bucket FROM (SELECT DISTINCT run FROM runs), crc_table
        ), totals AS (
          SELECT bucket, coalesce(sum(n) FILTER (WHERE mine), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT mine), 0) AS t FROM runs JOIN hashed USING (run) GROUP BY bucket
        ), gains AS (
          SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals
        ), weights AS (
          SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM runs JOIN hashed USING (run) JOIN gains USING (bucket) WHERE mine GROUP BY r
        ), scored AS (
          SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
                 CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
                 CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
          FROM lists LEFT JOIN weights USING (r) WHERE mine
        ), ranked AS (
          SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
    """,
    "op13_group_join": r"""
        WITH RECURSIVE lists AS (
          SELECT row_number() OVER () AS r, doc_id,
                 list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
          FROM documents
        ), shingles AS (
          SELECT DISTINCT r, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s
          FROM lists
        ), sizes AS (
          SELECT r, count(*) AS n FROM shingles GROUP BY r
        ), common AS (
          SELECT a.r AS x, b.r AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY ALL
        ), links AS (
          SELECT x, y FROM common JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)
        ), reach AS (
          SELECT r, r AS z FROM lists UNION SELECT reach.r, y FROM reach JOIN links ON x = z
        )
        SELECT l.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
        FROM lists l JOIN reach ON reach.r = l.r JOIN lists o ON o.r = z LEFT JOIN sizes ON sizes.r = l.r GROUP BY l.r, l.doc_id
    """,
}
