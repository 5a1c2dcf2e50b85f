"""Byte-level BPE by rank files: recursive queries contract pairs, ordered aggregation decodes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WHITE_SPACE, Memory, slices

#: Rows are positions of tokens in words. Each step joins neighbours to the merge table and contracts, in every word, the leftmost
#: pair of least rank; a word without a pair is at its fixpoint and makes no further rows. rank and place are compared as one number.
ENCODE = """
WITH RECURSIVE state AS (
  SELECT word, pos, id, 0 AS step FROM symbols
  UNION ALL
  SELECT word, pos, CASE WHEN pair = low THEN CAST(pair >> 24 AS INT) ELSE id END, step + 1
  FROM (
    SELECT *, min(pair) OVER (PARTITION BY word) AS low
    FROM (
      SELECT s.*, (CAST(m.merged AS BIGINT) << 24) + s.pos AS pair
      FROM (SELECT *, lead(id) OVER near AS next_id, lag(pos) OVER near AS last_pos FROM state WINDOW near AS (PARTITION BY word ORDER BY pos)) s
      LEFT JOIN merges m ON m.left_id = s.id AND m.right_id = s.next_id))
  WHERE low IS NOT NULL AND last_pos IS DISTINCT FROM (low & 16777215)
)
SELECT word, list(id ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
GROUP BY word ORDER BY word
"""

#: The same for long words, whose steps would be many: a step contracts the leftmost pair of least rank and its further occurrences
#: that don't overlap. No pair that a merge makes has a lower rank than it, so these would be the next steps anyway.
ENCODE_LONG = """
WITH RECURSIVE state AS (
  SELECT word, pos, id, 0 AS step FROM symbols
  UNION ALL
  SELECT word, pos, CASE WHEN take THEN merged ELSE id END, step + 1
  FROM (
    SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS eaten
    FROM (
      SELECT *, least_rank AND (row_number() OVER (PARTITION BY word, run ORDER BY pos)) % 2 = 1 AS take
      FROM (
        SELECT *, sum(CASE WHEN least_rank THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) * 2
                  + CASE WHEN least_rank THEN 1 ELSE 0 END AS run
        FROM (
          SELECT *, coalesce(merged = low, false) AS least_rank
          FROM (
            SELECT *, min(merged) OVER (PARTITION BY word) AS low
            FROM (SELECT s.*, m.merged
                  FROM (SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next_id FROM state) s
                  LEFT JOIN merges m ON m.left_id = s.id AND m.right_id = s.next_id))
          WHERE low IS NOT NULL))))
  WHERE NOT eaten
)
SELECT word, list(id ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
GROUP BY word ORDER BY word
"""

DECODE = """
SELECT doc, list(bytes ORDER BY pos) AS parts FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


class RankCoder:
    """Encodes and decodes by one rank file, with DuckDB in this process over bounded slices.

    Texts are cut into chunks first, at places where the usual byte-level pattern begins a match: a space after a non-space, the end
    of a run of letters. Another pattern must begin matches there, too.
    """

    #: Parts of a text at places where matches of the pattern begin: whole runs of Latin letters, else up to white space.
    chunks = re.compile(
        rf" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?![^\W\d_])| ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
    ).findall

    def __init__(self, path: str, pattern: str, limit: int = 600_000, block: int = 50_000, long: int = 64):
        import duckdb
        import numpy as np
        import regex
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_file(at) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype="i4")
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '300MB'")
        for name, columns in (
            ("merges", dict(zip(("left_id", "right_id", "merged"), (pa.array(c, pa.int32()) for c in zip(*merges, strict=True)), strict=True))),
            ("vocabulary", {"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks, pa.binary())}),
        ):
            self.db.register("given", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.block, self.long = block, long
        self.cache = Memory(limit)

    def query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def merge(self, words: list[str], sql: str) -> list[bytes]:
        """Ids of each pre-token as little-endian 32-bit integers."""
        import numpy as np

        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), dtype="u1")
        word = np.repeat(np.arange(len(raw), dtype="i4"), sizes)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype("i4")
        ids = self.query(sql, "symbols", pa.table({"word": word, "pos": pos, "id": self.byte_ids[flat]})).column("ids").combine_chunks()
        ends = ids.offsets.to_numpy()
        values = ids.values.to_numpy().astype("<u4")
        return [values[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def learn(self, chunks: list[str]) -> None:
        """Ids of distinct chunks: each match of the pattern in them goes through the recursive query once."""
        parts = [self.split(c) for c in chunks]
        words = list({w for ws in parts for w in ws if w not in self.cache})
        known: dict[str, bytes] = {}
        for sql, some in ((ENCODE, [w for w in words if len(w) <= self.long]), (ENCODE_LONG, [w for w in words if len(w) > self.long])):
            start = held = 0
            for i, w in enumerate([*some, ""]):
                if i > start and (i == len(some) or i - start >= self.block or held + len(w) > 16 * self.block):
                    known.update(zip(some[start:i], self.merge(some[start:i], sql), strict=True))
                    start, held = i, 0
                held += len(w)
        for c, ws in zip(chunks, parts, strict=True):
            self.cache[c] = b"".join([known[w] if w in known else self.cache[w] for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        self.learn(self.cache.lacking(set().union(*cut)))
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence: one ordered aggregation over token rows for a slice of sequences."""
        import numpy as np

        out: list[bytes] = [b""] * len(ids)
        start = held = 0
        for i in range(len(ids) + 1):
            if i > start and (i == len(ids) or held + len(ids[i]) > 2_000_000):
                sizes = [len(x) // 4 for x in ids[start:i]]
                table = pa.table(
                    {
                        "doc": np.repeat(np.arange(start, i, dtype="i4"), sizes),
                        "pos": np.arange(sum(sizes), dtype="i4"),
                        "id": np.frombuffer(b"".join(ids[start:i]), "<u4").astype("i4"),
                    }
                )
                found = self.query(DECODE, "tokens", table)
                parts = found.column(1).combine_chunks()
                flat = parts.values  # the parts of all sequences lie behind each other, in order
                flat = pa.concat_arrays([flat.cast(pa.large_binary())])
                raw = memoryview(flat.buffers()[2] or b"")
                edges = np.frombuffer(flat.buffers()[1], "i8", len(flat) + 1, 8 * flat.offset)[parts.offsets.to_numpy()].tolist()
                for doc, a, b in zip(found.column(0).to_pylist(), edges[:-1], edges[1:], strict=True):
                    out[doc] = bytes(raw[a:b])
                start, held = i, 0
            held += len(ids[i]) if i < len(ids) else 0
        return out


@lru_cache(maxsize=2)
def rank_coder(path: str, pattern: str) -> RankCoder:
    """One coder for each Python worker: its tables and its cache of chunks serve later tasks."""
    return RankCoder(path, pattern)


def encode_ids(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text by a rank file, without special tokens.

    Inside a task the distinct pre-tokens go through DuckDB's recursive query, each once while its chunk stays cached. A null
    or empty text has no ids. Repeated rows and null ids stay rows of their own; other columns are ignored. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = rank_coder(ranks, pattern)
        for part in slices(batches, "text"):
            ids = coder.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes (binary) of every id sequence. A null or empty sequence has no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = rank_coder(ranks, pattern)
        for batch in batches:
            raw = [np.array(x or [], dtype="<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode(raw), pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 of encode_ids and decode_ids in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = rank_coder(ranks, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in slices(batches, "text", 8 << 20):
            ids = coder.encode(part.column(1).to_pylist())
            decimal = [" ".join(map(str, np.frombuffer(x, "<u4").tolist())).encode() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(map(sha, decimal), pa.string()),
                    pa.array(map(sha, coder.decode(ids)), pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
