"""What the operators share: folders that all executors see, slices of Arrow batches, and a cached chunk encoder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# The code points of Unicode White_Space, as a character class without brackets.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a fresh local one only where it is unset and the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: the lineage is cut, and a lost executor costs nothing.

    The shuffle files behind it go when it is written. batch_bytes: about the most that an Arrow batch has meanwhile.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    put = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_bytes:
        put["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch_bytes)
    before = {key: spark.conf.get(key, None) for key in put}
    try:
        for key, value in put.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of text: a long text comes alone, and nothing is dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


class Memory(dict):
    """A dict of at most about twice `limit` entries: at the limit the entries become the old ones, and those still in use come back."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def lacking(self, keys: set) -> list:
        """The keys to work out; all others are entries afterwards, until the next call."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        out = []
        for key in keys.difference(self):
            if key in self.old:
                self[key] = self.old[key]
            else:
                out.append(key)
        return out


@lru_cache(maxsize=1)
def byte_kinds():
    """By byte: is it ASCII white space; can it begin, and can it end, another white-space character in UTF-8."""
    import numpy as np

    space, begin, end = np.zeros((3, 256), bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    others = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    begin[[c.encode()[0] for c in others]] = True
    end[[c.encode()[-1] for c in others]] = True
    return space, begin, end


def bytes_of(texts: pa.Array):
    """(bytes of all texts, places where each begins and the last ends)."""
    import numpy as np

    edges = np.frombuffer(texts.buffers()[1], "i4", len(texts) + 1, 4 * texts.offset).astype("i8")
    return np.frombuffer(texts.buffers()[2] or b"", "u1")[edges[0] : edges[-1]], edges - edges[0]


def chunk_starts(raw, edges):
    """Places where chunks of the texts begin: a white-space character behind another, the last one before another, and what
    follows one that is no space. At white space that isn't ASCII nothing begins."""
    import numpy as np

    space, begin, end = byte_kinds()
    blank = space[raw]
    out = np.zeros(len(raw), bool)
    if len(raw) > 1:
        maybe_end = end[raw]
        lead = begin[raw]
        maybe_end[:1] = False
        behind = np.zeros(len(raw), bool)
        behind[1:] |= lead[:-1]
        behind[2:] |= lead[:-2]
        ended = blank | (maybe_end & behind)
        other = ~blank & ~lead
        out[1:] = (blank[1:] & ~ended[:-1]) | (other[1:] & blank[:-1] & (raw[:-1] != 0x20))
        out[:-1] |= blank[:-1] & other[1:]
    last = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(raw))]
    at_end = last - 1  # the last byte of a text has nothing behind it
    out[at_end] &= blank[at_end] & (at_end > 0) & ~ended_before(raw, at_end, space, begin, end)
    out[edges[:-1][edges[:-1] < len(raw)]] = True
    return out


def ended_before(raw, at, space, begin, end):
    """May the byte before each place end a white-space character?"""
    import numpy as np

    one, two, three = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return space[one] | (end[one] & (begin[two] | begin[three]))


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, with each distinct chunk of text encoded once.

    The byte-level pre-tokenizer never joins text across a space that follows a non-space, so a text is the sequence of its
    chunks (at most one leading space, then non-spaces; or white space) and its ids are those of its chunks in order. A text in
    which a special token's string occurs is one chunk. The number of chunks kept is bounded.
    """

    #: At most a space, then short and without white space: bytes that can begin any outside ASCII are left out.
    plain = re.compile(rb" ?[!-~\x80-\xc1\xc3-\xe0\xe4-\xff]{1,200}").fullmatch

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.library("\n")
        if any(len(s) < 2 or s.isspace() for s in self.special):
            raise ValueError("a special token may not be a single character or white space")
        self.cache = Memory(limit)

    def library(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def learn(self, missing: list[bytes]) -> None:
        """Encodes distinct chunks, many in one call: joined by newlines, whose id parts them again."""
        import numpy as np

        cut = int(np.frombuffer(self.newline, self.kind)[0])
        many = [c for c in missing if self.plain(c)]
        for at in range(0, len(many), 20_000):
            some = many[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(some).decode()], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.append(np.flatnonzero(ids == cut), len(ids))
            if len(ends) != len(some):
                raise ValueError("the tokenizer joins text across newlines: it is not byte-level as expected")
            raw, ends = ids.tobytes(), ends * ids.itemsize
            begins = np.concatenate([[0], ends[:-1] + ids.itemsize])
            self.cache.update(zip(some, [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], strict=True))
        for c in missing:
            if not self.plain(c):
                self.cache[c] = self.library(c.decode())

    def encode(self, texts: pa.Array):
        """(ids of all texts in self.kind, places where each text's ids begin and the last ends)."""
        import numpy as np

        raw, edges = bytes_of(texts)
        first = chunk_starts(raw, edges)
        whole: set[bytes] = set()
        for s in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist():
                first[edges[k] + 1 : edges[k + 1]] = False
                whole.add(raw[edges[k] : edges[k + 1]].tobytes())
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(raw)).astype("i4")
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        for text in whole:  # also those without white space
            self.cache[text] = self.library(text.decode())
        self.learn(self.cache.lacking(set(distinct)))
        parts = [self.cache[c] for c in distinct]
        pool, width = np.frombuffer(b"".join(parts), self.kind), np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, parts), "i4", len(parts)) // width
        begins = np.cumsum(sizes, dtype="i4") - sizes
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype="i8")])
        ids = pool[np.repeat(begins[codes] - ends[:-1].astype("i4"), lengths) + np.arange(ends[-1], dtype="i4")]
        return ids, ends[np.searchsorted(starts, edges)]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker: later tasks find its cache warm."""
    return ChunkEncoder(path)
