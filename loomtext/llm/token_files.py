"""Token-id files: flat unsigned ids and 64-bit document offsets, one pair of files for each range of documents."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import encoder, slices


def write_token_files(
    docs: DataFrame, out: str, tokenizer: str, end_id: int, *, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes every text's ids, each followed by end_id, in ascending id order; returns the manifest.

    Files in `out`, for each shard: ids (flat little-endian, 16 bits where the vocabulary allows, else 32), offsets (n + 1
    64-bit local document starts) and documents (Arrow file of ids). manifest/ has a row for each shard: shard, width, n_docs,
    n_tokens, base (ids in earlier shards: the prefix sum). A global start is base + local offset. Each file gets its name by a
    rename after it is whole, so a task that runs twice leaves one good file.

    A null text is empty: its only id is end_id. Null ids sort first. Rows that share an id are ordered by a hash of their
    text; equal rows follow each other. Other columns are ignored. An empty table gives empty shards.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow import fs

        enc = encoder(tokenizer)
        width = np.dtype(enc.kind).itemsize
        store, top = fs.FileSystem.from_uri(out)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store.create_dir(top, recursive=True)
        name = lambda kind: f"{top}/shard-{shard:06d}.{kind}"
        n_docs = total = 0
        kinds = ("ids", "offsets", "documents")
        with (
            store.open_output_stream(name("ids") + attempt) as ids_file,
            store.open_output_stream(name("offsets") + attempt) as offsets_file,
            store.open_output_stream(name("documents") + attempt) as documents_file,
            pa.ipc.new_file(documents_file, pa.schema([("doc_id", pa.int64())])) as documents,
        ):
            offsets_file.write(np.zeros(1, "<u8").tobytes())
            for part in slices(batches, "text"):
                ids, places = enc.encode(part.column(1))
                ids_file.write(np.insert(ids, places[1:], end_id).tobytes())
                ends = total + places[1:] + np.arange(1, len(places))
                offsets_file.write(ends.astype("<u8").tobytes())
                documents.write(pa.record_batch([part.column(0)], names=["doc_id"]))
                n_docs, total = n_docs + part.num_rows, int(ends[-1])
        for kind in kinds:
            store.move(name(kind) + attempt, name(kind))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "width": [width], "n_docs": [n_docs], "n_tokens": [total]})

    rows.mapInArrow(write, "shard long, width long, n_docs long, n_tokens long").write.parquet(f"{out}/sizes")
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """A row for each shard, with base: the prefix sum over shards. There are as many rows as files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{out}/sizes").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def ids_of(out: str, shard: int, width: int):
    """A shard's ids (memory-mapped where the store is a file system of this machine), offsets and document ids."""
    import numpy as np
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(out)
    path = f"{top}/shard-{shard:06d}"
    if isinstance(store, fs.LocalFileSystem):
        raw = pa.memory_map(f"{path}.ids").read_buffer()
        documents = pa.ipc.open_file(pa.memory_map(f"{path}.documents"))
    else:
        raw = store.open_input_file(f"{path}.ids").read_buffer()
        documents = pa.ipc.open_file(store.open_input_file(f"{path}.documents"))
    ids = np.frombuffer(raw, dtype=f"<u{width}") if raw.size else np.zeros(0, dtype=f"<u{width}")
    with store.open_input_file(f"{path}.offsets") as f:
        offsets = np.frombuffer(f.read(), dtype="<u8").astype("int64")
    return ids, offsets, documents.read_all().column("doc_id")


def digest_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files, in file order: doc_id, start, n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    shards = manifest(spark, out)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, documents = ids_of(out, row["shard"], row["width"])
                for at in range(0, len(documents), 2_000):
                    cut = offsets[at : at + 2_001]
                    wide, low = memoryview(ids[cut[0] : cut[-1]].astype("<u4").tobytes()), int(cut[0])
                    sums = [zlib.crc32(wide[4 * (a - low) : 4 * (b - low)]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            documents.slice(at, 2_000).combine_chunks(),
                            pa.array(cut[:-1] + row["base"]),
                            pa.array(cut[1:] - cut[:-1]),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
