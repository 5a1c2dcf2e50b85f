"""Near duplicates by HyperMinHash sketches, banding, and a check on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, stored
from .shingles import shingle_sets

#: Registers of a sketch, registers of a band, mantissa bits of a register, and the standard deviations that an estimate may lie
#: below the threshold before a pair is left out. A pair at a similarity of 0.85 shares no band of 4 in 32 bands with a
#: probability of 6e-11 (0.8: 5e-8), and lies 5.5 deviations low with one of 2e-8.
REGISTERS, BAND, MANTISSA, DEVIATIONS = 128, 4, 10, 5.5

#: Members of a bucket, and of a cluster, that one task compares at a time. Larger ones are dealt into pairs of blocks.
SKETCH_BLOCK, SET_BLOCK = 2048, 512


def sketch(values) -> bytes:
    """Registers of a sorted set of hashes: the top bits choose one; it holds the leading zeros of the least of the other bits
    (6 bits) and the MANTISSA bits after the first one; 0 if it has no value."""
    import numpy as np

    bits = REGISTERS.bit_length() - 1
    at = np.searchsorted(values >> np.uint64(64 - bits), np.arange(REGISTERS, dtype="u8"))
    out = np.zeros(REGISTERS, "<u2")
    if len(values):
        found = np.minimum(at, len(values) - 1)
        has = (values[found] >> np.uint64(64 - bits)).astype("i8") == np.arange(REGISTERS)
        rest = values[found] << np.uint64(bits) | np.uint64(1)
        zeros = 64 - np.frexp(rest.astype("f8"))[1]
        after = (rest << np.minimum(zeros + 1, 63).astype("u8")) >> np.uint64(64 - MANTISSA)
        zeros = np.minimum(np.maximum(zeros, 0), 62)
        out[has] = (((zeros + 1) << MANTISSA) | after.astype("i8"))[has]
    return out.tobytes()


def estimates(one, others, n_one, n_others):
    """(similarity, registers in use) of a sketch with others: equal registers, less those expected to be equal by chance."""
    import numpy as np

    used = ((others > 0) | (one > 0)).sum(axis=1)
    equal = ((others == one) & (one > 0)).sum(axis=1)
    ratio = np.maximum(n_one, n_others) / np.maximum(1, np.minimum(n_one, n_others))
    chance = 0.169919487159739 * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    chance = np.minimum(chance, used - equal)
    return (equal - chance) / np.maximum(1, used - chance), used


def plausible(one, others, n_one, n_others, percent: int):
    """Mask of others whose size allows, and whose estimate doesn't rule out, a similarity of percent / 100."""
    import numpy as np

    least, most = np.minimum(n_one, n_others), np.maximum(n_one, n_others)
    near, used = estimates(one, others, n_one, n_others)
    j = percent / 100
    return (100 * least >= percent * most) & (near >= j - DEVIATIONS * np.sqrt(j * (1 - j) / np.maximum(1, used)))


def forest(n: int, linked: Callable) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n items: each item, breadth first, meets only those not reached yet. linked(i, rest): mask of rest."""
    import numpy as np

    rest, edges = np.arange(n), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            found = rest[hit].tolist()
            edges += [(i, k) for k in found]
            queue += found
            rest = rest[~hit]
    return edges


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key from batches sorted by it. A key's rows are held together: keys are dealt so that they are few."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or (i > start and keys[i] != keys[start]):
                if i == start:
                    continue
                if held and keys[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, i - start))
                last, start = keys[start], i
    if held:
        yield pa.Table.from_batches(held)


def dealt(rows: DataFrame, group: str, size: str, node: str, block: int) -> DataFrame:
    """rows with `part`: the group, or, for a group of more than `block` rows, each pair of its blocks that a row is needed in.

    A group of m rows then makes m * ceil(m / block) rows, and no task holds more than about two blocks of it.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node), blocks.cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("a"), F.greatest(k, own).alias("b")))
    return rows.withColumn("_pair", F.explode(F.when(blocks > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))))).withColumn(
        "part", F.xxhash64(F.col(group), "_pair.a", "_pair.b")
    ).drop("_pair")


def sketched(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, node (of the shingle set; null if empty), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        np.seterr(over="ignore")
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column(2).to_pylist(), width)
            nodes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(map(sketch, sets), pa.binary())],
                names=["doc_id", "t", "n_shingles", "node", "sketch"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, n_shingles long, node long, sketch binary")


def sketch_links(nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: links between sketches that share a band and may reach the similarity; a spanning forest of each bucket's."""
    step = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda k: F.struct(k.alias("k"), F.substring("sketch", k * step + 1, F.lit(step)).alias("v")))
    used = F.filter(bands, lambda b: b["v"] != F.lit(bytes(step)))
    keys = nodes.select("node", F.explode(F.transform(used, lambda b: F.xxhash64(b["k"], b["v"]))).alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = keys.join(shared, "bucket").join(nodes.select("node", "n_shingles", "sketch"), "node")
    parts = dealt(members, "bucket", "m", "node", SKETCH_BLOCK).select("part", "node", "n_shingles", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for group in grouped(batches, "part"):
            if group.num_rows < 2:
                continue
            ids = group.column("node").to_numpy()
            n = group.column("n_shingles").to_numpy()
            registers = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(len(ids), REGISTERS)
            edges = forest(len(ids), lambda i, rest: plausible(registers[i], registers[rest], n[i], n[rest], percent))  # noqa: B023
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """node, root (its component's least node) for all nodes of links; alternating large and small stars, each round stored.

    A round replaces links by links to least neighbours, so there are never more than before. It takes about the logarithm of a
    component's diameter in rounds.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stored(small.where("a <> b").distinct(), name)
        if edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def set_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """a, b: links confirmed on the full shingle sets of each cluster's texts; a spanning forest of each cluster's."""
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    members = clusters.join(sizes, "root").join(nodes.select("node", "doc_id", "t"), "node")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    members = members.select("root", "m", "node", F.col("t").alias("_t"), F.col("doc_id").alias("_id"))
    found = texts.join(members, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    parts = dealt(found.select("root", "m", "node", "text"), "root", "m", "node", SET_BLOCK).select("part", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        np.seterr(over="ignore")
        for group in grouped(batches, "part"):
            if group.num_rows < 2:
                continue
            ids = group.column("node").to_numpy()
            sets = [s for k in range(0, len(ids), 64) for s in shingle_sets(group.column("text").slice(k, 64).to_pylist(), width)]
            n = np.array([len(s) for s in sets])
            registers = np.frombuffer(b"".join(map(sketch, sets)), "<u2").reshape(len(ids), REGISTERS)

            def linked(i, rest, sets=sets, n=n, registers=registers):
                hit = plausible(registers[i], registers[rest], n[i], n[rest], percent)
                for k in np.flatnonzero(hit).tolist():
                    other = sets[rest[k]]
                    at = np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)
                    both = int((sets[i][at] == other).sum())
                    hit[k] = 100 * both >= percent * (len(sets[i]) + len(other) - both)
                return hit

            edges = forest(len(ids), linked)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long").distinct()


def near_dedup(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    A document's set holds its `width`-word shingles (A-Z in lower case; words are runs without 0x20 and 0x09 to 0x0D), as 64-bit
    hashes; with fewer words its whole sequence. Documents are linked where 100 * intersection >= percent * union. component_id is
    the least doc_id that links reach, and kept marks the row with it.

    Documents of one set are one node. Nodes whose sketches share a band meet in buckets; estimates that may reach the threshold
    make clusters, and only inside them are full sets compared. Buckets and clusters of any size are whole: large ones are dealt
    into pairs of blocks.

    Null and empty texts, and texts without words, have an empty set and link with nothing. Null ids are no component_id unless a
    component has no other, and rows with them are kept only then. Rows that share an id and a set share a result. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = stored(sketched(docs, width, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t"))
    by_node = rows.where("node is not null").groupBy("node").agg(first.alias("f"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = stored(by_node.select("node", "f.doc_id", "f.t", "n_shingles", "sketch"), "nodes")
    clusters = components(sketch_links(nodes, percent), "clusters")
    linked = components(set_links(docs, nodes, clusters, width, percent, id_col, text_col), "components")
    least = linked.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    moved = linked.join(least, "root").select("node", "component_id")
    by_set = nodes.select("node", F.col("doc_id").alias("first_id")).join(moved, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "node", "n_shingles").join(by_set, "node", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )
