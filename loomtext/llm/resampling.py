"""Importance resampling towards a target: hashed n-gram weights scored in arrays, and ranks by a distributed radix sort."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bytes_of, discard, slices, stored

#: Words of more bytes than this are hashed one by one, all others together, byte place by byte place.
LONG = 96


@lru_cache(maxsize=1)
def tables():
    """(the 256 steps of CRC-32 by its polynomial, bytes with A-Z as a-z, which bytes words have)."""
    import numpy as np

    steps = np.arange(256, dtype="u4")
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    lower = np.arange(256, dtype="u1")
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return steps, lower, inside


def words_of(raw):
    """(starts, ends) of the words of lower-case bytes: runs of digits, a-z and all that isn't ASCII."""
    import numpy as np

    edge = np.diff(np.concatenate(([False], tables()[2][raw], [False])).astype("i1"))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def advanced(register, raw, starts, sizes):
    """CRC-32 registers after the bytes of a word each: words in order of length, so that those still going on are a slice."""
    import numpy as np

    steps = tables()[0]
    order = np.argsort(-sizes, kind="stable")
    at, left, value = starts[order], sizes[order], register[order]
    for k in range(int(np.searchsorted(-left, -LONG, "left"))):
        word = raw[at[k] : at[k] + left[k]].tobytes()
        value[k] = zlib.crc32(word, int(value[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        left[k] = 0
    first = int(np.count_nonzero(sizes > LONG))
    most = np.searchsorted(-left[first:], -np.arange(LONG + 1), "left")  # words of more than k bytes, for each k
    for k in range(LONG):
        n = first + int(most[k])
        if n == first:
            break
        some = value[first:n]
        value[first:n] = steps[(some ^ raw[at[first:n] + k]) & 255] ^ (some >> 8)
    out = np.empty_like(value)
    out[order] = value
    return out


def features(texts: pa.Array, width: int, buckets: int) -> Iterator[tuple]:
    """For k = 1 .. width: (buckets of all runs of k words that one text has, the text of each). Texts are binary, without nulls."""
    import numpy as np

    raw, edges = bytes_of(texts)
    gaps = np.arange(len(texts)).repeat(np.diff(edges))  # a byte between texts, so that words end there
    moved = np.full(len(raw) + len(texts), 10, "u1")
    moved[np.arange(len(raw)) + gaps] = raw
    moved = tables()[1][moved]
    starts, ends = words_of(moved)
    if not len(starts):
        return
    sizes = ends - starts
    doc = np.searchsorted(edges[1:] + np.arange(1, len(edges)), starts, "right")
    last = np.arange(len(starts))  # the word that a run ends with
    register = advanced(np.full(len(starts), 0xFFFFFFFF, "u4"), moved, starts, sizes)
    for k in range(width):
        if k:
            on = np.flatnonzero(doc[np.minimum(last + 1, len(doc) - 1)] == doc[last])
            on = on[last[on] + 1 < len(doc)]
            register, last = register[on], last[on] + 1
            register = tables()[0][(register ^ np.uint32(32)) & 255] ^ (register >> 8)
            register = advanced(register, moved, starts[last], sizes[last])
        yield ((register ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype("i8"), doc[last]


def bucket_counts(docs: DataFrame, *, width: int = 2, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """bucket, n: features of all texts by bucket. A task gives at most `buckets` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(buckets, "i8")
        for part in slices(batches, "text"):
            for found, _ in features(part.column(0), width, buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, width: int = 2, buckets: int = 10_000, text_col: str = "text") -> list[int]:
    """By bucket floor(1000 * ln) of its smoothed share of the target's features over its share of those of docs."""
    counts = []
    for table in (docs, target):
        n = [0] * buckets
        for row in bucket_counts(table, width=width, buckets=buckets, text_col=text_col).collect():  # at most `buckets` rows
            n[row["bucket"]] = row["n"]
        counts.append(n)
    all_docs, all_target = (sum(n) + buckets for n in counts)
    return [math.floor(1000 * math.log((t + 1) * all_docs / ((s + 1) * all_target))) for s, t in zip(*counts, strict=True)]


def scores(docs: DataFrame, gain: Sequence[int], *, width: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features, 0 without), score: weight plus Gumbel noise by the id."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        by_bucket = np.array(gain, "i8")
        for part in slices(batches, "text"):
            words, n, total = np.zeros((3, part.num_rows), "i8")
            for k, (found, doc) in enumerate(features(part.column(2), width, buckets)):
                here = np.bincount(doc, minlength=len(n))
                words = here if k == 0 else words
                n += here
                some, first = np.unique(doc, return_index=True)  # features of a text are neighbours
                if len(some):
                    total[some] += np.add.reduceat(by_bucket[found], first)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, n, weight, weight + np.array(noise, "i8")))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), h.alias("h"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def key_parts(rows: DataFrame, columns: Sequence[tuple[str, bool]]) -> tuple[int, list[tuple[Column, int]]]:
    """(rows, for each column, most significant first: its number from 0 up in the wanted order, the bits that it takes).

    columns: names of long columns and whether they ascend. Nulls come last. A number is read as 64 bits without sign.
    """
    found = rows.agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{k}{i}") for i, (c, _) in enumerate(columns) for k, f in (("a", F.min), ("z", F.max))]).first()
    parts = []
    for i, (c, ascends) in enumerate(columns):
        a, z = found[f"a{i}"] or 0, found[f"z{i}"] or 0
        if z - a < 1 << 62:
            value, bits = (F.col(c) - a if ascends else F.lit(z) - F.col(c)), (z - a + 1).bit_length()
            parts.append((F.coalesce(value, F.lit(z - a + 1)), bits))
        else:  # all 64 bits, the sign turned; and one more for nulls
            flip = F.lit(-(1 << 63)) if ascends else F.lit((1 << 63) - 1)
            parts += [(F.col(c).isNull().cast("long"), 1), (F.coalesce(F.col(c).bitwiseXOR(flip), F.lit(0)), 64)]
    return found["rows"], parts


def radix_ranks(rows: DataFrame, columns: Sequence[tuple[str, bool]], *, digit_bits: int = 11, block_rows: int | None = None) -> tuple[DataFrame, int]:
    """(rows with rank from 0 in the order of `columns` (see key_parts), their number), by a least-significant-digit radix sort.

    A pass counts the rows of each (block of positions, digit), turns the counts into offsets by prefix sums, and moves each row to
    its offset plus its place among the block's rows of the digit. Such places keep the order of the pass before: passes are
    stable. Each is stored. No task has more than a block of one digit, however often a digit or a key occurs, and the totals that
    meet in one task are one a digit. Rows that are equal in all columns share their ranks out in any order.
    """
    spark = rows.sparkSession
    kept = stored(rows, "radix")
    n, parts = key_parts(kept, columns)
    block_rows = block_rows or min(1 << 16, max(1 << 10, n // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    digits = []
    for value, bits in reversed(parts):  # as few digits as the parts' bits allow, of about equal width
        steps = math.ceil(bits / digit_bits)
        width = math.ceil(bits / steps) if steps else 1
        digits += [F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for k in range(steps)]
    blocks = max(1, math.ceil(n / block_rows))
    everything = [F.col(f"`{c}`") for c in rows.columns]
    block, order = F.pmod(F.xxhash64(*everything), F.lit(blocks)), everything  # any order to begin with
    for digit in digits:
        placed = kept.withColumns({"_block": block, "_digit": digit})
        counts = placed.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("m"))
        before = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = counts.withColumn("_inside", before(Window.partitionBy("_digit").orderBy("_block"))).drop("m")
        starts = counts.groupBy("_digit").agg(F.sum("m").alias("m")).select("_digit", before(Window.orderBy("_digit")).alias("_start"))
        offsets = inside.join(F.broadcast(starts), "_digit").select("_block", "_digit", (F.col("_start") + F.col("_inside")).alias("_offset"))  # one row a digit
        place = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy(*order)) - 1
        moved = placed.withColumn("_place", place).join(offsets, ["_block", "_digit"])
        following = stored(moved.select(*everything, (F.col("_offset") + F.col("_place")).alias("_at")), "radix")
        discard(kept)
        kept, block, order = following, F.floor(F.col("_at") / block_rows).cast("long"), [F.col("_at")]
    return kept.withColumnRenamed("_at", "rank"), n


def importance(
    docs: DataFrame, target: DataFrame, *, width: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank, from 1, is null for rows that aren't drawn.

    Features are runs of 1 to `width` words (digits, letters and all that isn't ASCII; A-Z in lower case), hashed into buckets. A
    document's weight is the floored mean of its features' gains: thousandths of the log ratio of a bucket's share in the target
    and in docs. score adds Gumbel noise that the id alone decides, so the highest scores are a draw without replacement. Of the
    documents with min_words words, percent / 100 are drawn, ties to the smaller id.

    Null and empty texts have no features and weight 0. Null ids come last among ties and count as empty for the noise. Repeated
    rows are documents of their own, with ranks of their own. An empty target makes all gains alike small; empty docs give no rows.
    Other columns are ignored. Counts by bucket are all that meets on the driver.
    """
    scored = stored(scores(docs, gains(docs, target, width=width, buckets=buckets, text_col=text_col), width=width, seed=seed, id_col=id_col, text_col=text_col), "scores")
    sure = scored.where(F.col("n_words") >= min_words).drop("n_words")
    ranked, n = radix_ranks(sure, [("score", False), ("doc_id", True)])
    drawn = F.when(F.col("rank") < n * percent // 100, F.col("rank") + 1)
    short = scored.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", drawn.alias("rank")).union(short)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **rules) -> DataFrame:
    """The rows of docs that importance() draws, as they are. Rows of docs must have ids of their own."""
    drawn = importance(docs, target, id_col=id_col, **rules).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(drawn, docs[id_col].cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
