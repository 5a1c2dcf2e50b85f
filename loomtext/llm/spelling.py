"""Spelling variants: words one edit apart, by k-d trees over letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import grouped
from .shared import discard, stored

#: The letters of a word, as the words' pattern has them, by code point. All fit a byte.
LETTERS = (*range(0x61, 0x7B), *range(0xC0, 0x100))
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, *, min_points: int = 6, min_count: int = 5, drop_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters (A-Z in lower case) of at least min_points code points that occur min_count times or more.

    With drop_one_in = k, an occurrence loses a letter where k divides h, the crc32 of '<id>:<run>': the one at h modulo the run's
    length. So a table of words can be given misspellings that are the same in each run. A null id counts as empty.
    """
    text = F.translate(F.col(text_col), UPPER, LOWER)
    found = F.regexp_extract_all(text, F.lit(f"{RUN}{{{min_points},}}"), F.lit(0))  # shorter runs are no words, and never become any
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    word: Column = F.col("run")
    if drop_one_in:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % drop_one_in == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    counts = runs.select(word.alias("word")).where(F.length("word") >= min_points).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


class KdTree:
    """Splits of letter counts: at most `leaf` rows a leaf where counts differ. Leaves have numbers from 0; `rows[k]` are those of leaf k."""

    def __init__(self, counts, leaf: int):
        import numpy as np

        self.rows: list = []

        def grow(rows):
            some = counts[rows]
            if len(rows) > leaf:
                for dim in np.argsort(-some.var(axis=0), kind="stable").tolist():
                    low, high = int(some[:, dim].min()), int(some[:, dim].max())
                    if low == high:
                        break  # so are all further letters: the rows are anagrams
                    cut = min(max(int(np.median(some[:, dim])), low), high - 1)
                    left = some[:, dim] <= cut
                    return dim, cut, grow(rows[left]), grow(rows[~left])
            self.rows.append(rows)
            return len(self.rows) - 1

        self.root = grow(np.arange(len(counts)))

    def search(self, queries, up: int, down: int) -> Iterator[tuple]:
        """(leaf, rows of queries) wherever the leaf's box can be reached by adding at most `up` letters and taking at most `down`.

        A box is what the splits above leave of each letter's range. A query brings along how many letters it lacks and how many
        it has too many for the box; a split changes one letter's part of that.
        """
        import numpy as np

        start = np.zeros(len(queries), queries.dtype)
        stack = [(self.root, np.arange(len(queries)), start, start, {}, {})]
        while stack:
            node, at, lack, much, low, high = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            dim, cut, left, right = node
            q = queries[at, dim]
            over = much + np.maximum(q - cut, 0) - (np.maximum(q - high[dim], 0) if dim in high else 0)
            ok = over <= down
            stack.append((left, at[ok], lack[ok], over[ok], low, {**high, dim: cut}))
            under = lack + np.maximum(cut + 1 - q, 0) - (np.maximum(low[dim] - q, 0) if dim in low else 0)
            ok = under <= up
            stack.append((right, at[ok], under[ok], much[ok], {**low, dim: cut + 1}, high))


def by_length(words: list[bytes]) -> Iterator[tuple]:
    """(length, places, letters as a matrix, letter counts) of the words of each length."""
    import numpy as np

    sizes = np.fromiter(map(len, words), "i8", len(words))
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        letters = np.frombuffer(b"".join([words[k] for k in at.tolist()]), "u1").reshape(len(at), length)
        counts = np.empty((len(at), len(LETTERS)), "i2" if length < 1 << 15 else "i4")
        step = max(1, (1 << 22) // max(length, 256))
        for k in range(0, len(at), step):
            some = letters[k : k + step]
            n = np.bincount((some + 256 * np.arange(len(some))[:, None]).ravel(), minlength=256 * len(some))
            counts[k : k + step] = n.reshape(len(some), 256)[:, LETTERS]
        yield length, at, letters, counts


def one_edit(short, long):
    """Mask of the rows of two letter matrices that differ by exactly one replaced letter, or one inserted in `long`."""
    import numpy as np

    length = short.shape[1]
    if long.shape[1] == length:
        return (short != long).sum(axis=1) == 1
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= length


def near_pairs(queries: list[bytes], points: list[bytes], leaf: int = 12) -> Iterator[tuple]:
    """(places in queries, places in points) of words one edit apart, length pair by length pair."""
    import numpy as np

    asked = {length: parts for length, *parts in by_length(queries)}
    for length, where, letters, counts in by_length(points):
        used = counts.any(axis=0)
        mine = np.ascontiguousarray(counts[:, used])
        tree = KdTree(mine, leaf)
        for other, up, down in ((length, 1, 1), (length - 1, 1, 0), (length + 1, 0, 1)):
            if other not in asked:
                continue
            places, q_letters, q_counts = asked[other]
            extra = q_counts[:, ~used].sum(axis=1)  # letters that no point has must go
            able = np.flatnonzero(extra <= down)
            theirs = np.ascontiguousarray(q_counts[able][:, used])
            for k, at in tree.search(theirs, up, down):
                rows = tree.rows[k]
                step = max(1, (1 << 21) // max(1, len(rows) * mine.shape[1]))
                for s in range(0, len(at), step):
                    some = at[s : s + step]
                    gap = np.abs(theirs[some][:, None, :] - mine[rows][None, :, :]).sum(axis=2) + extra[able[some]][:, None]
                    i, j = np.nonzero(gap == up + down)
                    if not len(i):
                        continue
                    i, j = able[some[i]], rows[j]
                    hit = one_edit(letters[j], q_letters[i]) if other > length else one_edit(q_letters[i], letters[j])
                    if hit.any():
                        yield places[i[hit]], where[j[hit]]


class Cells:
    """Where words meet: cells of a k-d tree for each length with more than `cell` words, fitted on a sample; one for each other length.

    The sample only places the cuts. Any word has a cell, and a query is sent to all cells that hold words one edit away, so results
    don't depend on it. A short length beside a large one is dealt by `salts`: its words go to all salts, each query to one.
    """

    def __init__(self, sizes: dict[int, int], sample: list[bytes], rate: int, cell: int):
        self.trees, self.first, next_id = {}, {}, 1
        for length, _, _, counts in by_length(sample):
            if length in sizes:
                self.trees[length] = KdTree(counts, max(4, cell // rate))
                self.first[length] = next_id
                next_id += len(self.trees[length].rows)
                self.trees[length].rows = []  # the cuts are enough
        reach = lambda k: sum(sizes.get(k + d, 0) for d in (-1, 0, 1))
        self.salts = {k: 1 + reach(k) // (16 * cell) for length in sizes for k in (length - 1, length, length + 1) if k not in self.trees}

    def rows(self, words: list[bytes]) -> Iterator[tuple]:
        """(places, cells, is it a point): a row for each word's own cell, and one for each cell that its queries reach."""
        import zlib

        import numpy as np

        for length, at, _, counts in by_length(words):
            if length in self.trees:
                for k, some in self.trees[length].search(counts, 0, 0):
                    yield at[some], np.full(len(some), self.first[length] + k), True
            else:
                for salt in range(self.salts.get(length, 1)):
                    yield at, np.full(len(at), -(length << 20) - salt), True
            for other, up, down in ((length, 1, 1), (length - 1, 0, 1), (length + 1, 1, 0)):
                if other in self.trees:
                    for k, some in self.trees[other].search(counts, up, down):
                        yield at[some], np.full(len(some), self.first[other] + k), False
                else:
                    salts = self.salts.get(other, 1)
                    own = np.array([zlib.crc32(words[k]) % salts for k in at.tolist()], "i8") if salts > 1 else np.zeros(len(at), "i8")
                    yield at, -(other << 20) - own, False


def dealt_words(words: DataFrame, cells: Cells) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            coded = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for at, cell, is_point in cells.rows(coded):
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.full(len(at), is_point)), *taken.columns], names=["cell", "is_point", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "cell long, is_point boolean, word string, n long")


def near_words(words: DataFrame, *, cell: int = 1000, sample: int = 50_000) -> DataFrame:
    """word, n, n_near, best (struct of -n and word of the near word with the largest n, then the first; null without) for all of words.

    A task holds a cell's words as a k-d tree and searches it with the queries that reach the cell. It gives back one row for each of
    these, so pairs are never rows.
    """
    sizes = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("m"))
    large = {r["length"]: r["m"] for r in sizes.where(F.col("m") > cell).collect()}  # at most one for each `cell` words
    rate = 1 + sum(large.values()) // sample
    shown = words.where((F.pmod(F.xxhash64("word"), F.lit(rate)) == 0) & F.length("word").isin(list(large))).select("word") if large else None
    cells = Cells(large, [r["word"].encode("latin-1") for r in shown.collect()] if large else [], rate, cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for group in grouped(batches, "cell"):
            is_point = group.column("is_point").to_numpy()
            names = np.array([w.encode("latin-1") for w in group.column("word").to_pylist()], object)
            n = group.column("n").to_numpy()
            order = np.flatnonzero(is_point)
            order = order[np.argsort(names[order], kind="stable")]
            points, counts = names[order].tolist(), n[order]
            asked = np.flatnonzero(~is_point)
            for start in range(0, len(asked), 20_000):
                at = asked[start : start + 20_000]
                total, best = np.zeros(len(at), "i8"), np.full(len(at), -1, "i8")
                for q, p in near_pairs(names[at].tolist(), points):
                    total += np.bincount(q, minlength=len(at))
                    first = np.lexsort((p, -counts[p], q))
                    q, p = q[first], p[first]
                    head = np.flatnonzero(np.diff(q, prepend=-1))
                    q, p = q[head], p[head]
                    old = best[q]
                    better = (old < 0) | (counts[p] > counts[old]) | ((counts[p] == counts[old]) & (p < old))
                    best[q[better]] = p[better]
                has = best >= 0
                top = [points[k].decode("latin-1") if k >= 0 else None for k in best.tolist()]
                form = pa.StructArray.from_arrays([pa.array(-counts[best] if len(points) else best, pa.int64(), mask=~has), pa.array(top, pa.string())], names=["minus_n", "word"], mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([group.column("word").take(pa.array(at)).combine_chunks(), pa.array(n[at]), pa.array(total), form], names=["word", "n", "n_near", "best"])

    parts = dealt_words(words, cells).repartition("cell").sortWithinPartitions("cell")
    found = parts.mapInArrow(run, "word string, n long, n_near long, best struct<minus_n: long, word: string>")
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following form leads from each word of forms (word, form). Forms end: each occurs more often than its word.

    Each round doubles the steps behind a root, and is stored.
    """
    links = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(on, "root", "left_semi").isEmpty():
            return links
        longer = stored(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        discard(links)
        links = longer


def spelling_variants(
    docs: DataFrame, *, min_points: int = 6, min_count: int = 5, factor: int = 5, drop_one_in: int | None = None, cell: int = 1000, sample: int = 50_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of docs (see word_counts), each with the spelling it may be a variant of.

    Words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word with the largest n
    (then the first by code points), if that is at least factor * n; root is where forms lead in the end, the word itself if it has
    none. One edit changes letter counts by two at most, so only boxes of a k-d tree that near counts reach are searched, and the
    order of letters is verified on what is found there. Cuts between tasks are fitted on about `sample` words.

    Null and empty texts have no words, and a table without words gives no rows. Copies and repeated rows count as often as they
    occur. Other columns are ignored. Words of any length are whole. What is written in the shared folder goes, but the last two tables.
    """
    words = stored(word_counts(docs, min_points=min_points, min_count=min_count, drop_one_in=drop_one_in, id_col=id_col, text_col=text_col), "words")
    near = near_words(words, cell=cell, sample=sample)
    enough = F.col("best").isNotNull() & (-F.col("best.minus_n") >= factor * F.col("n"))
    found = stored(near.select("word", F.when(enough, F.col("best.word")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.minus_n")).alias("form_n")), "near-words")
    discard(words)
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


__all__ = ["near_words", "roots", "spelling_variants", "word_counts"]
