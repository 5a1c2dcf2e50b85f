"""Language-model scores by a probabilistic suffix tree over words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, scratch, slices, stored

#: The key of the end of a text; that of a word is a 64-bit hash of its bytes.
END = 0
#: Bits of a filter of keys. What passes a filter is checked by a join: a full filter spares no rows, but changes no result.
FILTER = 1 << 26
#: Most rows of a table that each worker reads to settle frequent rows without a join. It spares rows and changes no result.
AT_HAND = 1_000_000
#: The same for entries of a length. Others are asked for in packs: with few at hand that costs about as much a token in a small corpus as in a large one.
ENTRIES_AT_HAND = 100_000
#: Numbers under this one stand for words at hand in packs of counts; no word's key is among them.
CODES = 1 << 24
#: Bytes of an Arrow batch, about: texts and packs are large rows.
BATCH = 8 << 20
#: Joins of longer contexts and requests run in up to 3 slices, one a so many training tokens: the shuffle files of one go before the next.
SLICE = 5_000_000
#: What a pack holds or asks for: entries and states of the tree, counts of words.
ENTRIES, STATES, WORDS = range(3)


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out: crc32 of the id's text modulo 5 is 1 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


@lru_cache(maxsize=1)
def tables():
    """By byte: is it white space, and a fixed random number of it in lower case."""
    import numpy as np

    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    numbers = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 64, 256, dtype="u8")
    numbers[ord("A") : ord("Z") + 1] = numbers[ord("a") : ord("z") + 1]
    numbers[space] = 0
    return space, numbers


def scrambled(z):
    """A 64-bit hash of 64-bit unsigned numbers."""
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB
    return z ^ (z >> 31)


def tokens_of(texts: pa.Array):
    """(key of each token, tokens of each text). Words are A-Z in lower case, parted by 0x20 and 0x09 to 0x0D; a text's last token is END.

    A word's key sums a random number of each byte times one of the byte's place.
    """
    import numpy as np

    space, numbers = tables()
    edges = np.frombuffer(texts.buffers()[1], "i4", len(texts) + 1, 4 * texts.offset).astype("i8")
    raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[edges[0] : edges[-1]]
    edges = edges - edges[0]
    blank = space[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    bounds = edges[:-1][edges[:-1] < len(raw)]
    first[bounds] = ~blank[bounds]
    starts = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(first)])[edges]
    sizes = np.diff(before) + 1
    out = np.full(int(sizes.sum()), END, "i8")
    if len(starts):
        lengths = np.diff(np.append(starts, len(raw)))
        weights = scrambled(np.arange(1, int(lengths.max()) + 1, dtype="u8")) | np.uint64(1)
        place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
        keys = np.add.reduceat(numbers[raw[starts[0] :]] * weights[place], starts - starts[0])
        keys = scrambled(keys)
        keys = np.where(keys < CODES, keys + np.uint64(CODES), keys).view("i8")
        inside = np.ones(len(out), bool)
        inside[np.cumsum(sizes) - 1] = False
        out[inside] = keys
    return out, sizes


def places(sizes):
    """(text of each token, place in its text), from 0."""
    import numpy as np

    return np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def summed(keys, n):
    """Distinct keys (one array, or rows of two), sorted, and the sums of n."""
    import numpy as np

    by = keys if keys.ndim == 1 else mixed(keys[0], keys[1])
    order = np.argsort(by)
    by = by[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), bool), by[1:] != by[:-1]]))
    return keys[..., order[starts]], np.add.reduceat(n[order], starts) if len(starts) else n


class Tally:
    """Counts of keys in bounded arrays: summed when they are full, and given out when sums don't make room."""

    def __init__(self, most: int, width: int):
        self.most, self.width, self.size = most, width, 0
        self.keys: list = []
        self.n: list = []

    def add(self, keys, n) -> bool:
        """True if it is full."""
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(n)
        if self.size > self.most:
            self.total()
        return self.size > self.most // 2

    def total(self):
        import numpy as np

        shape = (0,) if self.width == 1 else (self.width, 0)
        keys, n = np.concatenate([np.zeros(shape, "i8"), *self.keys], axis=-1), np.concatenate([np.zeros(0, "i8"), *self.n])
        self.keys = self.n = []  # not held twice
        keys, n = summed(keys, n)
        self.keys, self.n, self.size = [keys], [n], len(n)
        return keys, n

    def take(self):
        out = self.total()
        self.keys, self.n, self.size = [], [], 0
        return out


def bounds_of(parts: int):
    """The least key of each of `parts` equal ranges of 64-bit keys."""
    import numpy as np

    return np.array([(i << 64) // parts - (1 << 63) for i in range(parts)], "i8")


def in_planes(x):
    import numpy as np

    return np.ascontiguousarray(x.view("u1").reshape(-1, 8).T)


def squeezed(columns: list) -> bytes:
    """64-bit columns in one value, by bytes of equal weight: the first sorted, as differences."""
    import numpy as np

    first, *others = columns
    if (first[1:] < first[:-1]).any():
        order = np.argsort(first)
        first, *others = (c[order] for c in columns)
    steps = first.copy()
    steps[1:] -= first[:-1]
    raw = b"".join(map(in_planes, [steps, *(np.ascontiguousarray(c) for c in others)]))
    return len(first).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def opened(value: bytes, width: int) -> list:
    """The columns of a squeezed value."""
    import numpy as np

    n = int.from_bytes(value[:4], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(value[4:], 8 * n * width, asbytes=True), "u1").reshape(width, 8, n)
    columns = [np.ascontiguousarray(x.T).view("i8").reshape(-1) for x in raw]
    return [np.cumsum(columns[0]), *columns[1:]]


def packed(columns: list, by, parts: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A row for each range of the sorted keys `by` that has any: part, and the 64-bit columns of its records in one binary value.
    They come in batches of about `most` bytes."""
    import numpy as np

    edges = np.append(np.searchsorted(by, bounds_of(parts)), len(by)).tolist()
    held, values, size = [], [], 0
    for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            held.append(part)
            values.append(squeezed([c[a:b] for c in columns]))
            size += len(values[-1])
        if held and (size > most or part == parts - 1):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(values, pa.binary())], names=["part", "records"])
            held, values, size = [], [], 0


def counted(packs: DataFrame, parts: int, names: list[str], least: int, words: str = "", codes: int = 0, most: int = 1_200_000) -> DataFrame:
    """The named keys and their n, summed over packs of (keys, n), if it is `least` or more. Each range of keys is summed in a task of its own.
    The last `codes` keys come as codes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tally = Tally(most, len(names))
        for batch in batches:
            for value in batch.column(0):
                *keys, n = opened(value.as_py(), len(names) + 1)
                tally.add(keys[0] if len(keys) == 1 else np.stack(keys), n)
                if tally.size > tally.most // 2:  # room grows with the distinct keys
                    tally.most = 2 * max(tally.size, most)
        keys, n = tally.take()
        some = np.flatnonzero(n >= least)
        keys = np.atleast_2d(keys)[:, some]
        keys = [*keys[: len(keys) - codes], *(uncoded(words, x) for x in keys[len(keys) - codes :])]
        for at in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (*keys, n[some])], names=[*names, "n"])

    return packs.repartitionById(parts, F.col("part")).select("records").mapInArrow(run, "".join(f"{k} long, " for k in names) + "n long")


def partitions(spark, records: int = 0) -> int:
    """Ranges of keys: as many as Spark's shuffle partitions, and more if one would have over 1.5 million of the records."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records // 1_500_000))


def count_words(train: DataFrame, most: int = 1_000_000) -> DataFrame:
    """key, n of all words of the training texts, and of their ends. Tasks count first, in bounded arrays."""
    parts = partitions(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap.cache_clear(), sorted_table.cache_clear(), ranks.cache_clear()  # of an earlier tree
        tally = Tally(most, 1)

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = tally.take()
            return packed([keys, n], keys, parts)

        for part in slices(batches, "text", 2 << 20):
            found = pa.array(tokens_of(part.column(0))[0]).value_counts()
            if tally.add(found.field(0).to_numpy(), found.field(1).to_numpy()):
                yield from out()
        yield from out()

    return counted(train.mapInArrow(run, "part int, records binary"), parts, ["key"], 1)


def mixed(a, b):
    """A 64-bit hash of each pair of keys, which depends on their order."""
    z = a.view("u8") * 0x9E3779B97F4A7C15 + b.view("u8")
    z = (z ^ (z >> 29)) * 0xBF58476D1CE4E5B9
    return (z ^ (z >> 32)).view("i8")


def shifted(keys):
    import numpy as np

    out = np.zeros(len(keys), keys.dtype)
    out[1:] = keys[:-1]
    return out


def contexts_of(symbols, depth: int) -> list:
    """For each length up to depth the keys of the contexts before each symbol; they mean nothing where a text has fewer symbols."""
    last = shifted(symbols)
    out = [last]
    for _ in range(1, depth):
        out.append(mixed(shifted(out[-1]), last))
    return out


def in_slices(total: int) -> int:
    return min(3, 1 + total // SLICE)


def write_filter(keys: DataFrame, name: str) -> str:
    """Bitmaps of the last bits of the column key, in 2,048 rows at most for any corpus; their path."""
    path, bit = scratch(keys.sparkSession, name), F.col("key").bitwiseAND(F.lit(FILTER - 1))
    keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits")).write.parquet(path)
    return path


def read_table(uri: str) -> dict:
    from pyarrow import dataset, fs

    store, path = fs.FileSystem.from_uri(uri)
    found = dataset.dataset(path, filesystem=store, format="parquet").to_table()
    return {name: found.column(name).combine_chunks() for name in found.column_names}


@lru_cache(maxsize=8)
def bitmap(uri: str):
    import numpy as np

    t, out = read_table(uri), np.zeros((FILTER >> 15, 4096), "u1")
    for bucket, bits in zip(t["bucket"].to_pylist(), t["bits"].to_pylist(), strict=True):
        out[bucket] = np.frombuffer(bits, "u1")
    return out.reshape(-1)


def may_hold(bits, keys):
    """False for keys that surely aren't in the filter."""
    at = keys & (FILTER - 1)
    return (bits[at >> 3] >> (at & 7).astype("u1")) & 1 == 1


def entry_bits(context, following):
    """What an entry sets in a filter; as a Column or in arrays."""
    return context.bitwiseXOR(F.shiftright(following, 7)) if isinstance(context, Column) else context ^ (following >> 7)


@lru_cache(maxsize=8)
def sorted_table(uri: str):
    """(sorted keys, values) of a small table, read once by each Python worker; the keys are `key`, or pairs of context and next."""
    import numpy as np

    t = {name: c.to_numpy(zero_copy_only=False) for name, c in read_table(uri).items()}
    keys = t["key"] if "key" in t else mixed(t["context"], t["next"])
    order = np.argsort(keys)
    return keys[order], t["value"][order]


@lru_cache(maxsize=1)
def ranks(uri: str):
    """(rank of each word of sorted_table, by its n; keys by rank)."""
    import numpy as np

    keys, n = sorted_table(uri)
    order = np.argsort(-n, kind="stable")
    out = np.empty(len(order), "i8")
    out[order] = np.arange(len(order))
    return out, keys[order]


def coded(uri: str, keys):
    """Keys of words, with the rank instead for those at hand."""
    import numpy as np

    at = found_at(sorted_table(uri), keys)
    return np.where(at >= 0, ranks(uri)[0][at], keys) if len(ranks(uri)[0]) else keys


def uncoded(uri: str, codes):
    out, by_rank = codes.copy(), ranks(uri)[1]
    some = (codes >= 0) & (codes < len(by_rank))
    out[some] = by_rank[codes[some]]
    return out


def found_at(table: tuple, keys):
    """Places of keys in a sorted table, -1 for those that it lacks."""
    import numpy as np

    if not len(table[0]):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, at, -1)


def at_hand(rows: DataFrame, n: str, columns: list[Column], most: int | None = None) -> tuple[str, bool]:
    """Writes the columns of the rows of largest n, at most AT_HAND of them (and `most`); its path, and if these are all rows."""
    most = AT_HAND if most is None else min(most, AT_HAND)
    power = F.when(F.col(n) < 16, F.col(n)).otherwise(F.floor(F.log2(n)) + 12).cast("int")
    sizes = {r["power"]: r["rows"] for r in rows.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # 80 rows at most
    held, least = 0, 80
    for p in sorted(sizes, reverse=True):
        if held + sizes[p] > most:
            break
        held, least = held + sizes[p], p
    path = scratch(rows.sparkSession, "at-hand")
    rows.where(power >= least).select(*columns).write.parquet(path)
    return path, held == sum(sizes.values())


def count_nexts(train: DataFrame, allowed: str, depth: int, total: int, words: str, most: int = 900_000) -> DataFrame:
    """context, next, n > 1 for contexts of `depth` symbols that pass the filter `allowed`. Tasks count first, in bounded arrays.
    words: path of those at hand; they travel as codes."""
    parts, codes = partitions(train.sparkSession, total), 2 if depth == 1 else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bits, tally = bitmap(allowed), Tally(most, 2)

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = tally.take()
            by = mixed(keys[0] if codes == 1 else uncoded(words, keys[0]), uncoded(words, keys[1]))
            order = np.argsort(by)
            return packed([*keys[:, order], n[order]], by[order], parts)

        for part in slices(batches, "text", 2 << 20):
            symbols, sizes = tokens_of(part.column(0))
            _, place = places(sizes)
            distinct = pa.array(symbols).dictionary_encode()
            code = coded(words, distinct.dictionary.to_numpy())[distinct.indices.to_numpy()]
            context = contexts_of(symbols, depth)[-1]
            found = np.flatnonzero((place >= depth) & may_hold(bits, context))
            context = context if codes == 1 else shifted(code)
            if tally.add(np.stack([context[found], code[found]]), np.ones(len(found), "i8")):
                yield from out()
        yield from out()

    return counted(train.mapInArrow(run, "part int, records binary"), parts, ["context", "next"], 2, words, codes)


def longer(pairs: DataFrame, length: int) -> DataFrame:
    """context, suffix, m: contexts of length + 1 symbols from pairs (context, suffix, next, n) of contexts of `length` with their next symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, suffix, following = (batch.column(k).to_numpy() for k in range(3))
            made = [mixed(context, following), following if length == 1 else mixed(suffix, following)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), batch.column(3)], names=["context", "suffix", "m"])

    return pairs.select("context", "suffix", "next", "n").mapInArrow(run, "context long, suffix long, m long")


class Level:
    """States (context, n, rest) and entries (context, next, n, ratio, more) of one length; those at hand (if that is all of them), and filters."""

    def __init__(self, states: DataFrame, entries: DataFrame):
        self.states, self.entries = states, entries
        self.states_at_hand, self.all_states = at_hand(states, "n", [F.col("context").alias("key"), F.col("rest").cast("float").alias("value")])
        self.entries_at_hand, self.all_entries = at_hand(entries, "n", [F.col("context"), F.col("next"), F.col("ratio").cast("float").alias("value")], ENTRIES_AT_HAND)
        self.state_filter = write_filter(states.select(F.col("context").alias("key")), "filter")
        self.entry_filter = write_filter(entries.select(entry_bits(F.col("context"), F.col("next")).alias("key")), "filter")


class Model:
    """Sizes of the training text, the path of the words at hand (all words if `complete`), and the tree by length of context."""

    def __init__(self, total: int, distinct: int, words_at_hand: str, complete: bool):
        self.total, self.distinct, self.words_at_hand, self.complete = total, distinct, words_at_hand, complete
        self.levels: list[Level] = []
        self.tables: list[DataFrame] = []  # stored, behind the levels

    def alone(self, n):
        """Probability of a token that occurs n times, by its count alone."""
        return (n + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def smoothed(pairs: DataFrame, least_gain: float) -> DataFrame:
    """The pairs of contexts with all their next symbols, for train_tree(): ratio, and where the context is retained its rest and more."""
    w = Window.partitionBy("context")
    pairs = pairs.withColumn("once", F.col("m") - F.sum("n").over(w)).withColumn("distinct", F.count(F.lit(1)).over(w) + F.col("once"))
    p, others = F.col("alone") * F.col("below"), F.col("m") - 1
    left_out = F.log(((F.col("n") - 2) / p + F.col("distinct")) / others)
    left_once = F.when(F.col("once") > 0, F.col("once") * F.log(F.greatest(F.col("distinct") - 1, F.lit(1)) / others)).otherwise(0.0)
    gain = F.sum(F.col("n") * left_out).over(w) + left_once
    pairs = pairs.withColumns({"gain": gain, "least": F.min("next").over(w)})
    rest = F.when(F.col("gain") > least_gain, F.col("distinct") / F.col("m"))
    weight = (F.col("n") - 1) / F.col("m") / F.col("alone") + F.col("rest") * F.col("below")
    ratio = F.when(F.col("rest").isNull(), F.col("below")).otherwise(weight).alias("ratio")
    head = F.when(F.col("next") == F.col("least"), F.col("m")).alias("head")  # in one row of each context
    more = F.log10(weight / (F.col("rest") * F.col("below"))).cast("float").alias("more")
    return pairs.withColumn("rest", rest).select("context", "suffix", "next", "n", "alone", "rest", ratio, more, head)


def train_tree(train: DataFrame, words: DataFrame, *, depth: int, divergence: float, min_count: int) -> Model:
    """The suffix tree of training texts, given their word counts.

    A context may be a state if it occurs min_count times (m), and its suffix is a state or empty. Its next symbols are smoothed by what occurs once: a symbol that
    follows it n > 1 times is an entry of weight (n - 1) / m, and the rest, distinct next symbols / m, is left to the suffix. It
    is retained if its next symbols diverge from those of its suffix: the sum of ln(p / p by the suffix) over its occurrences,
    each left out of the counts that predict it, must exceed divergence * ln(tokens). All words are symbols, and all entries of a
    state are kept: the tree grows with the corpus and stays in tables. An entry's ratio is its mixed probability over the one by
    the word's count alone; more is log10 of its ratio over the one that its state would leave it without the entry.
    """
    spark = train.sparkSession
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    model = Model(int(sums["total"]), int(sums["distinct"]), *at_hand(words, "n", [F.col("key"), F.col("n").alias("value")]))
    contexts = words.where((F.col("key") != END) & (F.col("n") >= min_count)).select(F.col("key").alias("context"), F.lit(END).cast("long").alias("suffix"), F.col("n").alias("m"))
    below = words.where("n > 1").select(F.col("key").alias("next"), model.alone(F.col("n")).alias("alone"), F.lit(1.0).alias("below"))
    contexts_stored: list[DataFrame] = []
    for length in range(1, depth + 1):
        allowed = write_filter(contexts.select(F.col("context").alias("key")), "allowed")
        counts, full = stored(count_nexts(train, allowed, length, model.total, model.words_at_hand), "pairs", BATCH), []
        n = 1 if length == 1 else in_slices(model.total)
        for k in range(n):
            of_slice = F.pmod("suffix", F.lit(n)) == k
            # what follows a context twice follows its suffix twice, so no row is lost
            if length == 1:
                pairs = counts.join(below, "next").join(contexts, "context")
            else:
                pairs = counts.join(contexts.where(of_slice), "context").join(below.where(of_slice), ["suffix", "next"])
            full.append(stored(smoothed(pairs, divergence * math.log(max(2, model.total))), "tree"))
        discard(counts, *contexts_stored)
        model.tables.extend(full)
        full = reduce(DataFrame.union, full)
        states = full.where("rest is not null and head is not null").select("context", F.col("head").alias("n"), "rest")
        model.levels.append(Level(states, full.where("rest is not null").select("context", "next", "n", "ratio", "more")))
        if length < depth:
            contexts = longer(full.where((F.col("next") != END) & (F.col("n") >= min_count)), length)
            contexts = stored(contexts.join(states.select(F.col("context").alias("suffix")), "suffix", "left_semi"), "contexts")
            contexts_stored = [contexts]
            below = full.where("rest is not null").select(F.col("context").alias("suffix"), "next", "alone", F.col("ratio").alias("below"))  # suffixes are states
    return model


#: What is known of a text before packs are answered; row is its number.
TEXTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, by_tree double"


def score_parts(docs: DataFrame, model: Model, parts: int) -> DataFrame:
    """Rows of two kinds: of a text, with what its tokens at hand add; and packs (asks, kind, part, records) of requests for what
    isn't at hand: (key, number of the text, from the row `asks`).

    An entry at hand settles its symbol up to its length; else a state leaves its rest to the suffix, and an entry of it adds its
    `more`. So requests add up in any order, and a word that isn't at hand counts as unseen until it is found."""
    names = ["asks", "kind", "part", "records", *(c.split()[0] for c in TEXTS.split(", "))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def rows(**columns) -> pa.RecordBatch:
        some = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(some, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def requests(first: int, asked: list[list]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for kind, found in enumerate(asked):
            if found:
                key, of = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(key)
                for made in packed([key[order], of[order]], key[order], parts):
                    yield rows(asks=np.full(made.num_rows, first), kind=np.full(made.num_rows, kind), part=made.column(0), records=made.column(1))

    paths = [(x.state_filter, x.entry_filter, x.states_at_hand, x.entries_at_hand, x.all_states, x.all_entries) for x in model.levels]
    at_hand, complete, total, distinct = model.words_at_hand, model.complete, model.total, model.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ranks.cache_clear()
        words, levels = sorted_table(at_hand), [(bitmap(a), bitmap(b), sorted_table(c), sorted_table(d), *whole) for a, b, c, d, *whole in paths]
        task = TaskContext.get().partitionId()
        row = first_row = task << 33
        asked: list[list] = [[], [], []]
        for part in slices(batches, "text", 2 << 20):
            symbols, sizes = tokens_of(part.column(2))
            text, place = places(sizes)
            starts, coded = np.cumsum(sizes) - sizes, pa.array(symbols).dictionary_encode()
            keys, codes_of = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype("i8")
            at = found_at(words, keys)
            n = np.where(at >= 0, words[1][at] if len(words[1]) else 0, 0)
            base = np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))[codes_of]
            number = text + (row - first_row)
            if not complete:
                some = np.flatnonzero((at < 0)[codes_of])
                asked[WORDS].append((symbols[some], number[some]))
            whole, settled, open_at = np.ones(len(symbols)), np.zeros(len(symbols), "i1"), []  # settled: length of the longest entry at hand
            contexts = contexts_of(symbols, len(levels))
            for length, (states, entries, state_table, entry_table, all_states, all_entries) in enumerate(levels, 1):
                some = np.flatnonzero((place >= length) & may_hold(states, contexts[length - 1]))
                state = found_at(state_table, contexts[length - 1][some])
                if all_states:
                    some, state = some[state >= 0], state[state >= 0]
                context, following = contexts[length - 1][some], symbols[some]
                maybe = may_hold(entries, entry_bits(context, following))
                key, entry = mixed(context, following), np.full(len(some), -1)
                entry[maybe] = found_at(entry_table, key[maybe])
                hit = entry >= 0
                whole[some[hit]], settled[some[hit]] = entry_table[1][entry[hit]], length
                stays = ~hit & (state >= 0)
                if len(state_table[1]):
                    whole[some[stays]] *= state_table[1][state[stays]]
                if not all_states:
                    asking = ~hit & (state < 0)
                    open_at.append((STATES, length, some[asking], context[asking]))
                if not all_entries:
                    asking = ~hit & maybe
                    open_at.append((ENTRIES, length, some[asking], key[asking]))
            for kind, length, some, key in open_at:
                still = settled[some] < length
                asked[kind].append((key[still], number[some[still]]))
            yield rows(
                asks=np.full(len(sizes), first_row),
                part=np.full(len(sizes), task % parts),
                row=np.arange(row, row + len(sizes)),
                doc_id=part.column(0),
                held_out=part.column(1),
                n_tokens=sizes,
                n_known=np.add.reduceat((n > 0)[codes_of].astype("i8"), starts),
                base_score=np.add.reduceat(base, starts),
                by_tree=np.add.reduceat(np.log10(whole), starts),
            )
            row += len(sizes)
            if sum(len(key) for found in asked for key, _ in found) > 500_000 or row - first_row > 50_000:
                yield from requests(first_row, asked)
                asked, first_row = [[], [], []], row
        yield from requests(first_row, asked)

    return docs.mapInArrow(run, f"asks long, kind int, part int, records binary, {TEXTS}")


def packs(table: DataFrame, kind: int, parts: int, most: int = 500_000) -> DataFrame:
    """asks (null), kind, part, records: packs of (key, value); a row's key is its first column, or the hash of its first two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(held: list) -> Iterator[pa.RecordBatch]:
            key, value = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            for made in packed([key[order], value[order]], key[order], parts):
                yield pa.RecordBatch.from_arrays([pa.nulls(made.num_rows, pa.int64()), pa.array(np.full(made.num_rows, kind, "i4")), *made.columns], names=["asks", "kind", "part", "records"])

        held = []
        for batch in batches:
            *keys, value = (c.to_numpy() for c in batch.columns)
            value = value.copy() if kind == WORDS else value.view("u4").astype("i8")
            held.append((mixed(*keys) if len(keys) == 2 else keys[0].copy(), value))
            if sum(len(x[0]) for x in held) > most:
                yield from out(held)
                held = []
        if held:
            yield from out(held)

    return table.mapInArrow(run, "asks long, kind int, part int, records binary")


def all_packs(words: DataFrame, model: Model, ranges: int) -> DataFrame | None:
    """Packs of all tables that aren't at hand as a whole; None if all are."""
    tables = [] if model.complete else [packs(words.select("key", "n"), WORDS, ranges)]
    for level in model.levels:
        if not level.all_states:
            tables.append(packs(level.states.select("context", F.log10("rest").cast("float")), STATES, ranges))
        if not level.all_entries:
            tables.append(packs(level.entries.select("context", "next", "more"), ENTRIES, ranges))
    return stored(reduce(DataFrame.union, tables), "packs", BATCH) if tables else None


def answered(parts: DataFrame, tables: DataFrame | None, ranges: int) -> DataFrame:
    """The rows of texts, and packs (asks, kind, records) of answers: (number of the text, how many of its requests were found, their
    sum). Requests meet the rows of their range of keys."""
    names = ["asks", "kind", "records", *(c.split()[0] for c in TEXTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, asked = [[], [], []], [[], [], []]
        for batch in batches:
            request = batch.column(2).is_valid()
            texts, some = batch.filter(batch.column(2).is_null()), batch.filter(request)
            if texts.num_rows:
                yield texts
            for first, kind, records in zip(*(some.column(k).to_pylist() for k in range(3)), strict=True):
                if first is None:
                    held[kind].append(opened(records, 2))
                else:
                    asked[kind].append((first, records))  # squeezed until all rows are here
        for kind, requests in enumerate(asked):
            if not held[kind]:
                continue
            key, value = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            order = np.argsort(key)
            key, value = key[order], value[order]
            more = np.log10((value + 0.5) / 0.5) if kind == WORDS else value.astype("u4").view("f4").astype("f8")
            for first, records in requests:
                wanted, text = opened(records, 2)
                place = found_at((key,), wanted)
                text, which = np.unique(text[place >= 0], return_inverse=True)
                if len(text):
                    sums = np.bincount(which, more[place[place >= 0]]).view("i8")
                    made = {"asks": [first], "kind": [kind], "records": [squeezed([text, np.bincount(which).astype("i8"), sums])]}
                    yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) if x.name in made else pa.nulls(1, x.type) for x in batch.schema], schema=batch.schema)

    both = parts if tables is None else parts.unionByName(tables, allowMissingColumns=True)
    return both.repartitionById(ranges, F.col("part")).select(*names).mapInArrow(run, f"asks long, kind int, records binary, {TEXTS}")


def totals(parts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score: texts with the answers to their requests. Those of a task meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        texts, answers = [], []
        for batch in batches:
            some = batch.filter(batch.column(2).is_valid())
            answers.extend(zip(*(some.column(k).to_pylist() for k in range(3)), strict=True))
            texts.append(batch.filter(batch.column(2).is_null()))
        if not texts:
            return
        table = pa.Table.from_batches(texts).sort_by("row")
        row, known, base, tree = (table.column(c).to_numpy().copy() for c in ("row", "n_known", "base_score", "by_tree"))
        for first, kind, records in answers:
            text, n, sums = opened(records, 3)
            at = np.searchsorted(row, first + text)
            if kind == WORDS:
                known[at] += n
                base[at] += sums.view("f8")
            else:
                tree[at] += sums.view("f8")
        out = table.select(["doc_id", "held_out", "n_tokens"])
        for name, column in (("n_known", known), ("base_score", base), ("score", base + tree)):
            out = out.append_column(name, pa.array(column))
        yield from out.to_batches(20_000)

    ranges = partitions(parts.sparkSession)
    by_task = parts.repartitionById(ranges, F.pmod(F.shiftright("asks", 33), F.lit(ranges)).cast("int"))
    return by_task.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def suffix_tree_scores(docs: DataFrame, *, depth: int = 3, min_count: int = 5, divergence: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; learns from texts that aren't held out.

    base_score adds log10 probabilities by word counts alone. score is the log10 probability under the suffix tree (train_tree):
    the longest state that the text before a token ends in gives its word's probability, mixed with its suffixes down to the
    word's count. Frequent words, states and entries are looked up, all others are asked for in packs: neither the vocabulary nor the tree
    has to fit anywhere. Words and contexts are told apart by 64-bit hashes. Texts are numbered as they come: a task that runs again
    must meet its rows in the same order, as it does where docs are read from files.

    A null text is empty: one token, its end. Null ids count as the empty id text and are kept. Repeated rows stay rows of their
    own. Without training texts every probability by counts is 1. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text.alias("text"))
    train = rows.where("not held_out").select("text")
    words = stored(count_words(train), "words", BATCH)
    model = train_tree(train, words, depth=depth, divergence=divergence, min_count=min_count)
    ranges = partitions(docs.sparkSession, model.total)
    n = in_slices(model.total)
    some = [rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k) for k in range(n)]
    tables = all_packs(words, model, ranges)
    discard(words, *model.tables)
    parts = [stored(answered(score_parts(x, model, ranges), tables, ranges), "parts", BATCH) for x in some]
    discard(*([] if tables is None else [tables]))
    scores = reduce(DataFrame.union, map(totals, parts))
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
