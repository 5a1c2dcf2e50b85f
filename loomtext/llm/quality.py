"""Quality rules: counts of each document, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: White space as the contract has it, and the characters that count as symbols.
SPACE = "\t\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(windows: Column, width: int) -> Column:
    """Words covered by windows that occur twice or more, from the hashes of all windows by position.

    Only a text with a repeat sorts its windows: equal ones become neighbours, and the sorted places of those that have an
    equal neighbour are walked once.
    """

    def covered(by_hash: Column) -> Column:
        at = lambda k: F.get(by_hash, k)["h"]
        twice = F.filter(by_hash, lambda e, k: F.coalesce(at(k - 1) == e["h"], F.lit(False)) | F.coalesce(at(k + 1) == e["h"], F.lit(False)))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda e: e["i"])), start, step, lambda acc: acc["n"])

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, covered))


def with_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _lines (split at newlines) and _line_words (the words of each line) to docs; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = lambda line: F.filter(F.split(F.translate(line, SPACE, "    "), " "), lambda w: w != "")
    return docs.withColumn("_lines", F.split(text, "\n")).withColumn("_line_words", F.transform("_lines", words))


def text_key(text: str) -> list[Column]:
    """_t, _u: 128 bits of hashes of a text, null as empty."""
    c = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(c).alias("_t"), F.xxhash64(F.reverse(c)).alias("_u")]


def line_hash(words: Column) -> Column:
    """Of a normalised line: its words in lower case, one space apart."""
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def frequent_lines(docs: DataFrame, *, min_docs: int, root_factor: float, host_col: str, text_col: str) -> DataFrame:
    """host, line: hashes of normalised lines in more than min_docs and more than root_factor * sqrt(n) of the n documents of the host.

    Equal texts of a host count as one document. The limit grows far slower than the host, so a large one doesn't hide what many
    of its documents share.
    """
    lines = with_lines(docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(text_col).alias("text")), "text")
    hashes = F.array_distinct(F.transform(F.filter("_line_words", lambda ws: F.size(ws) > 0), line_hash))
    texts = lines.select("host", *text_key("text"), hashes.alias("hashes")).dropDuplicates(["host", "_t", "_u"])
    in_host = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    counts = texts.select("host", F.explode("hashes").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    return counts.join(in_host, "host").where(F.col("n") > F.lit(root_factor) * F.sqrt("n_host")).select("host", "line")


def frequent_places(docs: DataFrame, frequent: DataFrame, most: int, *, host_col: str, text_col: str) -> DataFrame:
    """_host, _t, _u (hashes of a text), _hits: for each text of a host with frequent lines their places and words, array of struct i, n.

    Lines are joined to the table of frequent ones by (host, hash), one look-up a line however many lines a host has. Up to `most`
    frequent lines (16 bytes each) are counted and broadcast; beyond that both sides are dealt by host and hash, so that a host
    is many tasks. Only places of frequent lines are shuffled, by their text.
    """
    lines = with_lines(docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("_host"), F.col(text_col).alias("text")), "text")
    hashed = F.filter(F.transform("_line_words", lambda ws, i: F.struct(i.alias("i"), F.when(F.size(ws) > 0, line_hash(ws)).alias("line"), F.size(ws).alias("n"))), lambda e: e["line"].isNotNull())
    keyed = lines.select("_host", *text_key("text"), hashed.alias("all"))  # below the explode, or each line would hash its whole text
    # outer, as Spark would filter by the array's size first and so make it twice; the join leaves nulls out
    rows = keyed.select("_host", "_t", "_u", F.explode_outer("all").alias("e")).select("_host", "_t", "_u", "e.i", "e.line", "e.n")
    known = frequent.select(F.col("host").alias("_host"), "line")
    small = frequent.count() <= most
    hits = rows.join(F.broadcast(known) if small else known, ["_host", "line"])
    return hits.groupBy("_host", "_t", "_u").agg(F.collect_set(F.struct("i", "n")).alias("_hits"))  # equal texts count once


def quality(
    docs: DataFrame,
    *,
    min_words: int = 20,
    max_repeat_pct: int = 30,
    window: int = 8,
    min_docs: int = 10,
    root_factor: float = 1.0,
    max_lost_share: float = 0.70,
    broadcast_lines: int = 1_000_000,
    host_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_frequent_lines, lost_words, left_text, kept.

    A line is frequent if more than min_docs documents of its host, and more than root_factor times the square root of their
    number, have it (normalised; equal texts count once, so that exact copies don't look like boilerplate). left_text is the text
    without frequent lines. A document is depleted, and not kept, if frequent lines hold more than max_lost_share of its words;
    also if it has under min_words words, or repeated windows of `window` words hold more than max_repeat_pct percent of them
    (base_failed). Windows and lines are compared by 64-bit hashes.

    Null and empty texts have no words and fail; their left_text is empty. A null host is the host "". Repeated rows each get
    the same result. Columns of docs that have a result's name are replaced, all others stay whatever their name. Frequent lines
    are written once to the shared folder; up to broadcast_lines of them are broadcast (see frequent_places).
    """
    n = F.col("n_words").cast("int")
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_lines", "lost_words", "left_text", "kept"]
    names = [c for c in docs.columns if c not in results]
    own = [f"own{k}" for k in range(len(names))]
    text = F.col("_text")
    renamed = [F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)]
    rows = docs.select(*renamed, F.coalesce(F.col(host_col), F.lit("")).alias("_host"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = with_lines(rows, "_text")
    rows = rows.withColumn("_words", F.flatten("_line_words")).withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    places = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_windows", let(F.col("_hashes"), lambda hs: F.transform(places, lambda i: F.xxhash64(F.slice(hs, i, window)))))
    with_word = F.filter("_lines", lambda line, i: F.size(F.get("_line_words", i)) > 0)
    counted = rows.select(
        *own,
        "_host",
        "_text",
        *text_key("_text"),
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(with_word, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows"), window).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))

    frequent = stored(frequent_lines(docs, min_docs=min_docs, root_factor=root_factor, host_col=host_col, text_col=text_col), "frequent-lines")
    places = frequent_places(docs, frequent, broadcast_lines, host_col=host_col, text_col=text_col)
    joined = counted.join(places, ["_host", "_t", "_u"], "left")
    has = F.col("_hits").isNotNull()
    lines = F.split(text, "\n")
    stay = let(lines, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.transform("_hits", lambda e: e["i"])), lambda i: F.get(ls, i)))
    return joined.select(
        *[F.col(o).alias(c) for c, o in zip(names, own, strict=True)],
        *results[:6],
        F.when(has, F.size("_hits")).otherwise(0).cast("long").alias("n_frequent_lines"),
        F.when(has, F.aggregate("_hits", F.lit(0), lambda acc, e: acc + e["n"])).otherwise(0).cast("long").alias("lost_words"),
        F.when(has, F.array_join(stay, "\n")).otherwise(text).alias("left_text"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.lit(max_lost_share) * F.col("n_words")))
