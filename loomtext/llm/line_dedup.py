"""Line dedup by content-defined chunks of lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import let
from .shared import discard, stored

#: The multiplier of the rolling hash over the last three line hashes, and the chunk boundary's modulus.
ROLL, MODULUS = 31, 4
#: Words from which a line is a chunk of its own, and from which a run of repeated chunks of one line each is a passage.
LINE_WORDS, PASSAGE_WORDS = 10, 40
#: White space: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


def is_long(line: Column, line_words: int) -> Column:
    """A line of at least line_words words, as its length and its spaces tell."""
    enough = F.length(line) >= 2 * line_words - 1
    return enough & (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= line_words - 1)


def chunk_ends(lines: Column, modulus: int, line_words: int) -> Column:
    """1-based last lines of the chunks: where the rolling hash of a line and the two before it is 0 by the modulus, at and before
    long lines, and at the end.

    The place of a boundary depends on a few lines only, so text that moves keeps its chunks, but for the first and last ones;
    a long line is a chunk wherever it stands.
    """
    number = lambda line: F.struct(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long").alias("h"), is_long(line, line_words).alias("long"))

    def ends(h: Column) -> Column:
        before = lambda i, k: F.coalesce(F.get(h, i - 1 - k)["h"], F.lit(0))
        rolled = lambda i: (before(i, 0) + ROLL * before(i, 1) + ROLL * ROLL * before(i, 2)) % modulus
        long = lambda i: F.coalesce(F.get(h, i - 1)["long"], F.lit(False))
        return F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (rolled(i) == 0) | long(i) | long(i + 1) | (i == F.size(h)))

    return let(F.transform(lines, number), ends)


def chunked(docs: DataFrame, *, modulus: int, line_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (a hash of the text), lines, chunks (array of struct k, first, n: place, 1-based first line, number of lines)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.split(text, "\n").alias("lines"))
    rows = rows.withColumn("ends", chunk_ends(F.col("lines"), modulus, line_words))
    first = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0)) + 1
    return rows.select("doc_id", "t", "lines", F.transform("ends", lambda e, k: F.struct(k.alias("k"), first(k).alias("first"), (e - first(k) + 1).alias("n"))).alias("chunks"))


def chunk_text(lines: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, first, n), "\n")


def repeats(docs: DataFrame, *, modulus: int = MODULUS, line_words: int = LINE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t, k, n, words of the chunks whose bytes occurred before, by document id and place; a row for each repeated row of docs.

    Hashes find the chunks that occur twice; only their texts are shuffled, and a chunk counts as repeated only if all texts
    under its hash are the same bytes. Counts, firsts and byte comparisons are combined in tasks before the shuffle, so a chunk
    that a third of all documents has costs a row a task. Texts are hashed once: places, repeated hashes and equal ones are tables
    in the shared folder, so that each join has plain sides, of which Spark broadcasts a small one and splits a hot key of the other.
    """
    rows = chunked(docs, modulus=modulus, line_words=line_words, id_col=id_col, text_col=text_col)
    words = lambda x: F.length(x) - F.length(F.translate(x, " \n", "")) + 1
    about = lambda c, x: F.struct(c["k"].alias("k"), c["first"].alias("first"), c["n"].alias("n"), words(x).alias("words"), F.xxhash64(x).alias("h"), F.length(x).alias("size"), (F.btrim(x, F.lit(SPACES)) != "").alias("any"))
    hashed = F.transform("chunks", lambda c: let(chunk_text(F.col("lines"), c["first"], c["n"]), lambda x: about(c, x)))
    places = rows.select("doc_id", "t", F.explode(F.filter(hashed, lambda c: c["any"])).alias("c")).select("doc_id", "t", "c.k", "c.first", "c.n", "c.words", "c.h", "c.size")
    places = stored(places, "places")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "k")
    twice = places.groupBy("h", "size").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("kept")).where("times > 1")
    twice = stored(twice.select("h", "size", "kept"), "twice")
    found = stored(places.join(twice, ["h", "size"]), "found")
    discard(places, twice)
    wanted = found.groupBy("doc_id", "t").agg(F.collect_list(F.struct("first", "n", "h", "size")).alias("wanted"))
    same_doc = (F.col("r.doc_id").eqNullSafe(F.col("w.doc_id"))) & (F.col("r.t") == F.col("w.t"))
    texts = rows.alias("r").join(wanted.alias("w"), same_doc).select("r.lines", F.explode("w.wanted").alias("c"))
    texts = texts.select("c.h", "c.size", chunk_text(F.col("lines"), F.col("c.first"), F.col("c.n")).alias("x"))
    equal = texts.groupBy("h", "size").agg(F.min("x").alias("least"), F.max("x").alias("most")).where("least = most").select("h", "size")
    equal = stored(equal, "equal")
    return found.join(equal, ["h", "size"]).where(~place.eqNullSafe(F.col("kept"))).select("doc_id", "t", "k", "n", "words")


def passages(again: DataFrame, passage_words: int) -> DataFrame:
    """doc_id, t, gone (array of k): the repeated chunks in runs of neighbours that hold a chunk of several lines, or passage_words words.

    A document's chunks meet in one task, by one shuffle.
    """
    of_doc = Window.partitionBy("doc_id", "t").orderBy("k")
    runs = again.repartition("doc_id", "t").distinct().withColumn("run", F.col("k") - F.row_number().over(of_doc))
    runs = runs.groupBy("doc_id", "t", "run").agg(F.max("n").alias("most"), F.sum("words").alias("words"), F.collect_list("k").alias("ks"))
    runs = runs.where((F.col("most") > 1) | (F.col("words") >= passage_words))
    return runs.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("ks")).alias("gone"))


def line_dedup(
    docs: DataFrame, *, modulus: int = MODULUS, line_words: int = LINE_WORDS, passage_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with the text that is left in text_col, and n_lines, n_chunks, removed_chunks, removed_lines.

    The first occurrence of a chunk stays, by ascending id (null ids last), then text hash, then place. Later ones go where
    neighbours that are all repeated hold a chunk of several lines, or passage_words words (counted by spaces and newlines): a
    repeated passage goes whole however its lines are cut, while a single repeated line of fewer words stays, and so do chunks
    of white space. Null and empty texts stay as the empty text, with one line. Rows that
    share id and text count as one document and get the same result. Columns of docs with a result's name are replaced, all
    others stay whatever their name; an empty table gives no rows.
    """
    results = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    names = [c for c in docs.columns if c not in results]
    own = [f"own{k}" for k in range(len(names))]
    gone = repeats(docs, modulus=modulus, line_words=line_words, id_col=id_col, text_col=text_col)
    gone = passages(gone, passage_words).select(F.col("doc_id").alias("_of"), F.col("t").alias("_tt"), F.col("gone").alias("_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], F.xxhash64(text).alias("_t"), F.col(id_col).cast("long").alias("_id"))
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_t") == F.col("_tt")), "left")
    text = F.coalesce(F.col(own[names.index(text_col)]), F.lit(""))
    joined = joined.withColumn("_lines", F.split(text, "\n")).withColumn("_ends", chunk_ends(F.col("_lines"), modulus, line_words))
    end = lambda k: F.coalesce(F.get("_ends", k), F.lit(0))
    piece = lambda k: F.slice(F.col("_lines"), end(k - 1) + 1, end(k) - end(k - 1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ends") - 1), F.col("_gone"))
    left = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.flatten(F.transform(stay, piece)))
    joined = joined.withColumn("_left", left)
    return joined.select(
        *[F.array_join("_left", "\n").alias(c) if c == text_col else F.col(o).alias(c) for c, o in zip(names, own, strict=True)],
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_ends").cast("long").alias("n_chunks"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("removed_chunks"),
        (F.size("_lines") - F.size("_left")).cast("long").alias("removed_lines"),
    )
