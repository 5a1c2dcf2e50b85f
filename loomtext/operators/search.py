"""Documents that share tokens with a query: an inverted index, overlap and cosine, and what terms gain."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TokenIndex:
    """postings: token, doc_id, n (times in the document), norm (of the document's counts). Write it partitioned by a hash of the token
    to search many times; a search reads the postings of its tokens only."""

    postings: DataFrame

    @staticmethod
    def of(docs: DataFrame, tokens: Column, *, id_col: str = "doc_id") -> TokenIndex:
        """From an array of tokens a row. Null arrays and null tokens count as none; rows that share an id are one document."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens).alias("token")).where("token is not null")
        counts = rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))  # tasks count a row's tokens before the shuffle
        square = F.sum(F.col("n").cast("double") * F.col("n"))
        whole = counts.groupBy("doc_id").agg(F.sqrt(square).alias("norm"), F.collect_list(F.struct("token", "n")).alias("c"))
        return TokenIndex(whole.select("doc_id", "norm", F.explode("c").alias("e")).select("e.token", "doc_id", "e.n", "norm"))

    def search(self, query: Sequence[str], *, k: int = 10) -> DataFrame:
        """rank, doc_id, overlap (the document's tokens that the query has, each as often as it occurs there), cosine.

        The k documents with the greatest overlap, ties to the smaller id. Documents without a token of the query aren't listed.
        """
        return _ranked(self._scores(query), k, "overlap")

    def similar(self, query: Sequence[str], *, k: int = 10) -> DataFrame:
        """The same by the cosine of the token counts of the query and of the document."""
        return _ranked(self._scores(query), k, "cosine")

    def _scores(self, query: Sequence[str]) -> DataFrame:
        asked = Counter(query)
        norm = math.sqrt(sum(n * n for n in asked.values()))
        hits = self.postings.where(F.col("token").isin(list(asked))) if asked else self.postings.where(F.lit(False))
        times = F.lit(0).cast("long")
        for n in sorted(set(asked.values())):
            times = F.when(F.col("token").isin([t for t, m in asked.items() if m == n]), F.lit(n).cast("long")).otherwise(times)
        sums = hits.groupBy("doc_id").agg(F.sum("n").alias("overlap"), F.sum(F.col("n") * times).alias("dot"), F.max("norm").alias("norm"))
        return sums.select("doc_id", "overlap", (F.col("dot") / (F.col("norm") * F.lit(norm or 1.0))).alias("cosine"))


def _ranked(scores: DataFrame, k: int, by: str) -> DataFrame:
    top = scores.orderBy(F.desc(by), "doc_id").limit(k)  # each task keeps k rows
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col(by)).alias("o"), "doc_id", "overlap", "cosine"))).alias("l"))
    return listed.select(F.posexplode("l").alias("at", "e")).select((F.col("at") + 1).alias("rank"), "e.doc_id", "e.overlap", "e.cosine")


def term_deltas(current: DataFrame, previous: DataFrame, *, top: int = 20) -> DataFrame:
    """term, current_count, previous_count, delta of two tables of terms (a row an occurrence), the greatest changes first."""
    count = lambda df, name: df.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias(name))
    both = count(current, "current_count").join(count(previous, "previous_count"), "term", "full").na.fill(0, ["current_count", "previous_count"])
    delta = both.withColumn("delta", F.col("current_count") - F.col("previous_count"))
    return delta.orderBy(F.desc(F.abs("delta")), F.desc("current_count"), "term").limit(top)


def token_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """token, n (occurrences), docs (rows that have it), in one aggregate by the token: sorted tokens show which is a row's first."""
    listed = docs.select(F.array_sort(tokens).alias("t"))
    marked = F.transform("t", lambda t, i: F.struct(t.alias("token"), (~F.coalesce(F.get("t", i - 1) == t, F.lit(False))).cast("int").alias("first")))
    rows = listed.select(F.explode(marked).alias("e")).select("e.token", "e.first")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("docs"))


def taxonomy_matches(text: Column, tokens: Column, taxonomy: Mapping[str, Sequence[str]], *, most: int = 3) -> Column:
    """Array of at most `most` names of taxonomy that fit a text, the best first, ties by name.

    A pattern of several words scores one if the text has it; a single word scores one for each token that it holds or is held by.
    Case doesn't count.
    """
    low, words = F.lower(text), F.transform(tokens, lambda t: F.lower(t))

    def fits(pattern: str) -> Column:
        if " " in pattern:
            return low.contains(pattern).cast("int")
        return F.size(F.filter(words, lambda t: t.contains(pattern) | F.contains(F.lit(pattern), t)))

    def score(patterns: Sequence[str]) -> Column:
        return sum((fits(p) for p in (p.strip().lower() for p in patterns) if p), F.lit(0))

    scored = F.array(*[F.struct((-score(patterns)).alias("o"), F.lit(name).alias("name")) for name, patterns in taxonomy.items()])
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda e: e["o"] < 0)), 1, most), lambda e: e["name"])
