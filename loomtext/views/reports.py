"""Report panels and the metrics they show."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import blank_to, json_field, percent_of, to_date


def best_filled(df: DataFrame, json_col: str, keys: Sequence[str]) -> DataFrame:
    """One row: key, the first of the JSON keys with the most values that aren't blank; null if none has any."""
    found = df.agg(*[F.count(F.when(F.trim(json_field(F.col(json_col), k)) != "", 1)).alias(f"n{i}") for i, k in enumerate(keys)])
    ranked = F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(keys)])
    top = F.array_max(ranked)
    return found.select(F.when(top["n"] > 0, top["k"]).alias("key"))


def field_values(df: DataFrame, json_col: str, key: str, *, split: str | None = None) -> DataFrame:
    """value: distinct values of a JSON field that aren't blank; parted at `split` first."""
    value = json_field(F.col(json_col), key)
    parts = F.split(value, f"\\Q{split}\\E") if split else F.array(value)
    return df.select(F.explode(parts).alias("value")).select(F.trim("value").alias("value")).where("value <> ''").distinct()


def data_period(df: DataFrame, column: str) -> DataFrame:
    """One row: first_day, last_day, period (text)."""
    day = to_date(F.col(column).cast("string"))
    out = df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return out.withColumn("period", F.concat(F.col("first_day").cast("string"), F.lit(" ~ "), F.col("last_day").cast("string")))


def recent_year(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, of rows in the latest year that has rows."""
    rows = df.select(key, F.year(to_date(F.col(column).cast("string"))).alias("_y"))
    latest = rows.agg(F.max("_y").alias("_latest"))
    return rows.crossJoin(latest).where("_y = _latest").select(key)  # by a single row


def recent_year_stats(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """One row: documents and genuine documents of the latest year; a document with two labels counts twice."""
    recent = recent_year(docs, column, "doc_id")
    good = labels.where("genuineness = 'genuine_review'").join(recent, "doc_id").agg(F.count(F.lit(1)).alias("genuine_documents"))
    return recent.agg(F.count(F.lit(1)).alias("documents")).crossJoin(good)  # one row each


def channel_genuine(docs: DataFrame, labels: DataFrame, channel: str) -> DataFrame:
    """channel, n of genuine documents."""
    genuine = labels.where("genuineness = 'genuine_review'").select("doc_id")
    return docs.select("doc_id", F.col(channel).alias("channel")).join(genuine, "doc_id").groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def distribution_panel(df: DataFrame, column: str, *, order: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """label, n, percent of all rows: labels of `order` first, the others by count; the percent is of the whole also if cut at top."""
    found = df.groupBy(blank_to(F.col(column)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    shares = found.crossJoin(found.agg(F.sum("n").alias("_all"))).select("label", "n", percent_of(F.col("n"), F.col("_all")).alias("percent"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]).cast("array<string>"), F.col("label"))
    sorted_rows = shares.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), F.desc("n"), "label")
    return sorted_rows.limit(top) if top else sorted_rows


def stacked_panel(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """A row for each value of `rows`, a count column for each of `values`."""
    out = df.groupBy(blank_to(F.col(rows)).alias("label")).agg(*[F.count(F.when(F.col(columns) == v, 1)).alias(v) for v in values])
    return out


def rank_panel(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """rank, label, n: the most frequent values; ties by value."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(top)
    return found.select(F.row_number().over(Window.orderBy(F.desc("n"), "label")).alias("rank"), "label", "n")  # over `top` rows


@dataclass(frozen=True)
class Metric:
    """What a report counts: rows of `table` (where `only` holds) by the columns `by`; latest: of the latest year alone."""

    kind: str
    table: str
    by: tuple[str, ...] = ()
    only: tuple[str, str] | None = None
    latest: bool = False


# The metrics that reports may name.
METRICS: dict[str, Metric] = {
    "genuine_docs_total": Metric("stat", "documents", only=("genuineness", "genuine_review")),
    "genuine_docs_recent_year": Metric("stat", "documents", only=("genuineness", "genuine_review"), latest=True),
    "clauses_total": Metric("stat", "clauses"),
    "clauses_recent_year": Metric("stat", "clauses", latest=True),
    "sentiment_distribution": Metric("distribution", "clauses", ("sentiment",)),
    "aspect_distribution": Metric("distribution", "clauses", ("aspect",)),
    "aspect_sentiment": Metric("stacked", "clauses", ("aspect", "sentiment")),
    "channel_genuine_distribution": Metric("distribution", "documents", ("channel",), ("genuineness", "genuine_review")),
    "keywords_positive": Metric("rank", "keywords", ("keyword",), ("sentiment", "positive")),
    "keywords_negative": Metric("rank", "keywords", ("keyword",), ("sentiment", "negative")),
}


@dataclass(frozen=True)
class Panel:
    """A metric in a section: the `top` labels by `order_by` (count, or the share of a series), those in `order` first."""

    metric: str
    top: int | None = None
    order: tuple[str, ...] = ()
    order_by: str = "count"


@dataclass(frozen=True)
class Section:
    """Panels by name; left out where the table `needs` isn't there. latest: all panels count the latest year alone."""

    name: str
    needs: str
    panels: tuple[Panel, ...]
    latest: bool = False


# The sections of the basic report that show metrics, in order.
BASIC = (
    Section("doc_overview", "documents", (Panel("genuine_docs_total"), Panel("genuine_docs_recent_year"), Panel("clauses_total"), Panel("clauses_recent_year"))),
    Section("channel_distribution", "documents", (Panel("channel_genuine_distribution", top=8),), latest=True),
    Section("sentiment_distribution", "clauses", (Panel("sentiment_distribution", order=("positive", "neutral", "negative")),), latest=True),
    Section("aspect_distribution", "clauses", (Panel("aspect_distribution"),), latest=True),
    Section("aspect_sentiment", "clauses", (Panel("aspect_sentiment"), Panel("aspect_sentiment", top=6, order_by="positive"), Panel("aspect_sentiment", top=6, order_by="negative")), latest=True),
    Section("keyword_distribution", "keywords", (Panel("keywords_positive", top=10), Panel("keywords_negative", top=10)), latest=True),
)


def with_years(tables: Mapping[str, DataFrame], day: str = "day") -> dict[str, DataFrame]:
    """documents (doc_id, genuineness, channel, <day>), clauses and keywords (doc_id, ...) with `year`: that of the document's day.

    Rows without a document, or whose document has no day, have no year and count in totals only.
    """
    out = {"documents": tables["documents"].withColumn("year", F.year(day))}
    years = tables["documents"].select(F.col("doc_id").alias("_doc"), F.year(day).alias("year"))
    for name in ("clauses", "keywords"):
        if name in tables:
            out[name] = tables[name].join(years, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    return out


def count_metrics(tables: Mapping[str, DataFrame], wanted: Sequence[tuple[str, bool]]) -> DataFrame:
    """metric, latest, label, series, n for the metrics wanted (name, of the latest year alone), from tables that have `year`.

    The metrics of a table are one aggregate over grouping sets, so each table is read once however many there are. The year is part
    of every set: the latest one that any document has is known only from the counts. Null and blank labels are unknown; a rank
    leaves null out.
    """
    wanted = list(dict.fromkeys((name, latest or METRICS[name].latest) for name, latest in wanted))
    cells = [_cells(tables[t], sorted({n for n, _ in wanted if METRICS[n].table == t})) for t in sorted({METRICS[n].table for n, _ in wanted})]
    counted = reduce(DataFrame.union, cells)
    needs_year = any(latest for _, latest in wanted)
    if needs_year:
        newest = tables["documents"].agg(F.max("year").alias("_newest"))
        counted = counted.crossJoin(F.broadcast(newest))  # by a single row
    parts = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(latest).alias("latest")) for n, latest in wanted])
    here = F.filter(parts, lambda p: (p["metric"] == F.col("name")) & (~p["latest"] | ((F.col("year") == F.col("_newest")) if needs_year else F.lit(False))))
    return counted.withColumn("p", F.explode(here)).groupBy("p.metric", "p.latest", "label", "series").agg(F.sum("n").alias("n"))


def _cells(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, label, series, year, n of the metrics of one table."""
    chosen = {n: METRICS[n] for n in names}
    columns = sorted({c for m in chosen.values() for c in m.by})
    named = rows.select("year", *[(F.col(c) if c == "keyword" else blank_to(F.col(c))).alias(f"by_{c}") for c in columns], *[F.col(c).alias(f"only_{c}") for c in sorted({m.only[0] for m in chosen.values() if m.only})])
    sets = list(dict.fromkeys(tuple(sorted(m.by)) for m in chosen.values()))
    counts = [F.count(F.when(F.col(f"only_{m.only[0]}") == m.only[1], 1) if m.only else F.lit(1)).alias(n) for n, m in chosen.items()]
    keys = [f"by_{c}" for c in columns]
    grouped = named.groupingSets([["year", *[f"by_{c}" for c in s]] for s in sets], "year", *keys).agg(F.grouping_id().alias("g"), *counts)
    which = lambda by: sum(1 << (len(keys) - 1 - k) for k, c in enumerate(columns) if c not in by)
    part = lambda m, i: F.col(f"by_{m.by[i]}") if len(m.by) > i else F.lit(None).cast("string")
    each = [F.when((F.col("g") == which(m.by)) & (F.col(n) > 0) & (part(m, 0).isNotNull() | F.lit(m.kind != "rank")), F.struct(F.lit(n).alias("name"), part(m, 0).alias("label"), part(m, 1).alias("series"), F.col(n).alias("n"))) for n, m in chosen.items()]
    return grouped.select("year", F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e")).select("e.name", "e.label", "e.series", "year", "e.n")


def report_sections(tables: Mapping[str, DataFrame], sections: Sequence[Section] = BASIC) -> DataFrame:
    """section, panel (from 1), metric, rank (from 1), label, series, n, percent: a report in one DataFrame.

    tables as with_years makes them. Sections whose table isn't there are left out, and so are metrics of tables that aren't.
    percent is of the metric's whole, or of the label's for a stacked metric, to one decimal and before `top` cuts. Labels rank by
    count, or by the count of one series, ties by label. A stat that counts nothing has a row with 0.
    """
    shown = [(s, k, p) for s in sections if s.needs in tables for k, p in enumerate(s.panels, 1) if METRICS[p.metric].table in tables]
    if not shown:
        raise ValueError("no section has its table")
    latest = lambda s, p: s.latest or METRICS[p.metric].latest
    counts = count_metrics(tables, [(p.metric, latest(s, p)) for s, _, p in shown])
    plain = lambda s, k, p: {"section": s.name, "panel": k, "metric": p.metric, "latest": latest(s, p), "kind": METRICS[p.metric].kind, "top": p.top, "fixed": list(p.order), "order_by": p.order_by}
    spec = "section string, panel int, metric string, latest boolean, kind string, top int, fixed array<string>, order_by string"
    panels = counts.sparkSession.createDataFrame([plain(*x) for x in shown], spec)
    rows = panels.join(counts, ["metric", "latest"], "left").where(F.col("n").isNotNull() | (F.col("kind") == "stat")).na.fill(0, ["n"])
    panel = ["section", "panel"]
    whole = F.sum("n").over(Window.partitionBy(*panel, F.when(F.col("kind") == "stacked", F.col("label"))))
    weight = F.sum(F.when((F.col("order_by") == "count") | (F.col("series") == F.col("order_by")), F.col("n")).otherwise(0)).over(Window.partitionBy(*panel, "label"))
    at = F.array_position("fixed", F.col("label"))
    place = F.when(at > 0, at).otherwise(F.size("fixed") + 1)
    ranked = rows.withColumns({"percent": percent_of(F.col("n"), whole), "_w": weight, "_p": place})
    ranked = ranked.withColumn("rank", F.dense_rank().over(Window.partitionBy(*panel).orderBy("_p", F.desc("_w"), "label")))
    return ranked.where(F.col("top").isNull() | (F.col("rank") <= F.col("top"))).select(*panel, "metric", "rank", "label", "series", "n", "percent")


class Report:
    """Sections by name, each a function of the tables it needs. A section whose tables aren't there is left out."""

    def __init__(self) -> None:
        self.sections: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}

    def add(self, name: str, needs: Sequence[str], make: Callable[..., DataFrame]) -> Report:
        self.sections[name] = (tuple(needs), make)
        return self

    def build(self, tables: Mapping[str, DataFrame], *, scope: DataFrame | None = None) -> dict[str, DataFrame]:
        """The DataFrames of all sections; scope (doc_id) keeps the rows of its documents in every table that has doc_id."""
        seen = {n: t.join(scope, "doc_id", "left_semi") if scope is not None and "doc_id" in t.columns else t for n, t in tables.items()}
        return {name: make(*[seen[n] for n in needs]) for name, (needs, make) in self.sections.items() if all(n in seen for n in needs)}
