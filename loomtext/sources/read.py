"""Readers by file suffix, previews, and a check that a file can be read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, sep: str = ",", *, multi_line: bool = True) -> DataFrame:
    """All values are text; quotes are doubled inside quotes. Fields may span lines, so a file is one task; where none does, say
    multi_line=False, and large files are split."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', sep=sep)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Objects, one a line; blank lines and lines that aren't objects are left out. A schema keeps names, order and types; without one
    it is inferred from all lines, and objects that don't fit it are left out, too."""
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^\{.*\}$"))
    if schema is not None:
        return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")
    found = spark.read.json(path, mode="DROPMALFORMED", columnNameOfCorruptRecord="_broken_line").schema
    marked = T.StructType([*[f for f in found if f.name != "_broken_line"], T.StructField("_broken_line", T.StringType())])
    parsed = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken_line"}).alias("r"))
    return parsed.where(F.col("r._broken_line").isNull() & F.col("r").isNotNull()).select("r.*").drop("_broken_line")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def first_sheet(book: ZipFile) -> str:
    """The part that holds the first sheet in the workbook's own order; without that, the one with the smallest number."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet"), None)
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if sheet is not None and link.get("Id") == sheet.get(LINK):
                target = (link.get("Target") or "").lstrip("/")
                return target if target.startswith("xl/") else f"xl/{target}"
    return min((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))


def column_of(place: str, otherwise: int) -> int:
    """The column, from 0, of a cell's place such as AB12."""
    at = 0
    for x in place:
        if x.isalpha():
            at = at * 26 + ord(x) - 64
    return at - 1 if at else otherwise


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Cells of a workbook's first sheet as text, row by row: its zip parts are read with the standard library, the sheet as a stream."""
    with ZipFile(BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        with book.open(first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{SHEET}row":
                    continue
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iter(f"{SHEET}c")):
                    v = c.find(f"{SHEET}v")
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells[column_of(c.get("r", ""), k)] = shared[int(text)] if c.get("t") == "s" and text else text
                yield [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
                row.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet: its first row names the columns, columns without a name and rows without a value are left out; all text.

    A workbook is one file of bounded size (a sheet has at most 2^20 rows), so it is read by one task for each file, as a stream of
    rows. Only the first row of one workbook comes to the driver, for the names.
    """

    def run(batches: Iterator[pa.RecordBatch], head: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = sheet_rows(content)
                some = list(islice(rows, 1))
                if not head:
                    while some := list(islice(rows, 5_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string()))], names=["cells"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string()))], names=["cells"])

    content = spark.read.format("binaryFile").load(path).select("content")
    first = content.limit(1).mapInArrow(lambda batches: run(batches, True), "cells array<string>").first()
    names = [(k, h.strip()) for k, h in enumerate(first["cells"] if first else []) if h.strip()]
    cells = content.mapInArrow(lambda batches: run(batches, False), "cells array<string>")
    rows = cells.select(*[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in names])
    return rows.where(reduce(lambda x, y: x | y, [F.col(f"`{n}`") != "" for _, n in names], F.lit(False)))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": read_csv,
    "tsv": lambda s, p: read_csv(s, p, "\t"),
    "jsonl": read_jsonl,
    "ndjson": read_jsonl,
    "parquet": lambda s, p: s.read.parquet(p),
    "txt": read_text,
    "xlsx": read_xlsx,
    "xlsm": read_xlsx,
}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A source's rows by its suffix; ValueError for other suffixes."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported source format: .{suffix}")
    return READERS[suffix](spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def source_status(spark: SparkSession, path: str) -> str:
    """missing, unsupported, error or ready."""
    if path.rstrip("/").rpartition(".")[2].lower() not in READERS:
        return "unsupported"
    if not exists(spark, path):
        return "missing"
    try:
        read_rows(spark, path).limit(1).collect()
    except Exception:  # whatever a reader meets in a broken file
        return "error"
    return "ready"


def preview(spark: SparkSession, path: str, rows: int = 20, *, infer: bool = True) -> dict[str, object]:
    """status, and if ready: columns (name, type), row_count, sample."""
    status = source_status(spark, path)
    if status != "ready":
        return {"status": status, "columns": [], "row_count": 0, "sample": []}
    suffix = path.rpartition(".")[2].lower()
    df = spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == "tsv" else ",") if infer and suffix in ("csv", "tsv") else read_rows(spark, path)
    sample: list[Row] = df.limit(rows).collect()
    return {"status": status, "columns": [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "row_count": df.count(), "sample": [r.asDict() for r in sample]}


def sound_file(spark: SparkSession, path: str) -> bool:
    """Whether an artifact is there, isn't empty and its first row can be read."""
    try:
        return exists(spark, path) and bool(read_rows(spark, path).limit(1).collect())
    except Exception:  # as above
        return False
