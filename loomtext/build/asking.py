"""Rows put to an injected function in batches, inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Ask = Callable[[list[dict[str, Any]]], Iterable[Mapping[str, Any]]]

#: Rows that wait for a batch to fill, at most: those that need no answer wait along with them.
MOST_WAITING = 20_000


#: What a row is told: its answer's values by field, or None; and the failure, or None.
Told = tuple[tuple | None, str | None]
NOTHING: Told = (None, None)


def replies(function: Ask, items: list[dict[str, Any]], names: list[str]) -> list[Told]:
    """What each item is told, matched by its key. The first answer to a key counts."""
    try:
        found: dict[Any, Mapping[str, Any]] = {}
        for one in function(items):
            if isinstance(one, dict) or isinstance(one, Mapping):
                found.setdefault(one.get("key"), one)
    except Exception as e:  # a remote call may fail in any way; its rows say so
        return [(None, f"failed: {type(e).__name__}")] * len(items)
    answers = [found.get(k) for k in range(len(items))]  # keys are places
    return [(None, "missing") if one is None else (tuple([one.get(n) for n in names]), None) for one in answers]


def structs(told: list[Told], kind: pa.StructType) -> list[pa.Array]:
    """Columns of the answers, made field by field, and of the failures. Answers that don't fit are 'unreadable': all are tried at
    once, and in halves where that fails."""
    blank = (None,) * len(kind)
    fields = zip(*[blank if t[0] is None else t[0] for t in told], strict=True)
    try:
        made = [pa.array(v, f.type) for v, f in zip(fields, kind, strict=True)]
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, OverflowError):
        half = len(told) // 2
        if not half:
            return structs([(None, "unreadable")], kind)
        return [pa.concat_arrays(two) for two in zip(structs(told[:half], kind), structs(told[half:], kind), strict=True)]
    none = pa.array([t[0] is None for t in told], pa.bool_())
    return [pa.StructArray.from_arrays(made, fields=list(kind), mask=none), pa.array([t[1] for t in told], pa.string())]


def ask(
    rows: DataFrame, function: Ask, answer: str, *, give: Sequence[str], size_of: str, most_items: int = 40, most_chars: int = 12_000, each_chars: int = 0, wanted: str | None = None, name: str = "answer", drop: Sequence[str] = ()
) -> DataFrame:
    """rows with <name>, a struct with the fields `answer` (DDL), null without an answer, and <name>_failure, null if there is one.

    The function is called in the tasks, with as many items as both limits allow and at least one: most_items, and most_chars for the
    sum of each_chars plus the length of the text `size_of`. Batches run on across the documents of a task. An item has a key and the columns `give`; an answer
    has the key of its item. failure is 'missing' where an item's answer lacks, 'unreadable' where its fields don't fit, and
    'failed: <error>' for all items of a call that failed. With `wanted`, a boolean column, only rows where it is true are asked;
    the others have neither answer nor failure. Null texts have length 0. Rows keep their order within a task. Columns in `drop` go.

    A lost executor's rows are asked again, so write the result (see sources.publish) before anything reads it twice.
    """
    return ask_each(rows, {name: function}, answer, give=give, size_of=size_of, most_items=most_items, most_chars=most_chars, each_chars=each_chars, wanted=wanted, drop=drop)


def ask_each(
    rows: DataFrame, functions: Mapping[str, Ask], answer: str, *, give: Sequence[str], size_of: str, most_items: int = 40, most_chars: int = 12_000, each_chars: int = 0, wanted: str | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    """ask() for several functions, by the name of their answers: the same calls go to one after the other, and rows leave Spark once."""
    kind = to_arrow_type(T.StructType.fromDDL(answer))
    if {m for name in functions for m in (name, f"{name}_failure")} & set(rows.columns):
        raise ValueError(f"columns exist already: {', '.join(f'{name}, {name}_failure' for name in functions)}")
    given, at_size = list(give), rows.columns.index(size_of)
    at_given, at_wanted = [rows.columns.index(c) for c in given], rows.columns.index(wanted) if wanted else None
    stay = [k for k, c in enumerate(rows.columns) if c not in drop]
    more = [f for name in functions for f in (T.StructField(name, T.StructType.fromDDL(answer)), T.StructField(f"{name}_failure", T.StringType()))]
    out = T.StructType([*[rows.schema.fields[k] for k in stay], *more])
    names, fields, models = out.names, [f.name for f in kind], list(functions.values())
    head = ["key", *given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[list[Told]]]] = []  # batches that a call is open for, with what each function told their rows
        slots: list[tuple[list[list[Told]], int]] = []  # where the answers to the open call's items go
        items: list[dict[str, Any]] = []
        chars = waiting = 0

        def call() -> None:
            nonlocal slots, items, chars, waiting
            if items:
                for m, model in enumerate(models):
                    mine = items if m == len(models) - 1 else [dict(i) for i in items]
                    for (told, i), reply in zip(slots, replies(model, mine, fields), strict=True):
                        told[m][i] = reply
            slots, items, chars, waiting = [], [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            open_for = slots[0][0] if slots else None
            while held and held[0][1] is not open_for:
                part, told = held.pop(0)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in stay], *[c for one in told for c in structs(one, kind)]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            told = [[NOTHING] * batch.num_rows for _ in models]
            held.append((batch, told))
            asked = batch
            places: Sequence[int] = range(batch.num_rows)
            if at_wanted is not None:  # only rows that are asked become Python values
                asked = batch.filter(batch.column(at_wanted))
                places = [i for i, yes in enumerate(batch.column(at_wanted).to_pylist()) if yes]
            columns = [asked.column(k).to_pylist() for k in at_given]
            texts = columns[given.index(size_of)] if size_of in given else asked.column(at_size).to_pylist()
            start = 0
            for i, text, *values in zip(places, texts, *columns, strict=True):
                size = len(text or "") + each_chars
                if items and (len(items) >= most_items or chars + size > most_chars):
                    call()
                    start = i
                slots.append((told, i))
                items.append(dict(zip(head, (len(items), *values), strict=True)))
                chars += size
            waiting += batch.num_rows - start
            if not items or waiting > MOST_WAITING:
                call()
            yield from done()
        call()
        yield from done()

    return rows.mapInArrow(run, out)


def failure_counts(asked: DataFrame, name: str = "answer") -> DataFrame:
    """failure, n: rows by what kept them from an answer."""
    return asked.where(F.col(f"{name}_failure").isNotNull()).groupBy(F.col(f"{name}_failure").alias("failure")).agg(F.count(F.lit(1)).alias("n"))
