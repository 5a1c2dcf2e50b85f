"""Best-fit decreasing packing of documents into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import encoder, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest one in logarithmic time."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << (size + 1).bit_length()
        self.tree = [0] * (2 * self.leaves)  # open windows with a capacity in the node's range
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by capacity: (sequence, used)
        self.opened = 0

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of an open window that holds `need`, or -1."""
        node = self.leaves + need
        if self.tree[node]:
            return need
        while node > 1:  # up until a right sibling has windows, then down its left side
            if not node & 1 and self.tree[node + 1]:
                node += 1
                break
            node >>= 1
        if node <= 1:
            return -1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece: in the tightest open window, else in a new one."""
        capacity = self.tightest(length)
        if capacity < 0:
            sequence, used = self.opened, 0
            self.opened += 1
        else:
            sequence, used = self.at[capacity].pop()
            self._add(capacity, -1)
        left = self.size - used - length
        if left:
            self.at[left].append((sequence, used + length))
            self._add(left, 1)
        return sequence, used


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, *, window: int = 2048, block_tokens: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """The pieces of all documents in windows of `window` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each text is encoded and end_id appended. A document longer than a window is cut into full windows first; the rest and
    the shorter documents are placed in decreasing length, in blocks of about block_tokens ids, each in the tightest open
    window. Open windows stay open over the blocks of a task, so few end short. sequence_id is the task's number times 2^32
    plus a count: the same in a task's second run. with_ids adds the piece's ids (array of int).

    A null text is empty: one piece with end_id alone. Null ids and repeated rows give pieces of their own; ties in length are
    placed in input order. Other columns are ignored; an empty table gives no rows. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(tokenizer)
        windows, first = OpenWindows(window), TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []  # of 32 bits, of some texts each with end_id
        docs_of: list[np.ndarray] = []  # (document, first id, ids) of these texts, counted over the block
        tokens = 0

        def block() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([np.zeros(0, "<u4"), *ids])
            doc, begin, size = np.concatenate([np.zeros((3, 0), "i8"), *docs_of], axis=1)
            pieces = -(-size // window)  # of each document
            of = np.repeat(np.arange(len(doc)), pieces)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, size[of] - start)
            order = np.argsort(-length, kind="stable")
            of, start, length = of[order], start[order], length[order]
            placed = [windows.place(n) for n in length.tolist()]
            raw, at = memoryview(flat.view("u1")), begin[of] + start
            for k in range(0, len(of), 8192):
                i = slice(k, k + 8192)
                sequence, offset = np.array(placed[i], "i8").reshape(-1, 2).T
                bounds = list(zip((4 * at[i]).tolist(), (4 * (at[i] + length[i])).tolist(), strict=True))
                columns = [
                    pa.array(names_of(doc[of[i]]), pa.int64()),
                    pa.array(start[i]),
                    pa.array(length[i]),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64()),
                    pa.array(size[of[i]]),
                    pa.array(first + sequence),
                    pa.array(offset),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array([flat[a // 4 : b // 4].astype("i4") for a, b in bounds], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        held: list = []  # the ids of the block's documents, which may be null
        names_of = lambda places: [held[k] for k in places.tolist()]
        for part in slices(batches, "text"):
            found, places = enc.encode(part.column(1))
            ids.append(np.insert(found, places[1:], end_id).astype("<u4"))
            sizes = np.diff(places) + 1
            docs_of.append(np.stack([len(held) + np.arange(len(sizes)), tokens + np.cumsum(sizes) - sizes, sizes]))
            held += part.column(0).to_pylist()
            tokens += len(ids[-1])
            if tokens >= block_tokens:
                yield from block()
                ids, docs_of, held, tokens = [], [], [], 0
        yield from block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
