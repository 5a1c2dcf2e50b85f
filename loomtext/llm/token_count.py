"""Token counts of a piece model, from counts of distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memory, slices

#: The mark that piece models put for a space; a text may hold it itself, with the same meaning.
MARK = "▁"


class PieceCounter:
    """Pieces of each distinct pre-token, counted once by the sentencepiece library.

    A pre-token is a run of spaces with the non-spaces after it. No piece of the model has a space mark behind another
    character (checked at load), so a text's pieces are those of its pre-tokens. The library puts one space before a text,
    so a pre-token is given to it without its first space.
    """

    pretokens = re.compile(r" +[^ ]*").findall

    def __init__(self, path: str, limit: int = 500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.model.encode("a  b ") != self.model.encode("a" + MARK * 2 + "b" + MARK):
            raise ValueError("pieces of this model cross spaces, or it rewrites spaces: count whole texts instead")
        self.counts = Memory(limit)

    def count(self, texts: list[str]) -> list[int]:
        bags = [Counter(self.pretokens(" " + t.replace(MARK, " "))) if t else Counter() for t in texts]
        missing = self.counts.lacking(set().union(*bags))
        for at in range(0, len(missing), 5000):
            some = missing[at : at + 5000]
            for p, ids in zip(some, self.model.encode([p[1:] for p in some], num_threads=1), strict=True):
                self.counts[p] = len(ids) if len(p) > 1 else 1  # a lone space is one piece, but nothing to the library
        return [sum(n * self.counts[p] for p, n in bag.items()) for bag in bags]


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, without ids being kept.

    A null text is empty: 0 bytes, 0 tokens. Null ids, repeated rows and ties stay as rows of their own. Other columns are
    ignored. Narrow: no shuffle; a worker keeps the counts of a bounded number of pre-tokens between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model)
        for part in slices(batches, "text"):
            n = pa.array(counter.count(part.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
