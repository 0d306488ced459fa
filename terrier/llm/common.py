"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words in the contracts: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Rows of keys (each of at most some 64 bytes) up to which a table of them is broadcast.
BROADCAST_KEYS = 1 << 19


def few_keys(keys: DataFrame) -> DataFrame:
    """A staged table of keys, with a broadcast hint where it is counted to be small; else it is shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def held_out(modulus: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == 2,
                      F.lit(False))


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case.

    ``bytes`` splits at the six white-space bytes of ``WORD`` and lower-cases ASCII only.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


#: Characters of a run of ``slices``.
SLICE_CHARS = 1_000_000


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of about ``SLICE_CHARS`` characters of its last column, null as empty."""
    run, held, start = [], 0, 0
    for i, value in enumerate(batch.column(batch.num_columns - 1)):
        run.append(value.as_py() or "")
        held += len(run[-1])
        if held >= SLICE_CHARS or i == batch.num_rows - 1:
            yield batch.slice(start, len(run)), run
            run, held, start = [], 0, i + 1
