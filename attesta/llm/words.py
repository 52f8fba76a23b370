"""Word splitting and row identity shared by the text operators, as column expressions."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything but ASCII digits, ASCII letters and characters beyond ASCII.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only; other letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole(name: str) -> Column:
    """A text column with null taken for empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def raw_words(text: Column) -> Column:
    """Words in their own case: as many, and in the same places, as the lower-cased ones."""
    return F.array_remove(F.split(text, GAPS), "")


def lower_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAPS), "")


def fresh(df, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each given."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of about ``size`` bytes of a text or binary column, so that a task holds little at once."""
    for batch in batches:
        start = held = 0
        for i, value in enumerate(batch.column(column)):
            held += len(value.as_buffer()) if value.is_valid else 0
            if held >= size:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < len(batch):
            yield batch.slice(start)


def tidied(run: Callable) -> Callable:
    """A batch function that hands its free memory back at the end: Python workers serve one stage after another."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        if libc and hasattr(ctypes.CDLL(libc), "malloc_trim"):
            ctypes.CDLL(libc).malloc_trim(0)
    return tidy
