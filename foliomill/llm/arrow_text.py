"""Reading Arrow batches of texts inside tasks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8; null as the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``most_bytes`` of text each (a longer single text is a part of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


#: what empties the tables that operators keep in a Python worker between tasks, by operator
KEPT: dict[str, Callable[[], None]] = {}


def let_go(but: str = "") -> None:
    """Give back the memory that other operators' tables hold in this worker; it may have served them before."""
    for name, clear in KEPT.items():
        if name != but:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
