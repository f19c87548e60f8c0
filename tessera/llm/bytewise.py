"""Text columns taken by bytes: translation of single bytes, parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def byte_table(spaces: bytes, lines: bytes = b"") -> np.ndarray:
    """A table that lower-cases A-Z, turns ``spaces`` into blanks and ``lines``
    into line feeds, and leaves all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    table[np.frombuffer(spaces, np.uint8)] = 0x20
    table[np.frombuffer(lines, np.uint8)] = 0x0A
    return table


def translated(column, table: np.ndarray) -> pa.Array:
    """The texts with each byte replaced by its entry (ASCII for ASCII, so they
    stay valid); null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column) or column.buffers()[2] is None:
        return column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = table[np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)])


def byte_parts(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``text`` holds about ``size`` bytes; a
    longer text is alone."""
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column(text).cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + b.num_rows + 1]
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
