"""Arrow batches in Python workers, cut so that the texts at hand stay bounded."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of at most so many bytes are worked on at once (a longer one alone).
SLICE_BYTES = 8 << 20
#: Free memory is given back after so many bytes, and in the end.
TIDY_BYTES = 16 << 20


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with nulls as empty texts."""
    column = batch.column(name)
    return column.fill_null("") if column.null_count else column


def tidied() -> None:
    """Gives memory that is free back to the system. Spark keeps idle Python workers for the next stage, and what their
    allocators hold would count beside that stage's own memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def sliced(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of up to ``limit`` bytes of the named column, one row at least."""
    seen = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = batch.column(name)
        lengths = np.asarray(pc.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        seen += int(ends[-1])
        del batch, sizes
        if seen > TIDY_BYTES:
            tidied()
            seen = 0
    tidied()
