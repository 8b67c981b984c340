"""Helpers for Python tasks: word splitting on bytes, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task works on at once; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where their text passes ``most`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start, held = np.cumsum(sizes), 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, held + most, side="right")))
            yield batch.slice(start, stop - start)
            start, held = stop, int(ends[stop - 1])


def byte_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, with A-Z in lower case: ``bytes`` methods do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
