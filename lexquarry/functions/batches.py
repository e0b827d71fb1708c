"""Arrow batches in parts of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a part; a single larger row is a part of its own.
PART = 4_000_000


def bounded(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in their order, in parts of at most ``most`` bytes."""
    if batch.num_rows > 1 and batch.nbytes > (most or PART):
        half = batch.num_rows // 2
        yield from bounded(batch.slice(0, half), most)
        yield from bounded(batch.slice(half), most)
    else:
        yield batch


def steps(work: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of at most ``rows`` rows and ``most`` in the sum of their ``work``; a single row of more is a run of its own."""
    done, start = np.concatenate([[0], np.cumsum(work)]), 0
    while start < len(work):
        end = max(start + 1, min(start + max(1, rows), int(np.searchsorted(done, done[start] + most, "right")) - 1))
        yield start, end
        start = end
