"""Arrow batches in small pieces, so that a task holds few texts as Python objects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS = 1000


def few_rows(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``rows`` rows, in order; what Arrow does not need goes back after each batch."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
        del b
        pa.default_memory_pool().release_unused()
