"""Counting strings of texts inside map tasks.

Each task counts in a dictionary and sends what it holds whenever that reaches a
fixed number of distinct strings or of bytes, so memory is bounded and a string
leaves a task a few times instead of once for each place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa

#: distinct strings, and bytes of strings, that a task holds before it sends them
HELD_STRINGS, HELD_BYTES = 200_000, 16 << 20


def ascii_lower(text: str) -> str:
    """A-Z in lower case; every other letter as it is."""
    return text.encode().lower().decode()


def flushed(batches: Iterator[pa.RecordBatch], add: Callable[[Counter, pa.RecordBatch, int], None], name: str) -> Iterator[pa.RecordBatch]:
    """Counts that ``add(total, batch, row)`` gathers, as batches (``name``, n)."""
    total: Counter = Counter()
    seen = 0

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=[name, "n"])
        total.clear()
        return made

    for batch in batches:
        for row in range(batch.num_rows):
            before = len(total)
            add(total, batch, row)
            # new strings of a row are no longer than its text
            seen += batch.column(batch.num_columns - 1)[row].as_buffer().size if len(total) > before and batch.column(batch.num_columns - 1)[row].is_valid else 0
            if len(total) >= HELD_STRINGS or seen >= HELD_BYTES:
                yield out()
                seen = 0
    if total:
        yield out()
