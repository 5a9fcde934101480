"""Arrow batches in slices of bounded size, for Python that holds a batch's texts as objects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as Python objects at a time; a larger text is a slice of its own.
HELD = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], text: int | str, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most so many bytes of one column's text, and one row at least. An empty batch gives none."""
    for b in batches:
        column = b.column(text)
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sums, lo = np.cumsum(size), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + held, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
