"""Bounded steps over Arrow batches of texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def steps(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most_bytes`` of text, at least a row each.

    Rows are copied: some string kernels go wrong on a slice whose buffers begin further back.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths.astype(np.int64)) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.take(pa.array(np.arange(a, b)))
