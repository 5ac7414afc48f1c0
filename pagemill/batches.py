"""Arrow batches in parts of a bounded size, so that what Python makes of one does not grow with the rows that Spark puts in a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a part, by the mean size of its batch's rows.
PART = 2 << 20


def parts(batches: Iterable[pa.RecordBatch], most: int = PART) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), step):
            yield batch.slice(at, step)
