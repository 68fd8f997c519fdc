"""Arrow batches in parts, so that a worker never holds the results of a whole batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows in a part.
PART_ROWS = 256


def parts(batches: Iterable[pa.Array], rows: int = PART_ROWS) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, max(len(batch), 1), rows):
            yield batch.slice(at, rows)
