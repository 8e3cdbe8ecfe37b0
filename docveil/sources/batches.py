"""Rows in and out of Arrow batches, a few at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

BATCH_ROWS, BATCH_BYTES = 20_000, 16 << 20


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows as dictionaries, one after another (cells of the others stay in Arrow)."""
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most about BATCH_ROWS rows and ``most`` bytes of text and bytes; at least one."""
    held: list[tuple] = []
    size, sent = 0, False

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= BATCH_ROWS or size >= most:
            yield batch()
            held, size, sent = [], 0, True
    if held or not sent:
        yield batch()
