"""Sequential kernels over ordered rows that never hold a series in memory.

Rows are dealt by their keys and sorted in each task; a kernel sees a key's rows
batch by batch, keeps what it needs of the past as its own state, and starts
anew with the next key. What it costs in memory is a batch, however long a
series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Kernel(Protocol):
    """State over the rows of one key."""

    def feed(self, rows: pa.RecordBatch) -> list | pa.RecordBatch:
        """What the next rows give: arrays beside them, or rows of its own."""


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of equal keys, which are the first columns."""
    n = batch.num_rows
    change = np.zeros(n, bool)
    if n:
        change[0] = True
    for i in range(keys):
        column = batch.column(i).dictionary_encode()
        codes = column.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change).tolist()
    for lo, hi in zip(starts, [*starts[1:], n]):
        yield tuple(batch.column(i)[lo].as_py() for i in range(keys)), batch.slice(lo, hi - lo)


def _feed(batches: Iterator[pa.RecordBatch], keys: int, make: Callable[[tuple], Kernel]) -> Iterator[tuple[tuple, pa.RecordBatch, object]]:
    current, kernel = None, None
    for batch in batches:
        for key, rows in _runs(batch, keys):
            if kernel is None or key != current:
                current, kernel = key, make(key)
            yield key, rows, kernel.feed(rows)


def beside(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple], Kernel], added: str) -> DataFrame:
    """`rows` with the columns `added`, which a kernel for each key computes in order."""
    first = [*keys, *[c for c in rows.columns if c not in keys]]
    ordered = rows.select(*first).repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [x.split()[0].strip("`") for x in added.split(", ")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, found in _feed(batches, len(keys), make):
            yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *names])

    return ordered.mapInArrow(run, f"{fields}, {added}")


def rows_of(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple], Kernel], schema: str) -> DataFrame:
    """The rows that a kernel for each key gives; `schema` has the keys first, which are put before them."""
    first = [*keys, *[c for c in rows.columns if c not in keys]]
    ordered = rows.select(*first).repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, found in _feed(batches, len(keys), make):
            n = len(found[0]) if found else 0
            if n:
                head = [pa.array([value] * n, part.schema.field(i).type) for i, value in enumerate(key)]
                yield pa.RecordBatch.from_arrays([*head, *found], names)

    return ordered.mapInArrow(run, schema)
