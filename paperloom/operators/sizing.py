"""Broadcast only what is small enough, by its own statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimizer's bound on its size is within
    limit, else df as it is (a shuffled join is planned then)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def once(df: DataFrame) -> DataFrame:
    """df, worked out once for all that reads it: for results that are small
    beside what they come from."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the strings of a column hold about max_bytes in
    each (a single longer one is a slice by itself): bounds a worker's memory."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def mapped(values: pa.Array, f: Callable[[str | None], object], kind: pa.DataType, max_bytes: int = 1 << 20) -> pa.Array:
    """f of each string, as an array of kind.  Only about max_bytes of strings,
    and what f makes of them, are Python objects at a time."""
    batch = pa.RecordBatch.from_arrays([values], ["text"])
    done = [pa.array([f(t) for t in part.column(0).to_pylist()], kind) for part in slices([batch], max_bytes=max_bytes)]
    return pa.concat_arrays(done) if done else pa.array([], kind)
