"""All pairs of rows that share a key, in tasks of bounded memory: one side is held, the other streams past it in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns by which rows are dealt out, all long. Rows of side 0 come first and are held, those of side 1 stream.
KEY = ["_k0", "_k1", "_k2"]
#: Elements of a matrix of pairs at a time.
ELEMENTS = 1 << 20


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): the vectors of the most common length that have no null element as doubles, and which ones they are."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    first = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    values = column.flatten()
    width = int(lengths[0]) if len(lengths) and (lengths == lengths[0]).all() else int(np.bincount(np.maximum(lengths, 0)).argmax()) if len(lengths) else 0
    whole = lengths == width
    if values.null_count:
        gaps = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()).astype(np.int64))])
        whole &= gaps[first[1:]] == gaps[first[:-1]]
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat if whole.all() else flat[np.repeat(whole, np.maximum(lengths, 0))]
    return rows.reshape(-1, width) if width else np.empty((int(whole.sum()), 0)), np.flatnonzero(whole)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(key, side, rows), batches parted where the key or the side changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*KEY, "_side"]], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(marks[a, :3].tolist()), int(marks[a, 3]), batch.slice(a, b - a)


def met(held: DataFrame, streamed: DataFrame, partitions: int, start: Callable, schema: str) -> DataFrame:
    """What tasks make of held and streamed rows of equal KEY; both have the same further columns.

    start(table of the held rows) gives (step, end): step(batch) yields result batches for some streamed rows, end() for the key."""
    rows = held.withColumn("_side", F.lit(0).cast("long")).unionByName(streamed.withColumn("_side", F.lit(1).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, live = None, [], None
        for here, side, batch in _runs(batches):
            if here != key:
                if live:
                    yield from live[1]()
                key, kept, live = here, [], None
            if side == 0:
                kept.append(batch)
            elif kept:
                live = live or start(pa.Table.from_batches(kept).combine_chunks())
                yield from live[0](batch)
        if live:
            yield from live[1]()

    return rows.repartition(partitions, *KEY).sortWithinPartitions(*KEY, "_side").mapInArrow(run, schema)
