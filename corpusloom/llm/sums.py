"""Sums over all rows of arrays of fixed size: each task adds up its rows, then blocks are merged in two steps.

Neither the number of tasks nor one block meets in a single task as whole arrays: a merge streams over its rows
and holds one array of a block's size for each block that it is dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 64
SALTS = 8


def summed(df: DataFrame, size: int, make: Callable[[], Callable[[pa.RecordBatch, np.ndarray], None]], blocks: int = BLOCKS) -> np.ndarray:
    """The int64 array of ``size`` (a multiple of ``blocks``) to which ``make()(batch, array)`` adds each batch of ``df``.

    Integer sums, so the same for any partitioning. The result, and the broadcast it may become, is ``8 * size`` bytes.
    """
    width = size // blocks
    assert width * blocks == size

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        add, total, some = make(), np.zeros(size, np.int64), False
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                add(batch.slice(at, 512), total)
                some = True
        if some:
            salt = TaskContext.get().partitionId() % SALTS
            for b in range(blocks):
                part = total[b * width : (b + 1) * width]
                if part.any():
                    kind = "<i4" if np.abs(part).max() < 2**31 else "<i8"
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([salt], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["block", "salt", "raw"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, s, raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(raw, "<i4" if len(raw) == 4 * width else "<i8")
                if (b, s) in held:
                    held[b, s] += part
                else:
                    held[b, s] = part.astype(np.int64)
        for (b, s), part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([s], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["block", "salt", "raw"])

    schema = "block int, salt int, raw binary"
    by_salt = df.mapInArrow(partial, schema).repartition("block", "salt").mapInArrow(merge, schema)
    whole = by_salt.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(merge, schema)
    out = np.zeros(size, np.int64)
    for row in whole.collect():  # a row a block
        out[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["raw"], "<i8")
    return out
