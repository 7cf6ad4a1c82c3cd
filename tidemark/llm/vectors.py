"""What the embedding operators share: whole-number vectors in Arrow batches, and partial results of tasks merged in rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial results that one task merges in a round.
FAN_IN = 32


def finite(vector: str | Column) -> Column:
    """Whether an array is there and holds neither nulls nor NaN nor infinities."""
    column = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(vector: str | Column, scale: int, plus: int = 0) -> Column:
    """Each entry x, as double, as the long floor(scale * x) + plus; null where that is no long."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(column, lambda x: F.try_add(F.floor(x.cast("double") * scale).try_cast("long"), F.lit(plus).cast("long")))


def matrix(column: pa.Array, dims: int, kind: type = np.int64) -> np.ndarray:
    """(rows, dims) of a list column without nulls whose lists all have ``dims`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(kind, copy=False)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), kind))


def folded(df: DataFrame, make: Callable[[pa.RecordBatch], bytes | None], merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """One state for all rows: each task makes one of its batches, then tasks merge some ``FAN_IN`` states each, round by round.

    A state's size must not grow with the rows; the driver merges the last ``FAN_IN`` at most. Without rows: None.
    """

    def reduced(states: Iterator[bytes | None]) -> Iterator[pa.RecordBatch]:
        held = None
        for state in states:
            if state is not None:
                held = state if held is None else merge(held, state)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"state": pa.array([held], pa.binary())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced(make(b) for b in batches if b.num_rows)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced(x for b in batches for x in b.column(0).to_pylist())

    left = df.rdd.getNumPartitions()
    states = df.mapInArrow(first, "state binary")
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        states = states.repartition(left).mapInArrow(further, "state binary")
    out = None
    for row in states.collect():
        out = bytes(row["state"]) if out is None else merge(out, bytes(row["state"]))
    return out
