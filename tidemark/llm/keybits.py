"""Bitmaps of 64-bit keys, gathered by Spark and tested where Python makes the keys' rows: those of keys that come at all, or twice or more.

A key's cell is one of 2**44: what is counted is as good as the key itself, whatever the bitmap's size. A task sends, for each of
2**``SEGMENT`` segments, its sorted cells, 4 bytes each and no cell more often than asked for; one segment's cells meet in a task, which sets two bits of
the segment's slice for each cell that came often enough. So only such keys fill the bitmap: keys that come once take no room in one of repeated keys.
A bitmap has 2**``width`` bits. It lets through every key that was put in; with many of them some others too, and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import mix64

SEGMENT, CELL, LEAST_WIDTH = 12, 32, 20
#: Keys that a task gathers before it sends their cells on.
FLUSH = 1 << 20


def cells(items: np.ndarray) -> np.ndarray:
    """The cell of each key: its segment, then 32 bits within it."""
    return mix64(items) >> np.uint64(64 - SEGMENT - CELL)


def _bits(within: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each cell in its segment's slice."""
    size = width - SEGMENT
    return within >> np.uint64(CELL - size), within & np.uint64((1 << size) - 1)


def gathered(df: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], least: int) -> DataFrame:
    """(segment, cells): the sorted cells of each partition's keys, none more than ``least`` (1 or 2) times in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = np.sort(cells(np.concatenate(held)))
            found = found[np.concatenate((np.ones(min(least, len(found)), bool), found[least:] != found[:-least]))]
            edges = np.searchsorted(found, np.arange((1 << SEGMENT) + 1, dtype=np.uint64) << np.uint64(CELL))
            at = np.flatnonzero(np.diff(edges))
            low = found.astype(np.uint32)
            columns = pa.array(at.astype(np.int32)), pa.array([low[edges[k] : edges[k + 1]].tobytes() for k in at], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns), ["segment", "cells"])

        for batch in batches:
            for items in items_of(batch) if batch.num_rows else ():
                if len(items):
                    held.append(items)
                    n += len(items)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return df.mapInArrow(run, "segment int, cells binary")


def slices(found: DataFrame, least: int, width: int) -> DataFrame:
    """(segment, bitmap): the bits of the cells that came ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def done() -> pa.RecordBatch:
            within = np.sort(np.concatenate(held))
            within = within[least - 1 :][within[least - 1 :] == within[: len(within) - least + 1]].astype(np.uint64)
            bits = np.zeros(1 << (width - SEGMENT), np.uint8)
            for at in _bits(within, width):
                bits[at] = 1
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bitmap"])

        for batch in batches:
            for segment, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    if held:
                        yield done()
                    now, held = segment, []
                held.append(np.frombuffer(some, np.uint32))
        if held:
            yield done()

    return found.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, bitmap binary")


def width_for(bits: int, most: int) -> int:
    """log2 of a bitmap's size: ``bits`` or more, from 2**20 up to 2**``most``."""
    return min(most, max(LEAST_WIDTH, int(bits).bit_length()))


def key_bits(df: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int, least: int = 1) -> np.ndarray:
    """The bitmap of the keys of ``df`` that come ``least`` times or more, on the driver: 2**width / 8 bytes."""
    whole = np.zeros((1 << width) // 8, np.uint8)
    step = len(whole) >> SEGMENT
    for row in slices(gathered(df, items_of, least), least, width).toLocalIterator():
        whole[row["segment"] * step : (row["segment"] + 1) * step] = np.frombuffer(bytes(row["bitmap"]), np.uint8)
    return whole


def passed(items: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether each key may have been put into the bitmap."""
    width = len(bitmap).bit_length() + 2
    found = cells(items)
    slice_ = found >> np.uint64(CELL) << np.uint64(width - SEGMENT)
    out = np.ones(len(items), bool)
    for at in _bits(found & np.uint64((1 << CELL) - 1), width):
        at = slice_ + at
        out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def long_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The keys of a batch whose first column they are, as longs."""
    yield batch.column(0).to_numpy().view(np.uint64)
