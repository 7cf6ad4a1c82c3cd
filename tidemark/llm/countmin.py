"""Count-min sketches as DataFrames: per-partition sketches of 64-bit items merge into bitmaps of repeated cells.

A sketch has ``DEPTH`` rows of 2**``width`` counters, cut into segments of 2**``SEGMENT`` cells. A partition sends, for each
segment, the cells it counted and whether more than once (counters saturate at two, as nothing asks for more); a segment's
sketches merge by addition, one segment at a time in a task. An item's estimate is the least of its counters, so it is never too low: an item that
occurs twice anywhere has all its cells at two or more. What goes back to the executors is one bit per cell (count above one):
2**``width`` / 4 bytes. The width follows the size of the texts up to a bound given as a parameter (64 MB at the default of 28);
with more items than cells, more of them pass as repeated and the exact step behind the sketch does more work; none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64

DEPTH, SEGMENT, CAP = 2, 20, 2
#: Items that a task gathers before it sends its sketch on.
FLUSH = 1 << 19
_SALTS = np.array([0x8BB84B93962EACC9, 0x4B33A62ED433D4A3], np.uint64)


def cells(items: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row of the sketch, the cell of each item; row d's cells follow those of the rows before."""
    return [(mix64(items ^ _SALTS[d]) >> np.uint64(64 - width)).astype(np.int64) + (d << width) for d in range(DEPTH)]


def sketch(items: np.ndarray, width: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, cells within it, bits) of the items' sketch: 16 block sizes and the cells' low 16 bits in order; a bit for a count above one."""
    if not len(items):
        return
    at = np.sort(np.concatenate(cells(items, width)))
    first = np.concatenate(([True], at[1:] != at[:-1]))
    more = np.diff(np.append(np.flatnonzero(first), len(at))) > 1
    at = at[first]
    segments = at >> SEGMENT
    edges = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        within = at[a:b] & ((1 << SEGMENT) - 1)
        blocks = np.bincount(within >> 16, minlength=1 << (SEGMENT - 16)).astype(np.uint32)
        yield int(segments[a]), blocks.tobytes() + within.astype(np.uint16).tobytes(), np.packbits(more[a:b]).tobytes()


def read_sketch(at: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cells within the segment and their counts, 1 or 2 (two or more)."""
    n = 1 << (SEGMENT - 16)
    blocks = np.frombuffer(at, np.uint32, n)
    low = np.frombuffer(at, np.uint16, offset=4 * n)
    return np.repeat(np.arange(n) << 16, blocks) + low, 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(low))


def partition_sketches(df: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int) -> DataFrame:
    """(segment, cells, more): the sketches of each partition's items."""
    names = ["segment", "cells", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(sketch(np.concatenate(held), width))
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

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

    return df.mapInArrow(run, "segment int, cells binary, more binary")


def merged_bitmaps(sketches: DataFrame) -> DataFrame:
    """(segment, bitmap): a bit for each cell whose counts add up to more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = -1, np.zeros(1 << SEGMENT, np.uint8)

        def done() -> pa.RecordBatch:
            bits = np.packbits(counters > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["segment", "bitmap"])

        for batch in batches:
            for segment, at, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    if now >= 0:
                        yield done()
                    now = segment
                    counters[:] = 0
                where, counts = read_sketch(at, more)
                counters[where] = np.minimum(counters[where] + counts, CAP)
        if now >= 0:
            yield done()

    return sketches.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, bitmap binary")


def fitting_width(texts: DataFrame, bytes_per_item: int, most: int) -> int:
    """log2 of a row's cells: four cells for each item that the texts (column ``text``) will give, from 2**20 up to 2**``most``."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(SEGMENT, (4 * total // bytes_per_item).bit_length()))


def repeated_cells(df: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int) -> np.ndarray:
    """The merged bitmap of the items of ``df`` on the driver: 2**width / 4 bytes."""
    whole = np.zeros((DEPTH << width) // 8, np.uint8)
    step = (1 << SEGMENT) // 8
    for row in merged_bitmaps(partition_sketches(df, items_of, width)).toLocalIterator():
        whole[row["segment"] * step : (row["segment"] + 1) * step] = np.frombuffer(bytes(row["bitmap"]), np.uint8)
    return whole


def estimated_repeated(items: np.ndarray, bitmap: np.ndarray, width: int) -> np.ndarray:
    """Whether each item's estimate is above one."""
    out = np.ones(len(items), bool)
    for at in cells(items, width):
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out
