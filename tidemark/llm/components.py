"""Connected components by alternating large-star and small-star rounds; links never leave the executors.

Links first shrink to a spanning forest within each partition (a union-find over at most ``FLUSH`` links at a time),
then rounds of joins run until the links are stars around the smallest node of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, dealt

#: Links that a task holds before it sends on their forest.
FLUSH = 1 << 19


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """(node, smallest node of its component) for the links' nodes that are not the smallest themselves."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    return nodes, [root(x) for x in nodes]


def local_forest(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: per partition, a forest that connects what the links (a, b) connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, v = _forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                n += batch.num_rows
            if n >= FLUSH:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of a link (a, b) but the smallest ones; a and b are not null."""
    now = cut(local_forest(links.select(F.col("a").cast("long"), F.col("b").cast("long"))).distinct())
    seen = None
    for _ in range(most_rounds):
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(told) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = tuple(told)
        if not told[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.where("v > u").join(dealt(least), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        near = large.join(dealt(least), F.col("u") == F.col("w"))
        now = cut(near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("w", "m")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
