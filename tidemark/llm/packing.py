"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents are dealt by hash to shards of bounded size, equal rows in small lots; each shard packs on its own, longest piece first. Open bins are
ordered by residual room. A bin carries bitmaps of the sources and duplicate clusters in it; from the tightest bin with
room the successor search goes on until a compatible one is found, else a bin opens. A piece is compatible if no piece of its
cluster is in the bin and fewer than ``per_source`` documents of its source are. Texts longer than a bin are cut into full bins
and a rest; nothing is dropped or shortened.

Null lengths count as 0; pieces of length 0 are packed like others. A null cluster conflicts with nothing, null
sources are one source. Null ids are dealt like others, and repeated rows are packed once each. An empty table has no bins. A single
cluster with many members needs as many bins, by definition; equal pieces go on from the bin of the one before, so that
a shard's work stays bounded.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

CAPACITY, PER_SOURCE, SHARD_ROWS = 2048, 2, 8192
#: Equal rows that are dealt to a shard together.
LOT = 16


class Bins:
    """Bins of one shard, ordered by residual room and then number."""

    def __init__(self, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has r tokens left
        self.sources: list[list[int]] = []  # per bin, plane k: sources with more than k documents in it
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def _put(self, b: int, room: int) -> None:
        insort(self.by_room[room], b)
        self.rooms |= 1 << room

    def place(self, length: int, source: int, cluster: int, after: tuple[int, int] | None = None) -> tuple[int, tuple[int, int]]:
        """Bin of a piece whose source and cluster are single bits (cluster 0: none), and where the search ended, for an equal piece."""
        room, last = after if after else (length, -1)
        left = self.rooms >> room << room
        while left:
            room_now = (left & -left).bit_length() - 1
            for k, b in enumerate(self.by_room[room_now]):
                if room_now == room and b <= last:
                    continue
                if not self.clusters[b] & cluster and not self.sources[b][-1] & source:
                    del self.by_room[room_now][k]
                    if not self.by_room[room_now]:
                        self.rooms &= ~(1 << room_now)
                    self._fill(b, room_now - length, length, source, cluster)
                    return b, (room_now, b)
            left &= left - 1
        b = len(self.filled)
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        self.filled.append(0)
        self._fill(b, self.capacity - length, length, source, cluster)
        return b, (self.capacity, b)

    def _fill(self, b: int, room: int, length: int, source: int, cluster: int) -> None:
        planes = self.sources[b]
        for k in range(self.per_source):
            if not planes[k] & source:
                planes[k] |= source
                break
        self.clusters[b] |= cluster
        at = self.filled[b]
        self.filled[b] = at + length
        self._put(b, room)


def pack(items: Iterable[tuple], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, piece, bin, offset, length) for items (id, length, source, cluster) of one shard, in packing order."""
    items = list(items)
    key = lambda v: (v is not None, v)
    bits: dict = {}
    source_bit = {s: 1 << k for k, s in enumerate(sorted({i[2] for i in items}, key=key))}
    for k, c in enumerate(sorted(c for c, n in Counter(i[3] for i in items).items() if n > 1 and c is not None)):
        bits[c] = 1 << k
    bins = Bins(capacity, per_source)
    rest = []
    order = sorted(range(len(items)), key=lambda k: (key(items[k][0]), items[k][1], key(items[k][2]), key(items[k][3])))
    for k in order:
        _, length, source, cluster = items[k]
        full = max(0, length - 1) // capacity  # a rest of a full bin is an ordinary piece
        for piece in range(full):
            b, _ = bins.place(capacity, source_bit[source], bits.get(cluster, 0))
            yield k, piece, b, 0, capacity
        rest.append((length - full * capacity, k, full))
    rest.sort(key=lambda r: (-r[0], key(items[r[1]][3]), key(items[r[1]][2])))  # stable: ids stay in order
    before, at = None, None
    for length, k, piece in rest:
        source, cluster = source_bit[items[k][2]], bits.get(items[k][3], 0)
        same = cluster and (length, source, cluster) == before
        b, at = bins.place(length, source, cluster, at if same else None)
        before = (length, source, cluster)
        yield k, piece, b, bins.filled[b] - length, length


OUT = "shard long, bin_id long, position long, doc_id long, piece long, length long, source string, cluster long"


def pack_documents(df: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of (doc_id, length, source, cluster): its shard, bin (unique over shards) and position in it."""
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0)).alias("length"),
        F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"),
    )
    names = ["doc_id", "length", "source", "cluster"]
    # rows that repeat are counted, then dealt out in lots: no shard gets more of them than of others, whatever their number
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    shards = max(1, -(-df.count() // shard_rows))
    lots = counted.select(*names, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))).alias("lot"))
    lots = lots.withColumn("shard", F.pmod(F.xxhash64(*names, "lot"), F.lit(shards)).cast("long"))
    of_lot = F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("lot") * LOT))
    rows = lots.select(*names, "shard", F.explode(of_lot).alias("one")).drop("one")

    def run(group: pa.Table) -> pa.Table:
        cols = {n: group.column(n).to_pylist() for n in ("doc_id", "length", "source", "cluster")}
        shard = group.column("shard")[0].as_py()
        out: dict[str, list] = {n.split()[0]: [] for n in OUT.split(", ")}
        for k, piece, b, at, length in pack(zip(*cols.values(), strict=True), capacity, per_source):
            for n, v in zip(out, (shard, shard << 32 | b, at, cols["doc_id"][k], piece, length, cols["source"][k], cols["cluster"][k]), strict=True):
                out[n].append(v)
        kinds = {n.split()[0]: pa.string() if n.endswith("string") else pa.int64() for n in OUT.split(", ")}
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})

    return rows.groupBy("shard").applyInArrow(run, OUT)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, length, source, cluster) of documents: words as tokens, texts equal but for case and spaces as one cluster."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("length"), "source",
        F.xxhash64(F.regexp_replace(F.lower(text), r"\s+", " ")).alias("cluster"),
    )


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(sized(table(spark, sf_dir, "documents")))
