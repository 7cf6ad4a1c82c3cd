"""SimHash near-duplicates: fingerprints linked through the anchors of a covering code.

A 64-bit fingerprint is the majority vote of its shingles' XXH64 hashes. Two fingerprints at distance 3 or less
have a half (32 bits) at distance 1 or less. The anchors of a half are the words of the perfect Hamming code of
length 31 beside one free bit: covering radius 1, so each half has one home anchor within distance 1. If x and y are
within ``t`` = 1 of each other, y is within 1 + t = 2 of x's home anchor; so every half goes to all anchors within 2 (2 of
them if it is a code word, else 17) and meets there the halves at home. 2^27 anchors per half keep
each anchor's company small, and links are checked on all 64 bits inside the join. Copies of a fingerprint
are one node, so the size of a group of copies does not matter. Anchors are fixed, so the company of one grows with the table:
beyond some 10^9 distinct fingerprints a wider code would be needed.

Null and empty texts have fingerprint zero, linked like any other; fewer than three words make one shingle. Very long texts are
whole, some 16 bytes a word in one task. Fingerprints at equal distance are all linked; of ids the smallest names the component. Rows
with a null doc_id get a fingerprint, no links and a null component. Repeated rows are repeated in the result; an id that comes with
several texts ties nothing together: each row has its own text's component. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, dealt, map_batches, table, texts_of
from tidemark.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words after lower-casing A to Z; repeats stay."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 256:
        votes = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits, of runs of ``shingle`` words."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            bits = np.array([majority(shingle_hashes(t, shingle)) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "fp"])

        return each

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, fp long")


# ---- anchors ----


def _syndrome(x: np.ndarray) -> np.ndarray:
    """XOR of the positions (1 to 31) of the set bits below bit 31; 0 for code words."""
    out = np.zeros(len(x), np.int64)
    for position in range(1, 32):
        out ^= np.where(x >> (position - 1) & 1, position, 0)
    return out


def _flip(x: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return x ^ np.where(positions > 0, np.int64(1) << np.maximum(positions - 1, 0), 0)


def home_anchor(x: np.ndarray) -> np.ndarray:
    """The anchor within distance 1 of each 32-bit value."""
    return _flip(x, _syndrome(x))


def near_anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor): all anchors within distance 2 of each 32-bit value."""
    s = _syndrome(x)
    at = np.arange(len(x))
    home = _flip(x, s)
    index, anchors = [at, at], [home, home ^ (np.int64(1) << 31)]  # with the free bit flipped: 1, or 2 with the syndrome's flip
    far = np.flatnonzero(s)
    for i in range(1, 32):  # two flips i and j of the code's bits with i xor j = s, each pair once
        j = i ^ s[far]
        pair = j > i
        index.append(far[pair])
        anchors.append(_flip(_flip(x[far[pair]], np.full(int(pair.sum()), i)), j[pair]))
    return np.concatenate(index), np.concatenate(anchors)


def _anchored(nodes: DataFrame, home: bool) -> DataFrame:
    """(key, fp): a row for each half at home, or for each half and anchor near it."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            fp = batch.column(0).to_numpy()
            for half in range(2):
                x = fp.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
                x = x.astype(np.int64)
                at, anchors = (np.arange(len(x)), home_anchor(x)) if home else near_anchors(x)
                yield pa.RecordBatch.from_arrays([pa.array(anchors | half << 32), pa.array(fp[at])], ["key", "fp"])

        return each

    return map_batches(nodes.select("fp"), make, "key long, fp long")


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints (fp) at distance ``DISTANCE`` or less; a link may come twice."""
    x = _anchored(nodes, True).select(F.col("key").alias("x_key"), F.col("fp").alias("a"))
    y = _anchored(nodes, False).select(F.col("key").alias("y_key"), F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return x.join(dealt(y), (F.col("x_key") == F.col("y_key")) & near).select("a", "b")


def near_components(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of (doc_id, text): the smallest doc_id that links of fingerprints reach."""
    prints = cut(fingerprints(df, shingle))
    nodes = cut(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(near_links(nodes))
    linked = nodes.join(dealt(found), F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("label", "fp").alias("part"))
    least = linked.groupBy("part").agg(F.min("id").alias("component_id"))
    named = linked.join(dealt(least), "part").select(F.col("fp").alias("n_fp"), "component_id")
    out = prints.join(dealt(named), F.col("fp") == F.col("n_fp"), "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
