"""Exact deduplication: counting quotient filters find repeated fingerprints, their rows are verified byte by byte.

1. Each partition adds the 64-bit fingerprint of each text to counting quotient filters, one per slice of the
   fingerprint space, and sends them on; filters of a slice merge losslessly by their sorted remainders. Copies within
   a partition are one counter, so a hot text weighs no more than any other.
2. Fingerprints with a count above one make up a bitmap of bounded size. Only rows whose bit is set
   go on with their text, grouped on fingerprint and whole text, so texts are compared byte by byte. Partial
   aggregates keep one row per text and partition.
3. Every row learns its class over (fingerprint, SHA-256), narrow rows only; all others are alone.

Null text counts as empty. Of equal texts the largest doc_id stays. Null ids rank below all others; a class of
null ids alone has a null keep_id and keeps all its rows. Rows that repeat a doc_id count in group_size and
share their fate. Very long texts are whole, and texts tie only where all bytes are equal. An empty table gives an empty one; other
columns are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KeyBitmap, cut, map_batches, table
from tidemark.llm.quotient import SLICE_BITS, QuotientFilter

#: Fingerprints that a task gathers before it sends its filters on.
FLUSH = 1 << 20
#: Fingerprints of a slice, about: a merged filter then has some 8 MB, however many there are in all.
SLICE = 1 << 20
#: Bits that name the slices which partitions send, few enough that each filter is worth a row; fingerprints that a task of the first level merges, about.
COARSE, SHARE = 6, 1 << 24


def slice_bits(rows: int) -> int:
    """Bits of a fingerprint that name its slice."""
    return min(24, max(COARSE, (rows // SLICE).bit_length()))


_FILTERS = pa.schema([("slice", pa.int32()), ("filter", pa.binary())])


def _sent(parts: list[tuple[int, QuotientFilter]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([f.to_bytes() for _, f in parts], pa.binary())], schema=_FILTERS)


def partition_filters(df: DataFrame, column: str = "fp", bits: int = SLICE_BITS) -> DataFrame:
    """(slice, filter): the counting quotient filters of each partition's fingerprints (a long column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                n += batch.num_rows
            if n >= FLUSH:
                yield _sent(QuotientFilter.of(np.concatenate(held)).split(bits))
                held, n = [], 0
        if held:
            yield _sent(QuotientFilter.of(np.concatenate(held)).split(bits))

    return df.select(F.col(column).cast("long")).mapInArrow(run, "slice int, filter binary")


def merged_filters(filters: DataFrame, bits: int = 0, *by: Column) -> DataFrame:
    """(slice, filter): filters of a slice (and of equal ``by``) merge into one, which is split into slices of ``bits`` bits where that is given.

    Filters stream in sorted by slice and are merged many at a time, by their sorted remainders; a task holds one slice's distinct fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[QuotientFilter] = []
        fresh = 0  # fingerprints that came since the last merge

        def done() -> pa.RecordBatch:
            whole = QuotientFilter.merged(held)
            return _sent(whole.split(bits) if bits else [(now, whole)])

        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if held:
                        yield done()
                    now, held, fresh = k, [], 0
                held.append(QuotientFilter.from_bytes(blob))
                fresh += len(held[-1].keys)
                if fresh > max(FLUSH, len(held[0].keys)):  # what came is as much as what is merged: each fingerprint is merged few times
                    held, fresh = [QuotientFilter.merged(held)], 0
        if held:
            yield done()

    return filters.repartition("slice", *by).sortWithinPartitions("slice").mapInArrow(run, "slice int, filter binary")


def slice_filters(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(slice, filter): one filter for each slice of all fingerprints (column ``fp``).

    Partitions send coarse slices. With more fingerprints than those should hold, shares of each coarse slice are merged and split into
    fine slices first, so that no partition sends a row for each of very many slices.
    """
    filters, bits = partition_filters(fingerprints, bits=COARSE), slice_bits(rows)
    if bits > COARSE:
        shares = max(1, rows // (SHARE << COARSE))
        filters = merged_filters(filters, bits, F.pmod(F.xxhash64("filter"), F.lit(shares)))
    return merged_filters(filters)


def repeated_fingerprints(filters: DataFrame) -> DataFrame:
    """(fp): fingerprints with a count above one in merged filters."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for blob in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(QuotientFilter.from_bytes(blob).repeated().view(np.int64))], ["fp"])

        return each

    return map_batches(filters, make, "fp long")


def exact_classes(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    repeated = cut(repeated_fingerprints(slice_filters(rows.select("fp"), df.count())))
    routed = KeyBitmap(repeated, "fp").held(rows, "fp")
    classes = (
        routed.groupBy("fp", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("fp").alias("k_fp"), F.sha2("text", 256).alias("k_sha"), "keep_id", "group_size")
    )
    narrow = rows.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256"))
    found = narrow.join(classes, (narrow["fp"] == classes["k_fp"]) & (narrow["text_sha256"] == classes["k_sha"]), "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
