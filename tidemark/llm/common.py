"""Helpers that the training-data operators share: table access, checkpoints, Arrow batches, bitmaps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor the working folder does: Spark serves a zip of its sources."""
    known = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()] if p]
    app = spark.sparkContext.applicationId
    if str(_ROOT) in known or app in _shipped:
        return
    path = f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark-sources.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((_ROOT / "tidemark").rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder, read by Spark alone so that any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Where none is named, a local master (one process, as in tests) gets a folder of its own; on a cluster that is an error, as
    executors would write to their own disks and later reads would miss what the others wrote.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


#: Spark drops a query's shuffle files when it ends, if this is set; otherwise they stay until the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables that each application's cuts have written.
_cuts: dict[str, list[str]] = {}


def cuts_so_far(spark: SparkSession) -> int:
    """How many tables this application's cuts have written and not dropped: a mark for ``drop_cuts``."""
    return len(_cuts.get(spark.sparkContext.applicationId, []))


def drop_cuts(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the tables this application's cuts wrote since a mark, up to another, and how many; for after the results that rest on them are written."""
    held = _cuts.get(spark.sparkContext.applicationId, [])
    paths = held[since:until]
    del held[since:until]
    for path in paths:
        drop_folder(spark, path)
    return len(paths)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back; what was shuffled to make it goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    _cuts.setdefault(spark.sparkContext.applicationId, []).append(path)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, where the session has Spark's default: a batch of texts then stays small in the executor and its workers.
BATCH_ROWS, _ROWS = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have Spark send fewer rows at a time to Python than its default of 10,000; a setting of the session's own stays."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with one function per task; ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def concatenated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, end to end, and the offsets (n + 1) of each; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: each output bit depends on each input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that Spark deals out by key, both sides, instead of sending one whole to the driver and everywhere.

    For tables that grow with the documents: Spark takes a table for as small as its files, but numbers pack tightly in Parquet and Python may make many rows of one.
    """
    return df.hint("merge")


class KeyBitmap:
    """A bitmap with the bit of each key's hash set, as a broadcast table of 64-bit words: 16 bits a key, but never more than ``most`` bits.

    It has no false negatives; where keys outnumber half the bits, it lets everything through and the exact step behind it
    does all the work. The table has at most ``most / 64`` rows (a million by default), whatever the input. ``keys`` is
    counted first: give a cut table.
    """

    def __init__(self, keys: DataFrame, *key: str | Column, most: int = 1 << 26) -> None:
        n = keys.count()
        self.full = 2 * n > most  # hardly a bit would be clear: nothing is built or broadcast, everything passes
        self.bits = min(most, max(1 << 12, 1 << (16 * n).bit_length()))
        bit = self._bit(*key)
        self.words = (
            keys.select(bit.alias("tm_bit__"))
            .select(F.shiftright("tm_bit__", 6).alias("tm_word__"), F.expr("shiftleft(1L, cast(tm_bit__ & 63 AS INT))").alias("tm_one__"))
            .groupBy("tm_word__")
            .agg(F.bit_or("tm_one__").alias("tm_mask__"))
        )

    def _bit(self, *key: str | Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.bits))

    def _tested(self, df: DataFrame, key: tuple, held: bool) -> DataFrame:
        if self.full:
            return df if held else df.where(F.lit(False))
        rows = df.withColumn("tm_bit__", self._bit(*key)).withColumn("tm_at__", F.shiftright("tm_bit__", 6))
        found = rows.join(F.broadcast(self.words), F.col("tm_at__") == F.col("tm_word__"), "left")
        bit = F.expr("coalesce(shiftright(tm_mask__, cast(tm_bit__ & 63 AS INT)) & 1L, 0L)")
        return found.where(bit == int(held)).drop("tm_bit__", "tm_at__", "tm_word__", "tm_mask__")

    def held(self, df: DataFrame, *key: str | Column) -> DataFrame:
        """Rows of ``df`` whose key's bit is set: a superset of those whose key was put in."""
        return self._tested(df, key, True)

    def others(self, df: DataFrame, *key: str | Column) -> DataFrame:
        """Rows of ``df`` whose key was surely not put in."""
        return self._tested(df, key, False)


def left_joined(df: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """``df`` left joined with a cut table on columns of the same names (null equals null); rows that a bounded bitmap of its keys rules out are not shuffled."""
    bitmap = KeyBitmap(found, *keys)
    others = [f.name for f in found.schema if f.name not in keys]
    alone = bitmap.others(df, *keys).select("*", *[F.lit(None).cast(found.schema[n].dataType).alias(n) for n in others])
    named = found.select(*[F.col(k).alias(f"tm_{k}__") for k in keys], *others)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"tm_{k}__"))
    return alone.union(bitmap.held(df, *keys).join(named, same, "left").select(*df.columns, *others))


def without(df: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows of ``df`` whose keys equal no row of ``gone`` (null equals null), column by column.

    Rows that a bounded bitmap of ``gone`` rules out stay where they are; only the others are shuffled and compared.
    """
    names = [f"gone_{k}_" for k in range(len(keys))]
    gone = cut(gone.toDF(*names).distinct())
    bitmap = KeyBitmap(gone, *names)
    same = keys[0].eqNullSafe(F.col(names[0]))
    for k, n in zip(keys[1:], names[1:], strict=True):
        same &= k.eqNullSafe(F.col(n))
    return bitmap.others(df, *keys).union(bitmap.held(df, *keys).join(gone, same, "left_anti"))
