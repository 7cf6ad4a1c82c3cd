"""Running sums over an order that no single task has to hold: buckets by approximate quantile, sums of buckets, then a window within each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a key for each shuffle partition of the session, and at most: the edges of all keys are broadcast.
SHARE, MOST = 4, 4096


def running_sums(df: DataFrame, sums: Sequence[str], order: str = "x", key: str = "feature", descending: bool = False, buckets: int | None = None) -> DataFrame:
    """``df`` (one row per key and value of ``order``, none null) with ``cum_<c>`` for each c in ``sums``: the sum up to and with this row.

    A key's rows are cut into buckets at approximate quantiles, so windows hold a share of them each; the bucket
    totals (at most ``buckets`` rows per key) carry the sums over. Buckets follow the session's shuffle partitions, which are set
    by the size of the data, so that even a single key keeps all of them busy.
    """
    placed, carried = bucketed(df, sums, order, key, descending, buckets)
    return within_buckets(placed, carried, sums, order, key, descending).select(*df.columns, *[f"cum_{c}" for c in sums])


def bucketed(df: DataFrame, sums: Sequence[str], order: str = "x", key: str = "feature", descending: bool = False, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with the bucket of each row, and (key, bucket_, t_<c>, before_<c>): a bucket's sums and those of all buckets before it."""
    if buckets is None:
        buckets = min(MOST, SHARE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = 1 << max(1, (buckets - 1).bit_length())
    accuracy = max(1000, 4 * buckets)
    edges = df.groupBy(key).agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], accuracy).alias("edges_"))
    placed = df.join(F.broadcast(edges), key).withColumn("bucket_", F.lit(0))
    step = buckets
    while step > 1:  # binary search: the number of edges below the value
        step //= 2
        below = F.element_at("edges_", F.col("bucket_") + step) < F.col(order)
        placed = placed.withColumn("bucket_", F.col("bucket_") + F.when(below, step).otherwise(0))
    placed = placed.drop("edges_")
    by = F.desc if descending else F.asc
    totals = placed.groupBy(key, "bucket_").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    before = Window.partitionBy(key).orderBy(by("bucket_")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("*", *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums])
    return placed, carried


def within_buckets(placed: DataFrame, carried: DataFrame, sums: Sequence[str], order: str = "x", key: str = "feature", descending: bool = False) -> DataFrame:
    """Rows of the buckets that ``carried`` has, with its columns and ``cum_<c>``."""
    by = F.desc if descending else F.asc
    within = Window.partitionBy(key, "bucket_").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(carried), [key, "bucket_"])
    return out.select("*", *[(F.col(f"before_{c}") + F.sum(c).over(within)).alias(f"cum_{c}") for c in sums])
