"""An extension beyond batch: category histograms of event-time windows, compared with a fixed reference, and sessions; repeats and late rows.

Windows tumble, slide or follow a key's activity. Repeated events are dropped while the watermark lets them in (their ids are state
only that long); rows behind it are counted, not guessed at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import severity
from tidemark.functions.text import level


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The stream with its event time as a timestamp and a watermark that far behind the latest."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def without_repeats(stream: DataFrame, time: str, ids: Sequence[str], late: str = "1 hour") -> DataFrame:
    """The first row of each id; others that come within ``late`` of it, replayed ones too, are dropped, and the id is forgotten after that."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark(list(ids))


def windowed_counts(stream: DataFrame, time: str, col: str, window: str = "1 day", late: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, category, n): counts of event-time windows, of all that a row falls into where they slide; rows later than ``late`` are left out.

    Without ``late`` the stream has a watermark already.
    """
    at = F.window(time, window, slide) if slide else F.window(time, window)
    rows = timed(stream, time, late) if late else stream
    return rows.groupBy(at.alias("w"), level(F.col(col)).alias("category")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "category", "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's rows with less than ``gap`` from each to the next; the end is a gap behind the last row."""
    found = timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def closed_sessions(stream: DataFrame, time: str, key: str, out: str, checkpoint: str, gap: str = "30 minutes", late: str = "1 hour") -> StreamingQuery:
    """Runs what is available and appends the sessions that the watermark has passed, each once, as Parquet; open ones stay in the checkpoint's state."""
    found = sessions(stream, time, key, gap, late)
    return found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """How many rows of a query's recent batches came behind the watermark and were left out."""
    return sum(op["numRowsDroppedByWatermark"] for told in query.recentProgress for op in told["stateOperators"])


def window_psi(counts: DataFrame, reference: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(window_start, psi, severity) of windowed counts against a reference (category, freq); levels of either side count."""
    totals = counts.groupBy("window_start").agg(F.sum("n").alias("total"))
    grid = totals.join(F.broadcast(reference.select("category", F.col("freq").alias("p"))))  # the reference's levels in every window
    seen = counts.join(totals, "window_start").select("window_start", "category", (F.col("n") / F.col("total")).alias("q"))
    both = grid.select("window_start", "category", "p").join(seen, ["window_start", "category"], "full_outer").fillna(0.0, ["p", "q"])
    p, q = F.greatest("p", F.lit(config.psi_floor)), F.greatest("q", F.lit(config.psi_floor))
    told = both.groupBy("window_start").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    return told.withColumn("severity", severity(F.col("psi"), config.psi))


def monitor(
    stream: DataFrame, time: str, col: str, counts_dir: str, checkpoint: str, window: str = "1 day", late: str = "1 hour", slide: str | None = None, ids: Sequence[str] = (),
) -> StreamingQuery:
    """Runs what is available and writes the counts that changed, each batch into a folder of its own below ``counts_dir``.

    A batch that runs again overwrites its folder, so nothing is counted twice. Restart with the same checkpoint goes on where it stopped. With
    ``ids`` repeated events count once.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{counts_dir}/epoch={epoch}")

    if ids:
        stream = without_repeats(stream, time, ids, late)
    counts = windowed_counts(stream, time, col, window, None if ids else late, slide)
    return counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, counts_dir: str) -> DataFrame:
    """(window_start, category, n) after all batches: the last count of each window and category, windows that are still open among them."""
    rows = spark.read.parquet(counts_dir)
    return rows.groupBy("window_start", "category").agg(F.max_by("n", "epoch").alias("n"))
