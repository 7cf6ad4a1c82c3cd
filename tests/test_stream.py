"""Streams: late rows are counted and left out, a replayed batch changes nothing, sessions close once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import drift_stream

SCHEMA = "id long, ts timestamp, user string, kind string"
T0 = datetime(2024, 1, 1)


def put(spark, folder, rows):
    spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, k) for i, m, u, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [(1, 0, "a", "x"), (2, 10, "a", "y"), (3, 700, "b", "x")])
    return folder, lambda: spark.readStream.schema(SCHEMA).parquet(folder)


def counts(spark, tmp_path):
    rows = drift_stream.latest_counts(spark, str(tmp_path / "counts"))
    return {(r["window_start"], r["category"]): r["n"] for r in rows.collect()}


def test_late_rows_are_counted_and_left_out(spark, tmp_path, stream):
    folder, read = stream
    run = lambda: drift_stream.monitor(read(), "ts", "kind", str(tmp_path / "counts"), str(tmp_path / "c"), window="1 hour", late="30 minutes")
    first = run()
    first.awaitTermination()
    assert drift_stream.late_rows(first) == 0
    put(spark, folder, [(4, 20, "a", "x"), (5, 690, "a", "x"), (6, 701, "a", "x")])  # the watermark is at 670: the first is late
    second = run()
    second.awaitTermination()
    assert drift_stream.late_rows(second) == 1
    assert counts(spark, tmp_path) == {(T0, "x"): 1, (T0, "y"): 1, (T0 + timedelta(hours=11), "x"): 3}


def test_replayed_events_change_nothing(spark, tmp_path, stream):
    folder, read = stream
    run = lambda: drift_stream.monitor(read(), "ts", "kind", str(tmp_path / "counts"), str(tmp_path / "c"), window="1 hour", late="1 day", ids=["id"]).awaitTermination()
    run()
    before = counts(spark, tmp_path)
    put(spark, folder, [(1, 0, "a", "x"), (2, 10, "a", "y"), (3, 700, "b", "x")])
    run()
    assert counts(spark, tmp_path) == before and sum(before.values()) == 3
    put(spark, folder, [(2, 10, "a", "y"), (9, 15, "a", "y")])
    run()
    assert counts(spark, tmp_path) == before | {(T0, "y"): 2}


def test_sessions_close_once_and_grow_across_batches(spark, tmp_path, stream):
    folder, read = stream

    def closed():
        drift_stream.closed_sessions(read(), "ts", "user", str(tmp_path / "s"), str(tmp_path / "c"), gap="30 minutes", late="1 hour").awaitTermination()
        return sorted((r["user"], r["session_start"], r["session_end"], r["n"]) for r in spark.read.parquet(str(tmp_path / "s")).collect())

    at = lambda m: T0 + timedelta(minutes=m)
    first = [("a", at(0), at(40), 2)]
    assert closed() == first
    put(spark, folder, [(5, 725, "b", "x"), (6, 2000, "c", "x")])
    assert closed() == [*first, ("b", at(700), at(755), 2)]
    put(spark, folder, [(7, 5, "a", "x")])
    assert closed() == [*first, ("b", at(700), at(755), 2)]


def test_sliding_windows_hold_a_row_more_than_once(spark, stream):
    folder, _ = stream
    rows = drift_stream.windowed_counts(spark.read.parquet(folder), "ts", "kind", "1 hour", "1 hour", "30 minutes").groupBy().agg(F.sum("n")).first()[0]
    assert rows == 6
