"""Records of CSV files whose quoted fields hold line breaks, cut by the splits themselves so that files stay splittable.

A split's lines alone do not tell whether it begins within quotes. So each split first works out where it would end for both ways to
begin; only lines with an odd number of quotes can change that, and only these reach Python. Chained over a file's splits, the
answers give every split its true beginning, and each then cuts its own records. What a split holds of a record that began before it, or
that goes on behind it, is a fragment; fragments, two a split at most, are the only thing that is shuffled. The records are written
as a table, since they hold only for the splits that were looked at; should the next job split files in another way (executors
came or went), it stops, and both are done again.

A quote opens a field only where a field begins: a stray quote within an unquoted field changes nothing. Lines end at a line
feed, or a carriage return and a line feed; within quotes both are kept. A quote that is never closed makes the rest of the file one record.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import scratch, stored

_MOVED = "splits differ from those whose quotes were counted"
Known = dict[str, list[tuple[int, bool, int]]]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): every line as it is in the file, and the split it came with, in the split's order."""
    rows = spark.read.text(path, lineSep="\n")
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def odd_quotes(line: str) -> Column:
    """Whether a line has an odd number of quotes."""
    return (F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit('"'), F.lit("")))) % 2 == 1


def surveyed(rows: DataFrame) -> DataFrame:
    """(file, start, odd, no_text): lines with an odd number of quotes, and lines that are no UTF-8, of each split of ``lines``."""
    return rows.groupBy("file", "start").agg(F.count_if(odd_quotes("value")).alias("odd"), F.count_if(~F.is_valid_utf8("value")).alias("no_text"))


def walker(sep: str = ",") -> Callable[[bytes, bool], bool]:
    """A function of a line and whether it begins within quotes: whether it ends within quotes."""
    comma = sep.encode()

    def ends_within(line: bytes, within: bool) -> bool:
        at = 0
        while True:
            if within or line[at : at + 1] == b'"':
                at += not within
                while True:  # to the quote that closes the field
                    at = line.find(b'"', at)
                    if at < 0:
                        return True
                    if line[at + 1 : at + 2] != b'"':
                        break
                    at += 2
                within = False
            at = line.find(comma, at)
            if at < 0:
                return False
            at += 1

    return ends_within


def split_ends(rows: DataFrame, sep: str = ",") -> DataFrame:
    """(file, start, outside, within, closed) of each split that has odd lines.

    ``outside`` and ``within`` tell whether it ends within quotes where it begins outside and within them; ``closed`` whether, beginning within,
    it ever leaves them.
    """
    ends_within = walker(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        now, ends, closed = None, (False, True), False
        for batch in batches:
            for value, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, *ends, closed), strict=True))])
                    now, ends, closed = (file, start), (False, True), False
                both = {w: ends_within(value, w) for w in set(ends)}
                ends = (both[ends[0]], both[ends[1]])
                closed = closed or not ends[1]
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, *ends, closed), strict=True))])

    names = ("file", "start", "outside", "within", "closed")
    odd = rows.where(odd_quotes("value")).select(F.col("value").cast("binary").alias("value"), "file", "start")
    return odd.mapInArrow(run, "file string, start long, outside boolean, within boolean, closed boolean")


def beginnings(ends: list[tuple[str, int, bool, bool, bool]]) -> Known:
    """{file: [(start, within, owner)]} by start: how a split begins, and if within quotes, the split where that record began.

    A split without odd lines ends as it begins, so it goes by the next entry; the last entry stands for all that follow.
    """
    out: Known = {}
    state: dict[str, tuple[bool, int]] = {}
    for file, start, outside, within, closed in sorted(ends):
        inside, owner = state.get(file, (False, -1))
        out.setdefault(file, []).append((start, inside, owner))
        after = within if inside else outside
        state[file] = (after, owner if inside and not closed else start) if after else (False, -1)
    for file, (inside, owner) in state.items():
        out[file].append((1 << 62, inside, owner))
    return out


def _pieces(rows: DataFrame, known: Known, starts: dict[str, set[int]], sep: str) -> DataFrame:
    """(record, file, start, owner, first): whole records, whose owner is null, and fragments of the record that began in the split ``owner``."""
    ends_within = walker(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("record", pa.binary()), ("file", pa.string()), ("start", pa.int64()), ("owner", pa.int64()), ("first", pa.bool_())])
        now, within, owner, first = None, False, -1, False
        held: list[bytes] = []
        out: list[tuple] = []

        def close(whole: bool) -> None:
            out.append((b"\n".join(held), *now, None if whole and owner < 0 else owner if owner >= 0 else now[1], first))
            held.clear()

        def done() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            value, file_, start_, odd = batch.columns
            same = pc.and_(pc.equal(file_[1:], file_[:-1]), pc.equal(start_[1:], start_[:-1])).to_numpy(zero_copy_only=False).astype(bool)
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
            odds = odd.to_numpy(zero_copy_only=False).astype(bool)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                file, start = file_[a].as_py(), start_[a].as_py()
                if (file, start) != now:
                    if held:
                        close(False)
                    if file in starts and start not in starts[file]:
                        raise RuntimeError(moved)
                    entries = known.get(file, [(1 << 62, False, -1)])
                    now = (file, start)
                    _, within, owner = entries[bisect_left(entries, (start,))]
                    first = start == 0
                some, after, at = value[a:b], np.empty(b - a, bool), 0
                for k in np.flatnonzero(odds[a:b]).tolist():  # all other lines end as they begin
                    after[at:k] = within
                    after[k] = within = ends_within(some[k].as_py(), within)
                    at = k + 1
                after[at:] = within
                stops, done_to = np.flatnonzero(~after) + 1, 0
                if len(stops) and (held or owner >= 0 or first):
                    done_to, stops = int(stops[0]), stops[1:]
                    held += some[:done_to].to_pylist()
                    close(True)
                    owner, first = -1, False
                if len(stops):  # whole records of this split: their lines put together at once
                    n = len(stops)
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(done_to, stops).astype(np.int32)), some), b"\n")
                    columns = [joined, pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(start, pa.int64()), n), pa.nulls(n, pa.int64()), pa.repeat(False, n)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    done_to = int(stops[-1])
                held += some[done_to:].to_pylist()
            if out:
                yield done()
        if held:
            close(False)
        if out:
            yield done()

    moved = _MOVED
    asked = rows.select(F.col("value").cast("binary").alias("value"), "file", "start", odd_quotes("value").alias("odd"))
    return asked.mapInArrow(run, "record binary, file string, start long, owner long, first boolean")


def records(rows: DataFrame, survey: list[tuple[str, int, int]], sep: str = ",", tries: int = 3) -> DataFrame:
    """(record, first): a stored table of all records of ``lines`` as bytes, the first of each file marked; their order is not kept.

    ``survey`` has (file, start, odd lines) of each split: as much as the scheduler itself holds of a scan.
    """
    spark = rows.sparkSession
    for left in reversed(range(tries)):
        known = beginnings([tuple(r) for r in split_ends(rows, sep).collect()])
        starts: dict[str, set[int]] = {}
        for file, start, _ in survey:
            if file in known:
                starts.setdefault(file, set()).add(start)
        pieces = _pieces(rows, known, starts, sep)
        try:
            if any(entry[0] not in starts.get(file, ()) for file, entries in known.items() for entry in entries[:-1]):
                raise RuntimeError(_MOVED)
            pieces = stored(spark, pieces, scratch(spark))
            break
        except Exception as e:  # noqa: BLE001
            if not left or _MOVED not in str(e):
                raise
            survey = [(r["file"], r["start"], r["odd"]) for r in surveyed(rows).collect()]
    whole = pieces.where("owner IS NULL").select("record", "first")
    parts = pieces.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("p"), F.max("first").alias("first"))
    line_feed = F.lit("\n").cast("binary")
    joined = F.aggregate(F.slice("p", 2, F.size("p")), F.element_at("p", 1)["record"], lambda a, x: F.concat(a, line_feed, x["record"]))
    return whole.union(parts.select(joined.alias("record"), "first"))
