"""Suffix-array deduplication by bytes: strings of 50 bytes that start in a document with a smaller id are cut out.

1. Rows whose whole text is a copy of a smaller document's are found by SHA-256; all their windows repeat, so they leave.
2. Every 50-byte window is filed under the least hash of its 24-byte grams; neighbouring windows mostly share it, so a
   text falls into short runs. A bitmap of the keys that occur twice (see ``keybits``) leaves runs whose key may do so.
3. The runs of a key are shuffled once and meet in one task; those of equal bytes are one class with its smallest and its largest document. Classes
   of several documents count as two texts: one of the first document, one of a later one. A
   suffix array over a block of keys and the interval tree of its common prefixes give the maximal repeats with all occurrences;
   an occurrence in a later document than the repeat's first is marked. That decides copies of a run and parts of it alike.
   A key with more than ``limit`` runs is split further, by whole windows, and those go through the same array, in pieces.
4. Where a row has a run, the marks of its class for the first or for later documents return to the row; a class is then named by
   its key and 128 bits of the SHA-256 of its bytes.

``repeat_groups`` gives the maximal repeats themselves, with all their occurrences in documents.

Null and empty texts lose nothing. A null id ranks above all others. Rows that repeat an id are one document to each other, and of equal
strings in one document none is first, so none goes for the other. Very long texts are whole: one is a chunk of its own, at some 100 bytes
of memory a byte in its task. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KeyBitmap, concatenated, cut, cuts_so_far, drop_cuts, left_joined, map_batches, table, without
from tidemark.llm.keybits import key_bits, passed, width_for
from tidemark.llm.suffix import SuffixArray
from tidemark.llm.windows import chunks, rolling, sliding_min

#: The gram is long enough for few runs to share one without sharing a window, however many texts there are; bitmaps have 2**``WIDTH`` bits at most.
WINDOW, GRAM, WIDTH = 50, 24, 29
#: Windows of a run at most, classes that one suffix array takes of one key, and bytes of classes that it takes of several.
LONGEST, LIMIT, BLOCK = 35, 8192, 1 << 20
#: Marks are one number each: start times ``SPAN`` plus length; -1 stands for the whole text.
SPAN, DIGEST = 128, 16
_LAST = (1 << 63) - 1
_CLASS = ["key", "segment", "doc", "last"]
_PART = ["part", "key", "run", "shift", "segment"]


class ByteRuns:
    """Runs of consecutive 50-byte windows of one text under one key, over a chunk of texts."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> None:
        self.body, self.window = body, window
        keys = sliding_min(rolling(body.astype(np.uint64) + np.uint64(1), gram), window - gram + 1)
        counts = np.maximum(np.diff(offsets) - window + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        at = offsets[text] + start
        new = np.ones(len(at), bool)
        new[1:] = (keys[at[1:]] != keys[at[:-1]]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        parts = -(-size // LONGEST)  # long runs (one gram again and again) in pieces
        if (parts > 1).any():
            piece = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(np.repeat(size, parts) - piece * LONGEST, LONGEST)
            first = np.repeat(first, parts) + piece * LONGEST
        self.begin, self.size, self.text, self.start = at[first], size, text[first], start[first]
        self.key = keys[self.begin]

    def keep(self, which: np.ndarray) -> ByteRuns:
        self.begin, self.size, self.key, self.text, self.start = (x[which] for x in (self.begin, self.size, self.key, self.text, self.start))
        return self

    def pieces(self) -> list[bytes]:
        """The bytes of each run."""
        data = self.body.tobytes()
        ends = self.begin + self.size + self.window - 1
        return [data[a:b] for a, b in zip(self.begin.tolist(), ends.tolist(), strict=True)]


def _named(segment: bytes) -> bytes:
    return hashlib.sha256(segment).digest()[:DIGEST]


def _runs(column: pa.Array, window: int, gram: int) -> Iterator[tuple[int, ByteRuns]]:
    body, offs = concatenated(column)
    for i, j in chunks(offs):
        yield i, ByteRuns(body[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window, gram)


def _classes(rows: DataFrame, bitmap, window: int, gram: int) -> DataFrame:  # noqa: ANN001
    """(key, segment, doc, last): a chunk's distinct candidate runs with their smallest and largest documents in it."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            docs = batch.column(0).to_numpy()
            for i, runs in _runs(batch.column(2), window, gram):
                runs.keep(passed(runs.key, bitmap.value))
                if not len(runs.key):
                    continue
                named: dict[bytes, int] = {}
                of = np.array([named.setdefault(piece, len(named)) for piece in runs.pieces()])
                doc = docs[i + runs.text]
                order = np.lexsort((doc, of))
                at = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))
                chosen, largest = order[at], doc[order[np.append(at[1:], len(order)) - 1]]
                columns = (pa.array(runs.key[chosen].view(np.int64)), pa.array(list(named), pa.binary()), pa.array(doc[chosen]), pa.array(largest))
                yield pa.RecordBatch.from_arrays(list(columns), _CLASS)

        return each

    return map_batches(rows.select("doc", "row", "text"), make, "key long, segment binary, doc long, last long")


def _told(keys: np.ndarray, names: pa.Array) -> np.ndarray:
    """A hash of each class by its key and the first half of its name."""
    return keys.view(np.uint64) ^ np.ascontiguousarray(concatenated(names)[0]).view(np.uint64)[:: DIGEST // 8]


def _postings(rows: DataFrame, bitmap, window: int, gram: int, asked) -> DataFrame:  # noqa: ANN001
    """(key, run, doc, row, start): where candidate runs are, in bytes, of the classes that the bitmap ``asked`` lets through."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            docs, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, runs in _runs(batch.column(2), window, gram):
                runs.keep(passed(runs.key, bitmap.value))
                run = pa.array(map(_named, runs.pieces()), pa.binary())
                which = np.flatnonzero(passed(_told(runs.key, run), asked.value))
                if len(which):
                    runs.keep(which)
                    columns = (runs.key.view(np.int64), docs[i + runs.text], names[i + runs.text], runs.start)
                    key, doc, row, start = map(pa.array, columns)
                    yield pa.RecordBatch.from_arrays([key, run.take(pa.array(which)), doc, row, start], ["key", "run", "doc", "row", "start"])

        return each

    return map_batches(rows.select("doc", "row", "text"), make, "key long, run binary, doc long, row long, start long")


class Repeats:
    """The maximal repeats of a table of classes (part, doc, last, segment), each found with all its occurrences by one suffix array.

    A class with a later document counts as two texts, ``of`` names the class of each text, ``doc`` its document. Classes of different
    parts are not compared, and those that are alone in their part and document need no place in the array.
    """

    def __init__(self, t: pa.Table, window: int) -> None:
        part, docs, last = (t[c].to_numpy() for c in ("part", "doc", "last"))
        _, group, sizes = np.unique(part, return_inverse=True, return_counts=True)
        later = np.flatnonzero(last > docs)
        firsts = np.flatnonzero((sizes[group] > 1) | (last > docs))
        self.of = np.concatenate([firsts, later])
        self.late = np.concatenate([np.zeros(len(firsts), bool), np.ones(len(later), bool)])
        self.doc = np.concatenate([docs[firsts], last[later]])
        body, offs = concatenated(t["segment"].combine_chunks().take(pa.array(self.of)))
        self.array = SuffixArray(body, offs[:-1], offs[1:], group[self.of], window)
        self.length, first, last_ = self.array.maximal_repeats(window)
        self.body, self.offs = body, offs
        n = last_ - first + 1
        self.sizes, self.first = n, first
        #: Every occurrence of every repeat, end to end: its place in the array.
        self.at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)

    def marks(self, classes: int) -> tuple[pa.ListArray, pa.ListArray]:
        """For each class the marks of what also begins in a smaller document: in its first document, and in later ones."""
        if len(self.sizes):
            held = np.append(self.doc[self.array.text], 0)  # one more, so that every end is a place
            least = np.minimum.reduceat(held, np.stack([self.first, self.first + self.sizes], 1).ravel())[::2]
            beyond = held[self.at] > np.repeat(least, self.sizes)
            at, length = self.at[beyond], np.repeat(self.length, self.sizes)[beyond]
        else:
            at = length = np.zeros(0, np.int64)
        text, start = self.array.text[at], self.array.offset[at]
        out = []
        for late in (False, True):
            mine = self.late[text] == late
            owner, a, n = self.of[text[mine]], start[mine], length[mine]
            order = np.lexsort((-n, a, owner))
            owner, a, n = owner[order], a[order], n[order]
            reach = np.maximum.accumulate(owner * (2 * SPAN) + a + n) if len(owner) else owner
            new = np.ones(len(owner), bool)  # what an earlier mark of the class covers says nothing new
            new[1:] = reach[1:] > np.maximum(reach[:-1], owner[1:] * (2 * SPAN))
            counts = np.bincount(owner[new], minlength=classes)
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array((a * SPAN + n)[new])))
        return out[0], out[1]


def _in_blocks(parts: DataFrame, each, schema: str, limit: int, block: int) -> DataFrame:  # noqa: ANN001
    """``each`` (a table of whole parts to record batches) over blocks of (part, .., doc, last, shift, segment), sorted by part and document.

    Equal rows but for documents become one class first, where the part is: one shuffle takes them there.
    A block is ``block`` bytes of whole parts. A part with more than ``limit`` rows comes in pieces; of each piece the first
    row of every distinct segment goes on into the next, so that the smallest document of all of them is there to compare with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size <= block:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            part = whole["part"].to_numpy()
            at = int(np.searchsorted(part, part[-1]))  # the last part may go on in the next batch
            if at:
                yield from each(whole.slice(0, at).combine_chunks())
                whole = whole.slice(at).combine_chunks()
            if len(whole) > limit:
                yield from each(whole)
                seen: dict[bytes, int] = {}
                for k, segment in enumerate(whole["segment"].to_pylist()):
                    seen.setdefault(segment, k)
                whole = whole.take(pa.array(sorted(seen.values()))).combine_chunks()
            held, size = whole.to_batches(), whole.nbytes if at else 0  # one part alone: look again after another block
        if held:
            yield from each(pa.Table.from_batches(held).combine_chunks())

    classes = parts.repartition("part").groupBy(*_PART).agg(F.min("doc").alias("doc"), F.max("last").alias("last"))
    return classes.sortWithinPartitions("part", "doc").mapInArrow(run, schema)


def _owners(t: pa.Table, which: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Key, name and shift of the classes at ``which``: of a whole class its own, of a window those of the class that it is part of."""
    some = t.select(["part", "key", "run", "shift", "segment"]).take(pa.array(which)).combine_chunks()
    run = [_named(segment) if run is None else run for run, segment in zip(some["run"].to_pylist(), some["segment"].to_pylist(), strict=True)]
    return pc.coalesce(some["key"], some["part"]).combine_chunks(), pa.array(run, pa.binary()), some["shift"].to_numpy()


def _marked(parts: DataFrame, window: int, limit: int, block: int) -> DataFrame:
    """(key, run, doc, early, later): classes that some document loses bytes by, with the marks for their first document and for later ones.

    A class whose windows were parts of their own comes once for each of them that has marks.
    """

    def each(t: pa.Table) -> Iterator[pa.RecordBatch]:
        early, later = Repeats(t, window).marks(len(t))
        keep = np.flatnonzero((np.diff(early.offsets.to_numpy()) > 0) | (np.diff(later.offsets.to_numpy()) > 0))
        if len(keep):
            key, run, shift = _owners(t, keep)
            columns = [key, run, pa.array(t["doc"].to_numpy()[keep]), pa.array(shift), early.take(pa.array(keep)), later.take(pa.array(keep))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "run", "doc", "shift", "early", "later"])

    found = _in_blocks(parts, each, "key long, run binary, doc long, shift long, early array<long>, later array<long>", limit, block)
    moved = lambda c: F.transform(c, lambda m: m + F.col("shift") * SPAN).alias(c)
    return found.select("key", "run", "doc", moved("early"), moved("later"))


def _parts(rows: DataFrame, bitmap, window: int, gram: int, limit: int) -> DataFrame:  # noqa: ANN001
    """(part, key, run, doc, last, shift, segment) of runs that may share a window, parted by key; those of keys with over ``limit`` of them window by window.

    key and run are null where they are the part's and the segment's own. A class comes as often as chunks of texts have it.
    """
    classes = cut(_classes(rows, bitmap, window, gram))
    # keys within one document lose nothing
    keys = cut(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("last").alias("hi")).where("lo < hi").select("key", "n"))
    live = KeyBitmap(keys, "key").held(classes, "key")
    whole = F.struct(F.col("key").alias("part"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("run"), F.lit(0).cast("long").alias("shift"), "segment")
    hot = cut(keys.where(F.col("n") > limit).select(F.col("key").alias("hot")))
    n = hot.count()
    if not n:
        return live.select("doc", "last", whole.alias("p")).select("p.*", "doc", "last")
    name = F.substring(F.unhex(F.sha2("segment", 256)), 1, DIGEST)

    def piece(i: Column) -> Column:
        bytes_ = F.substring(F.col("segment"), i, F.lit(window))
        return F.struct(F.xxhash64(bytes_).alias("part"), F.col("key"), F.col("run"), (i - 1).cast("long").alias("shift"), bytes_.alias("segment"))

    windows = F.transform(F.sequence(F.lit(1), F.length("segment") - (window - 1)), piece)
    told = live.join(F.broadcast(hot) if n < 1 << 16 else hot, F.col("key") == F.col("hot"), "left").withColumn("run", F.when(F.col("hot").isNotNull(), name))
    return told.select("doc", "last", F.explode(F.when(F.col("hot").isNull(), F.array(whole)).otherwise(windows)).alias("p")).select("p.*", "doc", "last")


def _repeated(df: DataFrame, rows: DataFrame, window: int, gram: int, width: int):  # noqa: ANN202
    """The broadcast bitmap of keys of ``rows`` that may occur twice, two bits for each run that the texts of ``df`` will give."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, runs in _runs(batch.column(0), window, gram):
            yield runs.key

    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = width_for(2 * total // max(1, (window - gram + 2) // 2), width)
    return df.sparkSession.sparkContext.broadcast(key_bits(rows.select("text"), keys, bits, least=2))


def _asked(staged: DataFrame, width: int):  # noqa: ANN202
    """The broadcast bitmap of the classes (key, run) of a cut table."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _told(batch.column(0).to_numpy(), batch.column(1))

    return staged.sparkSession.sparkContext.broadcast(key_bits(staged.select("key", "run"), keys, width_for(16 * staged.count(), width)))


def byte_marks(df: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = WIDTH, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(doc, row, marks) for the rows of (doc, row, text) that lose bytes."""
    narrow = df.select("doc", "row", F.sha2("text", 256).alias("digest"))
    # a table of its own: the join's sides are then both dealt anew, and Spark can split a digest that very many rows have
    first = cut(narrow.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first < final"))
    copies = cut(narrow.join(first, "digest").where("doc > first").select("doc", "row").distinct())
    rows = without(df.select("doc", "row", "text"), copies, [F.col("doc"), F.col("row")])
    bitmap = _repeated(df, rows, window, gram, width)
    mark = cuts_so_far(df.sparkSession)
    parts = _marked(_parts(rows, bitmap, window, gram, limit), window, limit, block)
    until = cuts_so_far(df.sparkSession)
    staged = cut(parts)
    drop_cuts(df.sparkSession, mark, until)
    named = staged.select("key", "run", F.col("doc").alias("first"), "early", "later")
    places = _postings(rows, bitmap, window, gram, _asked(staged, width)).join(named, ["key", "run"])
    marks = F.transform(F.when(F.col("doc") > F.col("first"), F.col("later")).otherwise(F.col("early")), lambda m: F.col("start") * SPAN + m)
    # a set: rows that repeat say the same
    spans = places.select("doc", "row", F.explode(marks).alias("mark")).groupBy("doc", "row").agg(F.collect_set("mark").alias("marks"))
    return spans.union(copies.select("doc", "row", F.array(F.lit(-1).cast("long")).alias("marks")))


def _rows(df: DataFrame) -> DataFrame:
    """(doc_id, doc, row, text): doc ranks null ids last; with it, a hash of the text names a row."""
    doc_id = F.col("doc_id").cast("long")
    rows = df.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("row"), "text")


def repeat_groups(df: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = WIDTH, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(group, length, doc_id, start): the maximal repeats of (doc_id, text) over documents, each with all its occurrences, in bytes.

    A repeat is maximal within the runs that its windows fall into, so one of over 76 bytes comes as several that overlap; ``group`` is a digest
    of its bytes. Repeats within one document alone are left out. Null ids are one document.
    """
    rows = _rows(df).select("doc", "row", "text")
    bitmap = _repeated(rows, rows, window, gram, width)

    def each(t: pa.Table) -> Iterator[pa.RecordBatch]:
        found = Repeats(t, window)
        text, offset = found.array.text[found.at], found.array.offset[found.at]
        length = np.repeat(found.length, found.sizes)
        keep = ~found.late[text]  # the second text of a class occurs wherever the first does
        text, offset, length = text[keep], offset[keep], length[keep]
        if not len(text):
            return
        body, begin = found.body.tobytes(), found.offs[text] + offset
        group = [_named(body[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
        key, run, shift = _owners(t, found.of[text])
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.binary()), pa.array(length), key, run, pa.array(offset + shift)], ["group", "length", "key", "run", "offset"])

    schema = "group binary, length long, key long, run binary, offset long"
    found = cut(_in_blocks(_parts(rows, bitmap, window, gram, limit), each, schema, limit, block).distinct())
    places = _postings(rows, bitmap, window, gram, _asked(found, width)).join(found, ["key", "run"])
    doc_id = F.when(F.col("doc") != _LAST, F.col("doc"))
    return places.select(F.lower(F.hex("group")).alias("group"), "length", doc_id.alias("doc_id"), (F.col("start") + F.col("offset")).alias("start")).distinct()


def dedup_bytes(df: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = WIDTH, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per row of (doc_id, text)."""
    rows = _rows(df)
    marks = byte_marks(rows.select("doc", "row", "text"), window, gram, width, limit, block)
    joined = left_joined(rows, cut(marks), "doc", "row").select("doc_id", "text", "marks")

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for text, found in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                data = text.as_py()
                removed = spans = 0
                if found.is_valid:
                    at = found.values.to_numpy()
                    edge = np.zeros(len(data) + 1, np.int64)
                    if len(at) and at[0] < 0:
                        edge[0], edge[-1] = (1, -1) if len(data) >= window else (0, 0)
                    else:
                        np.add.at(edge, at // SPAN, 1)
                        np.add.at(edge, at // SPAN + at % SPAN, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
                    data_kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                else:
                    data_kept = data
                out.append((len(data), removed, spans, hashlib.sha256(data_kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return each

    return map_batches(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))


#: DuckDB's version over the hexadecimal bytes.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS b FROM documents),
p AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS doc, unnest(range(strlen(b) // 2)) AS i, b FROM d),
x AS (SELECT r, doc, i, b[2 * i + 1 : 2 * i + 2] AS byte, CASE WHEN 2 * i + 100 <= strlen(b) THEN md5(b[2 * i + 1 : 2 * i + 100]) END AS h FROM p),
f AS (SELECT r, i, byte, h IS NOT NULL AND doc > min(doc) OVER (PARTITION BY h) AS later FROM x),
c AS (SELECT *, max(later::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM c)
SELECT doc_id, (strlen(b) // 2)::BIGINT AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
  sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN e USING (r) GROUP BY r, doc_id, b
"""
