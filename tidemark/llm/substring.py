"""Substring deduplication by words: windows of 35 words that start more than once anywhere are cut out.

1. Every window is filed under the least hash of its 8-word runs, which equal windows share; neighbouring windows mostly
   have the same, so a document's windows fall into runs under one key. Partition sketches count the keys of runs (twice where a
   run may hold equal windows) and merge. If a window starts twice, its key is counted twice at least, so no repeated window is
   missed; an estimate above one says only that the windows under a key may repeat.
2. Only runs whose key is estimated as repeated go on. From here on words are compared, not rolling hashes: a run and each of its windows
   are named by a 128-bit cryptographic digest of their words, one space between each two. Equal runs become one class with a count,
   first within a batch, then by a partial aggregate, so that hot passages shrink before the shuffle. Windows of a class
   with a count above one are repeated; those of the others are grouped exactly on their digest.
3. The flagged windows go back to their rows, named by id and a hash of the text, and each word covered by one is removed.

Null and empty texts have no words; documents shorter than a window lose nothing. Very long texts are whole: one is a chunk of its own, at
some 100 bytes of memory a byte in its task. Repeated rows count as occurrences like any other, and so do ties: all starts of a
repeated window go, there is no first one that stays. Null ids are allowed. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KeyBitmap, concatenated, cut, left_joined, map_batches, table
from tidemark.llm.countmin import estimated_repeated, fitting_width, repeated_cells
from tidemark.llm.windows import chunks, rolling, single_spaced, sliding_min, spaced, word_hashes, words_of

WINDOW, GRAM, WIDTH = 35, 8, 28
#: Bytes of text for each run, about; bytes of a digest.
RUN_BYTES, DIGEST = 80, 16


class Runs:
    """Runs of consecutive windows of one document under one key, over a chunk of texts."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> None:
        body, offsets = spaced(body, offsets)
        starts, ends = words_of(body)
        first = np.searchsorted(starts, offsets)  # first word of each text
        self.words = (body, starts, ends)
        self.window = window
        self.grams, self.reach = rolling(word_hashes(body, starts, ends), gram), window - gram
        keys = sliding_min(self.grams, window - gram + 1)
        n = len(keys)
        inside = np.ones(n, bool)
        for k in range(1, window):  # windows that would reach into the next text
            edge = first[1:-1] - k
            inside[edge[(edge >= 0) & (edge < n)]] = False
        at = np.flatnonzero(inside)
        text = np.searchsorted(first, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (keys[at[1:]] != keys[at[:-1]]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        longest = self.reach + 1  # longer runs repeat their key: pieces of words that recur are then the same few classes
        parts = -(-size // longest)
        if (parts > 1).any():
            piece = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(np.repeat(size, parts) - piece * longest, longest)
            start = np.repeat(start, parts) + piece * longest
        self.begin, self.size = at[start], size
        self.key = keys[self.begin]
        self.text = text[start]
        self.start = self.begin - first[self.text]

    def keep(self, which: np.ndarray) -> Runs:
        self.begin, self.size, self.key, self.text, self.start = (x[which] for x in (self.begin, self.size, self.key, self.text, self.start))
        return self

    def self_similar(self) -> np.ndarray:
        """Whether a run's key occurs twice in its own words; only then can two of its windows be equal."""
        spans = self.size + self.reach
        if not len(spans):
            return np.zeros(0, bool)
        first = np.cumsum(spans) - spans
        within = np.arange(int(spans.sum())) - np.repeat(first, spans)
        same = self.grams[np.repeat(self.begin, spans) + within] == np.repeat(self.key, spans)
        return np.add.reduceat(same.astype(np.int64), first) > 1

    def digests(self, which: np.ndarray | None = None) -> list[bytes]:
        """A digest of the words of each run, and so of the sequence of its windows; of those at ``which`` where given."""
        text, first = self._text()
        begin, size = (self.begin, self.size) if which is None else (self.begin[which], self.size[which])
        ends = first[begin + size + self.window - 1] - 1
        return [_digest(text[a:b]) for a, b in zip(first[begin].tolist(), ends.tolist(), strict=True)]

    def window_digests(self, which: np.ndarray) -> list[bytes]:
        """Digests of the windows of the runs at ``which``, end to end."""
        text, first = self._text()
        sizes = self.size[which]
        at = np.repeat(self.begin[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return [_digest(text[a:b]) for a, b in zip(first[at].tolist(), (first[at + self.window] - 1).tolist(), strict=True)]

    def _text(self) -> tuple[bytes, np.ndarray]:
        if isinstance(self.words[0], np.ndarray):
            text, first = single_spaced(*self.words)
            self.words = (text.tobytes(), first)
        return self.words


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=DIGEST).digest()


def _runs(column: pa.Array, window: int, gram: int) -> Iterator[tuple[int, Runs]]:
    body, offs = concatenated(column)
    for i, j in chunks(offs):
        yield i, Runs(body[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window, gram)


def row_hash() -> Column:
    """With the id this names a row; equal rows share it, and what holds for one holds for the other."""
    return F.xxhash64("text")


_BINARY = pa.binary()


def _classes(rows: DataFrame, bitmap, window: int, gram: int, width: int) -> DataFrame:  # noqa: ANN001
    """(key, run, n, twice, windows): a chunk's distinct candidate runs, how often each occurs in it, whether a window occurs twice in the run, and their digests."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, runs in _runs(batch.column(1), window, gram):
                runs.keep(estimated_repeated(runs.key, bitmap.value, width))
                if not len(runs.key):
                    continue
                seen: dict[bytes, int] = {}
                counts: list[int] = []
                chosen: list[int] = []
                for k, run in enumerate(runs.digests()):
                    at = seen.setdefault(run, len(counts))
                    if at == len(counts):
                        counts.append(0)
                        chosen.append(k)
                    counts[at] += 1
                where = np.array(chosen)
                ends = np.append(0, np.cumsum(runs.size[where]))
                windows = runs.window_digests(where)
                twice = [len(set(windows[a:b])) < b - a for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs.key[where].view(np.int64)), pa.array(list(seen), _BINARY), pa.array(counts, pa.int64()), pa.array(twice, pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(windows, _BINARY)),
                    ],
                    ["key", "run", "n", "twice", "windows"],
                )

        return each

    return map_batches(rows.select("doc_id", "text"), make, "key long, run binary, n long, twice boolean, windows array<binary>")


def _postings(rows: DataFrame, bitmap, window: int, gram: int, width: int) -> DataFrame:  # noqa: ANN001
    """(key, run, doc_id, row, start, size): where candidate runs are; start counts words."""

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            names = batch.column(2).to_numpy()
            for i, runs in _runs(batch.column(1), window, gram):
                runs.keep(estimated_repeated(runs.key, bitmap.value, width))
                if len(runs.key):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(runs.key.view(np.int64)), pa.array(runs.digests(), _BINARY), batch.column(0).take(pa.array(i + runs.text)), pa.array(names[i + runs.text]),
                            pa.array(runs.start.astype(np.int32)), pa.array(runs.size.astype(np.int32)),
                        ],
                        ["key", "run", "doc_id", "row", "start", "size"],
                    )

        return each

    return map_batches(rows.select("doc_id", "text", "row"), make, "key long, run binary, doc_id long, row long, start int, size int")


def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = WIDTH) -> DataFrame:
    """(doc_id, row, spans): for each row of (doc_id, text, row = ``row_hash``) the (start, size, at) of its repeated windows, in words.

    ``at`` lists the repeated windows of a run by offset; null means all ``size`` of them.
    """
    spark = rows.sparkSession

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, runs in _runs(batch.column(1), window, gram):
            yield runs.key
            yield runs.key[runs.self_similar()]

    width = fitting_width(rows, RUN_BYTES, width)
    bitmap = spark.sparkContext.broadcast(repeated_cells(rows, keys, width))
    found = _classes(rows, bitmap, window, gram, width).groupBy("key", "run")
    merged = cut(found.agg(F.sum("n").alias("n"), F.first("twice").alias("twice"), F.first("windows").alias("windows")))
    # keys that the sketch took for repeated and that occur once after all end here
    again = cut(merged.groupBy("key").agg(F.sum("n").alias("n"), F.bool_or("twice").alias("twice")).where("n > 1 OR twice").select("key"))
    classes = KeyBitmap(again, "key").held(merged, "key")
    flat = classes.select("key", "run", "n", F.posexplode("windows").alias("at", "window"))
    several = flat.groupBy("key", "window").agg(F.sum("n").alias("times")).where("times > 1").select("key", "window")
    once = flat.where("n = 1").join(several, ["key", "window"], "left_semi").groupBy("key", "run").agg(F.collect_list("at").alias("at"))
    flagged = classes.where("n > 1").select("key", "run", F.lit(None).cast("array<int>").alias("at")).unionByName(once)
    places = _postings(rows, bitmap, window, gram, width).join(flagged, ["key", "run"])
    # a set: rows that repeat say the same
    return places.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "size", "at")).alias("spans"))


def dedup_substrings(df: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, one row per row of (doc_id, text)."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", row_hash())
    spans = cut(repeated_windows(rows, window, gram, width))
    joined = left_joined(rows, spans, "doc_id", "row").select("doc_id", "text", "spans")

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column(1).cast(pa.large_binary())
            kept, total, removed = [], [], []
            for text, spans in zip(texts, batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                total.append(len(words))
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans.as_py():
                        if s["at"] is None:
                            edge[s["start"]] += 1
                            edge[s["start"] + s["size"] - 1 + window] -= 1
                        else:
                            at = s["start"] + np.array(s["at"], np.int64)
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

        return each

    return map_batches(joined, make, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB's version: windows as digests of their words, covered positions by a moving maximum.
OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
x AS (SELECT *, CASE WHEN i + 34 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM p),
f AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM x),
c AS (SELECT *, max(again::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f)
SELECT doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (r) GROUP BY r, doc_id, w
"""
