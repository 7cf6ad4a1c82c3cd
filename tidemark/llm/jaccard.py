"""Near copies by the Jaccard similarity of word shingles: SimHash anchors propose, an exact set-similarity join finds the rest.

Two texts are linked if the sets of their five-word shingles (A to Z lower-cased) have a Jaccard similarity of 4/5 or more.

1. The SimHash operator (``simhash``, five-word shingles, 3 bits) puts close fingerprints into components through its covering
   anchors; each member is held against the smallest of its component on the whole texts. That settles large groups of near copies cheaply,
   but SimHash at 3 bits sees only a small part of the pairs at 4/5, so an exact step follows.
2. In any one order of all shingles, the least shingle that two such sets share is among the first ``n - ceil(4n/5) + 1`` of
   each (n its size): only that prefix of each set matters, and every pair that is similar enough meets by a key.
   The order puts common shingles last. Which ones count as common is estimated, but it is the same for all texts, so that it
   decides about speed alone. Keys of a single id end in a partial aggregate; rows of the others alone, told by a bounded bitmap (``keybits``), leave Python and are joined.
   Whatever two sets share comes after the least shingle they share, in both orders: a pair that meets by a key too late in either for what is left to
   be enough is no pair by that key. Nor is one whose sets differ by more than similarity allows by their parity bitmaps (a bucket's parity differs only
   if some shingle of one set alone is in it). Both hold for every pair that is similar enough; what passes is checked on the whole texts.

So that a group of near copies doesn't cost the square of its size, the rows of a key are first compared with its least and
greatest id alone (whatever that misses comes again); after that all pairs that meet are, but those already in one component.
No window gathers a key's rows: aggregates and joins do, which Spark splits where a key is hot.

Texts of fewer than five words make one shingle; null texts and texts without a word are alike. Very long texts are whole, in one task
each. Rows with a null doc_id have no links. Ids that repeat over different texts are different documents (see ``with_nodes``).
Repeated rows change nothing. Of pairs at equal similarity all are links. An empty table has none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KeyBitmap, cut, dealt, map_batches, small_batches, texts_of
from tidemark.llm.components import components
from tidemark.llm.keybits import key_bits, long_keys, passed, width_for
from tidemark.llm.simhash import near_components, shingle_hashes

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, TOP, BOTTOM = 5, 4, 5
#: Hashes that a task counts at a time, and the bound on the common shingles that are put last.
FLUSH, MOST_COMMON = 1 << 20, 1 << 18
#: Rows of texts that a Python worker unpacks at a time.
SLICE = 256
#: Words of 64 bits in a set's parity bitmap.
PARITY = 8
#: log2 of the bits of the bitmap of keys that several ids have: 16 MB at most.
WIDTH = 27


def shingles(text: bytes) -> set[bytes]:
    """The set of runs of ``SHINGLE`` words; one shingle for fewer."""
    words = text.lower().split()
    return {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}


def similar(x: set[bytes], y: set[bytes]) -> bool:
    both = len(x & y)
    return BOTTOM * both >= TOP * (len(x) + len(y) - both)


def _hashes(text: bytes) -> np.ndarray:
    """A hash of each shingle, as a signed long, each once."""
    found = np.unique(shingle_hashes(text, SHINGLE)).view(np.int64)
    return found if len(found) else np.zeros(1, np.int64)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are seen to be common, sorted, and how often: a bounded number, the most common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1]), pa.array(n[n > 1])], ["key", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                held += map(_hashes, texts_of(batch.column(1).slice(at, SLICE)))
                if sum(map(len, held)) >= FLUSH:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    small_batches(docs.sparkSession)
    told = cut(docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 8"))
    total, least = 0, None
    for level, n in sorted(told.groupBy(F.floor(F.log2("n"))).count().collect(), reverse=True):
        total += n
        if total > MOST_COMMON:
            break
        least = 1 << int(level)
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = told.where(F.col("n") >= least).toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


_BITS = [f"p{k}" for k in range(PARITY)]
_WIDE = ["key", "id", "n", "i", *_BITS]


def _parity(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * ``PARITY`` buckets: whether an odd number of the hashes is in it."""
    buckets = (hashes.view(np.uint64) % np.uint64(64 * PARITY)).astype(np.int64)
    return np.packbits(np.bincount(buckets, minlength=64 * PARITY) & 1, bitorder="little").view("<i8")


def _prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], asked: np.ndarray | None = None) -> DataFrame:
    """(key, id): a row for each shingle of each set's prefix. With a bitmap of keys only those it lets through, and with n, i, p0, ..: the size of the
    whole set, the shingle's place in its order from 0, and the set's parity bitmap."""
    wide = asked is not None
    shared = docs.sparkSession.sparkContext.broadcast((*common, asked))

    def make():  # noqa: ANN202
        keys, counts, asked = shared.value

        def prefix(text: bytes) -> tuple[np.ndarray, int, np.ndarray | None]:
            found = _hashes(text)
            n = len(found)
            rank = np.zeros(n, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                rank = np.where(keys[at] == found, counts[at], 0)
            return found[np.lexsort((found, rank))[: n - (TOP * n + BOTTOM - 1) // BOTTOM + 1]], n, _parity(found) if wide else None

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, SLICE):
                yield prefixes(batch.slice(at, SLICE))

        def prefixes(some: pa.RecordBatch) -> pa.RecordBatch:
            held = [prefix(t) for t in texts_of(some.column(1))]
            sizes = [len(x) for x, _, _ in held]
            columns = [np.concatenate([x for x, _, _ in held]), np.repeat(some.column(0).to_numpy(), sizes)]
            if wide:
                columns += [np.repeat(np.array([n for _, n, _ in held], np.int32), sizes), np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])]
                which = np.flatnonzero(passed(columns[0].view(np.uint64), asked))
                text = np.repeat(np.arange(len(held)), sizes)[which]
                columns = [c[which] for c in columns] + list(np.stack([p for _, _, p in held])[text].T)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], _WIDE if wide else _WIDE[:2])

        return each

    return map_batches(docs, make, ", ".join(f"{c} {'int' if c in ('n', 'i') else 'long'}" for c in (_WIDE if wide else _WIDE[:2])))


def _checked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of a cut table whose texts are similar enough."""
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = KeyBitmap(ids, "id").held(docs, "id")
    x = texts.select(F.col("id").alias("x_id"), F.col("text").alias("x_text"))
    y = texts.select(F.col("id").alias("y_id"), F.col("text").alias("y_text"))
    # a last: a text that is compared with many comes in rows that follow each other
    rows = dealt(dealt(pairs).join(y, F.col("b") == F.col("y_id"))).join(x, F.col("a") == F.col("x_id"))

    def make():  # noqa: ANN202
        last: tuple[bytes | None, set[bytes]] = (None, set())

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal last
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                good = []
                for p, q in zip(texts_of(some.column(2)), texts_of(some.column(3)), strict=True):
                    if p != last[0]:
                        last = (p, shingles(p))
                    good.append(similar(last[1], shingles(q)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"]).filter(pa.array(good))

        return each

    return map_batches(rows.select("a", "b", "x_text", "y_text"), make, "a long, b long")


def _hopeful() -> Column:
    """Whether sets x and y could be similar enough if the shingle at x_i and y_i is the least they share: all they share is from there on, and
    no more shingles are in one of them alone than similarity allows (at least as many as there are buckets whose parity differs)."""
    sizes, weight = F.col("x_n") + F.col("y_n"), TOP + BOTTOM
    shared = (weight * (F.col("x_n") - F.col("x_i")) >= TOP * sizes) & (weight * (F.col("y_n") - F.col("y_i")) >= TOP * sizes)
    apart = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in _BITS), F.lit(0))
    return shared & (weight * apart <= (BOTTOM - TOP) * sizes)


def _proposed(docs: DataFrame) -> DataFrame:
    """(a, b): each member of a SimHash component with the smallest of it."""
    found = near_components(docs.select(F.col("id").alias("doc_id"), "text"), SHINGLE)
    return found.where("component_id < doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _apart(met: DataFrame, one: DataFrame) -> DataFrame:
    """Rows of ``met`` with their part, of the keys whose rows are not all in one component (node, label) yet."""
    part = cut(met.join(dealt(one), F.col("id") == F.col("node"), "left").select(*_WIDE, "lo", "hi", F.coalesce("label", "id").alias("part")).distinct())
    open_ = part.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    return cut(part.join(dealt(open_), "key", "left_semi"))


def _met_by(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b), a < b: documents of x and y that meet by a key, are in different parts, and could be similar enough if that is the first they share."""
    x, y = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in (*_WIDE, "part")]) for side, df in (("x", x), ("y", y)))
    met = (F.col("x_key") == F.col("y_key")) & (F.col("x_id") < F.col("y_id")) & (F.col("x_part") != F.col("y_part")) & _hopeful()
    return x.join(dealt(y), met).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def near_copies(df: DataFrame) -> DataFrame:
    """(node, label): for each doc_id of (doc_id, text) that is linked to a smaller one, however far, the smallest such."""
    docs = df.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL")
    links = cut(_checked(cut(_proposed(docs)), docs))
    common = _common(docs)
    ends = cut(_prefixes(docs, common).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"))
    asked = key_bits(ends.select("key"), long_keys, width_for(16 * ends.count(), WIDTH))
    met = cut(_prefixes(docs, common, asked).join(dealt(ends), "key"))
    # the proposed links are stars around the smallest of each, no node in two of them: components as they are
    apart = _apart(met, links.select(F.col("b").alias("node"), F.col("a").alias("label")))
    tried = cut(_met_by(apart.where("id = lo"), apart).union(_met_by(apart, apart.where("id = hi"))).distinct())
    one = cut(components(links.union(_checked(tried, docs))))
    last = _apart(met, one)
    more = cut(_checked(cut(_met_by(last, last).join(dealt(tried), ["a", "b"], "left_anti")), docs))
    return one if more.isEmpty() else components(one.select(F.col("label").alias("a"), F.col("node").alias("b")).union(more))


def with_nodes(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a long ``name`` that tells its documents apart, and what stands for what where that is not the id itself.

    An id that comes with several texts is several documents: each (id, text) gets a number below all ids. The second result has
    (node, doc_id, text_sha256) of those, or is None where ids tell all apart. Null ids stay null.
    """
    node, digest = F.col("doc_id").cast("long"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    narrow = docs.where(node.isNotNull()).groupBy(node.alias("id")).agg(F.min(F.xxhash64(digest)).alias("lo"), F.max(F.xxhash64(digest)).alias("hi"))
    twice = cut(narrow.where("lo != hi").select("id"))
    if twice.isEmpty():
        return docs.withColumn(name, node), None
    bitmap = KeyBitmap(twice, "id")
    ids = twice.withColumnRenamed("id", "tm_id__")
    several = bitmap.held(docs, node).join(ids, node == F.col("tm_id__"), "left_semi").select(node.alias("id"), digest.alias("sha")).distinct()
    least = docs.agg(F.min(node)).first()[0]
    if least < -(1 << 62):
        raise ValueError("ids that repeat over different texts need free numbers below the smallest id")
    surrogates = cut(several.select((F.lit(least - 1) - F.monotonically_increasing_id()).alias("node"), F.col("id").alias("doc_id"), F.col("sha").alias("text_sha256")))
    told = F.broadcast(surrogates) if surrogates.count() < 1 << 16 else surrogates
    told = told.select(F.col("node").alias("tm_node__"), F.col("doc_id").alias("tm_id__"), F.col("text_sha256").alias("tm_sha__"))
    alone = bitmap.others(docs, node).withColumn(name, node)
    held = bitmap.held(docs, node).join(told, (node == F.col("tm_id__")) & (digest == F.col("tm_sha__")), "left")
    held = held.select(*docs.columns, F.coalesce("tm_node__", node).alias(name))
    return alone.union(held), surrogates


def near_gone(docs: DataFrame, node: str, surrogates: DataFrame | None) -> DataFrame:
    """(node): documents of (``node``, text) that another document of their group stands for: that with the smallest id, then digest."""
    found = near_copies(docs.select(F.col(node).alias("doc_id"), "text"))
    if surrogates is None:
        return found.select("node")
    found = cut(found)
    members = found.union(found.select("label", "label")).distinct()
    told = members.join(surrogates, "node", "left").select("node", "label", F.struct(F.coalesce("doc_id", "node").alias("id"), "text_sha256", "node").alias("who"))
    best = told.groupBy("label").agg(F.min("who").alias("best"))
    return told.join(best, "label").where("who != best").select("node")
