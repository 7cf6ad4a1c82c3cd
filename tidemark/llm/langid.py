"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword; one binary n-gram classifier (smoothed log-odds of hashed byte trigrams) learns each
bit. A text's margin for a bit is its mean log-odds. Decoding adds the logistic loss of every bit's margin against each
codeword and takes the least; the score is the winner's share of the softmax of the losses, and a text whose runner-up
is close is flagged as ambiguous. Codewords only tell languages apart, so every text also gets an absolute fit: its mean log-likelihood a
trigram in the language predicted, against one of equally likely trigrams. Below zero the text is in none of the learned languages.

Training reads whole texts of a stratified sample of labelled rows: about ``per_language`` (a documented bound) of
each language, picked by a hash of the id; more than ``most_languages`` labels are an error. Prediction covers every row.
Null texts and texts without a letter are ``und`` with score 0; so is everything where nothing was learned. Rows with a null id
are never learned from and count as held out. Of codewords at equal loss the first language by name wins. Very long texts are whole, some
30 bytes of memory a byte in one task. Repeated rows are repeated in the result; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import concatenated, table
from tidemark.llm.windows import chunks

BUCKETS = 1 << 16
#: ASCII letters in lower case, other ASCII as the space, the rest as it is.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
#: Steepness of the loss, and the score below which a text is ambiguous.
STEEP, CLEAR = 4.0, 0.6


def grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of texts (each between two spaces), and where each text's begin; a text of n bytes has n.

    No trigram reaches into the next text, so that a text's trigrams do not depend on its neighbours.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    held = np.full(int(offsets[-1]) + n + 2, 32, np.uint8)
    held[np.arange(int(offsets[-1])) + np.repeat(np.arange(n) + 1, sizes)] = _FOLD[body]
    wide = held.astype(np.uint32)
    triples = (wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
    own = np.ones(len(triples), bool)
    own[offsets[1:] + np.arange(n)] = False  # (last byte, space, first byte of the next text)
    return (triples[own] >> np.uint32(16)).astype(np.int64), offsets[:-1]


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits of up to five languages, else the best of 200 seeded draws by least distance."""
    if n <= 1:
        return np.ones((n, 1), np.int64)
    if n <= 5:
        bits = [[1 if k == 0 or not pattern >> (k - 1) & 1 else -1 for k in range(n)] for pattern in range(1, 1 << (n - 1))]
        return np.array(bits, np.int64).T
    rng, best, least = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1]), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min(int((code[i] != code[:i]).sum(1).min()) for i in range(1, n))
        if gap > least:
            best, least = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    #: (buckets, languages): the logarithm of a trigram's share, times the number of buckets.
    logs: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> Model:
        """From n-gram counts by language."""
        languages = sorted(counts)
        code = codewords(len(languages))
        if not languages:
            return cls(languages, code, np.zeros((BUCKETS, 1), np.float32), np.zeros((BUCKETS, 0), np.float32))
        share = np.stack([(counts[x] + 0.1) / (counts[x].sum() + 0.1 * BUCKETS) for x in languages])
        logs = np.log(share.T * BUCKETS).astype(np.float32)
        if len(languages) < 2:
            return cls(languages, code, np.zeros((BUCKETS, 1), np.float32), logs)
        sides = [(share[c > 0].mean(0), share[c < 0].mean(0)) for c in code.T]
        return cls(languages, code, np.stack([np.log(a) - np.log(b) for a, b in sides], 1).astype(np.float32), logs)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """(texts, languages): the logistic loss of all bits against each codeword."""
        return np.logaddexp(0, -STEEP * margins[:, None, :] * self.code[None]).sum(2)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score, and whether the text is ambiguous."""
        loss = self.losses(margins)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        return best, score, score < CLEAR


def _counts(sample: DataFrame) -> dict[str, np.ndarray]:
    """N-gram counts by language of a bounded sample (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            body, offs = concatenated(batch.column(1))
            for k, name in enumerate(names):
                found, _ = grams(body[offs[k] : offs[k + 1]], np.array([0, offs[k + 1] - offs[k]]))
                held[name] = held.get(name, 0) + np.bincount(found, minlength=BUCKETS)
        rows = [{"lang": k, "counts": v.astype(np.int64).tobytes()} for k, v in held.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    out: dict[str, np.ndarray] = {}
    for row in sample.select("lang", "text").repartition(8).mapInArrow(run, "lang string, counts binary").toLocalIterator():
        out[row["lang"]] = out.get(row["lang"], 0) + np.frombuffer(bytes(row["counts"]), np.int64)
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """One fifth of the ids, by CRC-32 of their decimal text; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(df: DataFrame, per_language: int = 1500, most_languages: int = 256) -> Model:
    """Learn from the rows (doc_id, text, lang) that are labelled and not held out; the driver holds the n-gram counts of each label, hence the bound."""
    known = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"there are more than {most_languages} languages among the labels")
    if not sizes:
        return Model.fit({})
    span = 1 << 30
    keep = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, per_language / r["count"]) * span))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    return Model.fit(_counts(known.where(draw < F.coalesce(F.try_element_at(keep, F.col("lang")), F.lit(0)))))


def _scored(m: Model, texts: pa.Array, letters: np.ndarray) -> list[pa.Array]:
    """lang_pred, score, ambiguous and fit of texts, given which have a letter."""
    names = np.array([*m.languages, "und"], object)
    body, offs = concatenated(texts)
    n = len(texts)
    best, score, unsure, fit = np.full(n, -1), np.zeros(n), np.ones(n, bool), np.zeros(n)
    for i, j in chunks(offs):
        found, starts = grams(body[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        edges = np.append(starts, len(found))
        for a in range(0, j - i, 4096) if m.languages else ():
            b = min(a + 4096, j - i)
            own, sizes = found[edges[a] : edges[b]], np.diff(edges[a : b + 1])
            full = np.flatnonzero(sizes)  # an empty text has no trigram, and reduceat would give it its neighbour's
            if len(full):
                at, where = starts[a:b][full] - edges[a], i + a + full
                mean = lambda x: np.add.reduceat(x, at, axis=0).astype(np.float64)  # noqa: B023, E731
                best[where], score[where], unsure[where] = m.decode(mean(m.weights[own]) / sizes[full, None])
                fit[where] = mean(m.logs[own, np.repeat(best[where], sizes[full])]) / sizes[full]
    best, score, fit = np.where(letters, best, -1), np.where(letters, score, 0.0), np.where(letters, fit, 0.0)
    return [pa.array(names[best], pa.string()), pa.array(score), pa.array(unsure | ~letters), pa.array(fit)]


def with_language(df: DataFrame, model: Model, out: str = "language") -> DataFrame:
    """The same rows and columns with a struct (lang_pred, score, ambiguous, fit) for the column ``text``."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.code, model.weights, model.logs))

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean, fit: double>")
    def told(texts: pa.Array, letters: pa.Array) -> pa.Array:
        found = _scored(Model(*shared.value), texts, letters.to_numpy(zero_copy_only=False).astype(bool))
        return pa.StructArray.from_arrays(found, ["lang_pred", "score", "ambiguous", "fit"])

    text = F.col("text").cast("string")
    return df.withColumn(out, told(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))))


def predict(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous, fit) of every row of (doc_id, text)."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_language(rows, model).select("doc_id", "language.lang_pred", "language.score", "language.ambiguous", "language.fit")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous", "fit")
