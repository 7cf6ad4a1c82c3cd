"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once; at each position its output links give all pieces that end there, and each relaxes
the best score of that position. A character that no piece covers costs the least score less 10 and becomes byte
pieces. Ties go to the longest last piece. Spaces become U+2581 and one goes in front. A U+2581 of the text itself is
always spelt in bytes, so decoding gives every text back exactly.

No piece of the given vocabularies continues past a word's end, so the best path of a text is the best paths of its words
end to end; words seen before come from a bounded memory. A vocabulary with pieces across words is decoded without cuts.

Null texts count as empty; empty texts have no tokens. Very long texts are whole; one without spaces takes some 300 bytes of memory a
character in its task. Rows with null ids and repeated rows pass through; an empty table gives an empty one; other columns are ignored.
The model file is a parameter; it is read on the driver, and its pieces (a fixed size) go to the executors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, UNKNOWN_COST = "▁", 10.0
#: Bytes of words and their ids that a task remembers, about, and characters of a word that is remembered at most.
REMEMBERED, LONGEST, ENTRY = 48 << 20, 64, 170
#: Stands for a U+2581 of the text while it is encoded: a lone surrogate, which no UTF-8 text holds.
_LITERAL = "\ud800"


def read_model(path: str) -> tuple[list[str], list[float], list[str]]:
    """Pieces, scores and kinds (normal, byte, other) of a model file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal" for i in ids]
    return [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], kinds


class Pieces:
    """Encoder and decoder of one vocabulary; scores of user-defined pieces are taken as they are."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        normal = [(p, k) for k, p in enumerate(pieces) if kinds[k] == "normal"]
        for p, k in normal:
            self.automaton.add_word(p, (len(p), scores[k], k))
        self.automaton.make_automaton()
        self.unknown = min((scores[k] for _, k in normal), default=0.0) - UNKNOWN_COST
        self.singles = {p for p, _ in normal if len(p) == 1}
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(pieces) if kinds[k] == "byte"}
        self.other = next((k for k, x in enumerate(kinds) if x == "other"), 0)
        spelt = {k: bytes([b]) for b, k in self.bytes.items()}
        self.spelling = [spelt.get(k, p.replace(MARK, " ").encode() if kinds[k] == "normal" else b"") for k, p in enumerate(pieces)]
        cut = "".join(c for c in "\n\t\r\x0b\x0c" + _LITERAL if not any(c in p and len(p) > 1 for p, _ in normal))
        # letters end before a mark that no piece joins to a letter: words are then the same with and without it
        apart = "".join(c for c in ".,;:!?" if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p, _ in normal))
        letters = rf"{MARK}*[^\W\d_]++(?=[{re.escape(apart)}])|" if apart else ""
        words = f"{letters}{MARK}*[^{MARK}{re.escape(cut)}]+|{MARK}+|[{re.escape(cut)}]"
        self.words = None if any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in normal) else re.compile(words)
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def best_path(self, text: str) -> list[int]:
        """Viterbi over a text whose spaces are marks already."""
        n = len(text)
        best, back = [0.0] + [-1e300] * n, [(0, -1)] * (n + 1)
        singles, unknown, done = self.singles, self.unknown, 0
        if singles.issuperset(text):  # every position is reached by a piece
            for last, (size, score, k) in self.automaton.iter(text):
                total = best[last + 1 - size] + score
                if total > best[last + 1]:
                    best[last + 1], back[last + 1] = total, (size, k)
            return self._walk(text, back)
        for last, (size, score, k) in self.automaton.iter(text):
            for end in range(done, last):  # positions passed without a match, or whose matches are all seen
                self._cover(text, end, best, back, singles, unknown)
            done = max(done, last)
            end = last + 1
            total = best[end - size] + score
            if total > best[end]:
                best[end], back[end] = total, (size, k)
        for end in range(done, n):
            self._cover(text, end, best, back, singles, unknown)
        return self._walk(text, back)

    def _walk(self, text: str, back: list[tuple[int, int]]) -> list[int]:
        """Ids of the best path, from the end to the start and turned round."""
        out: list[int] = []
        at = len(text)
        while at:
            size, k = back[at]
            if k < 0:
                spelt = (MARK if text[at - 1] == _LITERAL else text[at - 1]).encode("utf-8", "surrogatepass")
                out += [self.bytes.get(b, self.other) for b in reversed(spelt)]
            else:
                out.append(k)
            at -= size
        return out[::-1]

    @staticmethod
    def _cover(text: str, at: int, best: list[float], back: list[tuple[int, int]], singles: set[str], unknown: float) -> None:
        """Character ``at`` as an unknown one, if no piece is that character alone. All paths to its start are final by now."""
        if text[at] not in singles and best[at] + unknown > best[at + 1]:
            best[at + 1], back[at + 1] = best[at] + unknown, (1, -1)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if MARK in text:
            text = text.replace(MARK, _LITERAL)
        text = MARK + text.replace(" ", MARK)
        memory = self.memory
        if self.held > REMEMBERED:
            memory.clear()
            self.held = 0
        parts = self.words.findall(text) if self.words else [text]
        out = [memory.get(w) for w in parts]
        if None in out:
            for k, w in enumerate(parts):
                if out[k] is None and (found := memory.get(w)) is None:
                    found = np.array(self.best_path(w), "<i4").tobytes()
                    if len(w) <= LONGEST:  # a text without spaces is one word: it goes by once
                        memory[w] = found
                        self.held += ENTRY + 2 * len(w) + len(found)
                if out[k] is None:
                    out[k] = found
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; the space in front goes."""
        spelling = self.spelling
        return b"".join([spelling[k] for k in ids])[1:]


def encode_texts(df: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text_sha256, n_chars, ids array<int>) of every row of (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model))

    def make():  # noqa: ANN202
        pieces = Pieces(*shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = texts_of(batch.column(1))
            known = [t.decode("utf-8", "surrogatepass") for t in texts]
            blobs = [pieces.encode(t) for t in known]
            ends = np.cumsum([0] + [len(b) // 4 for b in blobs]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
            digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array([len(t) for t in known], pa.int64()), ids], ["doc_id", "text_sha256", "n_chars", "ids"])

        return each

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, text_sha256 string, n_chars long, ids array<int>")


def decode_ids(df: DataFrame, model: str = MODEL) -> DataFrame:
    """Columns of ``encode_texts`` with what the ids decode to: decoded_sha256, n_tokens, n_byte_tokens, ids_sha256."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model))

    def make():  # noqa: ANN202
        pieces = Pieces(*shared.value)
        is_byte = np.zeros(len(pieces.spelling), bool)
        is_byte[list(pieces.bytes.values())] = True

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            column = batch.column(3)
            offs, flat = column.offsets.to_numpy(), column.values.to_numpy()
            rows = [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
            decoded = [hashlib.sha256(pieces.decode(r.tolist())).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([len(r) for r in rows], pa.int64()), pa.array([int(is_byte[r].sum()) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in rows]), pa.array(decoded, pa.string()), batch.column(1),
                ],
                ["doc_id", "n_chars", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "text_sha256"],
            )

        return each

    return map_batches(
        df.select("doc_id", "text_sha256", "n_chars", "ids"), make,
        "doc_id long, n_chars long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string",
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded again from its ids.

    The vocabulary's scores are those of merges, so ids are the best sum of them and differ from what its own tokenizer merges.
    """
    done = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    return done.withColumn("round_trip", F.col("decoded_sha256") == F.col("text_sha256")).drop("text_sha256")
