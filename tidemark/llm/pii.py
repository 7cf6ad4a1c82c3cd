"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The base patterns find e-mail addresses, IP addresses, card and phone numbers; each runs in time linear in the text. The
field adds ``secret`` spans (passwords, access keys, tokens): it is trained on the driver from a small
labelled table (``labelled_words.tsv`` beside this module, or any DataFrame by ``train_on``), its features are the shapes of a word and of its
neighbours, and Viterbi decodes whole documents in numpy batches, all documents of a batch side by side. Base spans always stay; a secret
that overlaps one is left out. The field's own labels for the base kinds only keep it from taking those words for secrets.

Spans are code points, end exclusive; spans that start together go by kind as listed. Null and empty texts have no spans. Very long texts
are whole, some 100 bytes a word in one task. Rows keep their number; null ids and repeated rows pass through; an empty table gives
an empty one; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from importlib import resources
from importlib.resources.abc import Traversable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, small_batches, table

KINDS = ("email", "ip", "card", "phone", "secret")
# ---- base patterns ----
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
#: Always matches a whole chain, so scanning stays linear: a failed chain is never tried again from its middle.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: No card has more characters: 19 digits with a separator between each two.
_CARD_LONGEST = 37


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, found from each at sign so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:  # local part, in steps so that each character is looked at once
            step = max(done, start - 64)
            piece = text[step:start][::-1]
            got = _LOCAL_BACK.match(piece).end()
            start -= got
            if got < len(piece):
                break
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # nothing that starts before this sign can match
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each chain of numbers; parts above 255 drop the match."""
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(_small(p) for p in four):
                yield at, at + size
            at += size + 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= _CARD_LONGEST:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base patterns, by start, then kind as listed."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in addresses(text)]
        out += [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- word shapes ----
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_SHAPE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 100 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
#: Feature space of hashed shape features, for the word itself and for its two neighbours.
SPACE = 1 << 12
LABELS = ("O", "email", "ip", "card", "phone", "secret")


def shape(data: bytes) -> bytes:
    """Letters become x or X, digits d; other characters, white space among them, stay."""
    return data.translate(_SHAPE)


def shape_features(raw: bytes) -> list[str]:
    """What the field sees of a word: its shape, never the word."""
    runs = _RUNS.sub(rb"\1", raw)
    core = raw.strip(b".,;:!?\"'()[]")
    letters, digits = core.count(b"x") + core.count(b"X"), core.count(b"d")
    switches = min(6, sum(a != b for a, b in zip(runs, runs[1:], strict=False)) // 2)
    lead, _, value = core.partition(b"=" if b"=" in core else b":")
    out = [
        "runs=" + runs[:8].decode("latin-1"),
        f"size={min(len(core), 40) // 4}",
        f"mix={letters > 0}{digits > 0}{min(switches, 4)}{len(core) > 10}",
        f"digits={min(digits, 20)}" if not letters else f"digitshare={4 * digits // max(1, len(core))}",
        f"upper={core.isupper() and letters > 0}{digits > 0}{len(core) > 14}",
        f"marks={b'@' in core}{b'=' in core}{core[:1] == b'+'}{min(3, core.count(b'.'))}",
    ]
    if value:
        out.append(f"value={set(lead) <= {120, 95, 45}}{b'd' in value}{b'x' in value.lower()}{min(len(value), 24) // 6}")
    return out


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("latin-1", "replace"), digest_size=4).digest(), "little") % SPACE


@lru_cache(1 << 16)
def slots(raw: bytes) -> tuple[int, ...]:
    """Features of a word's shape."""
    return tuple(sorted({_slot(f) for f in shape_features(raw)}))


# ---- the field ----
class Field:
    """A linear chain: emissions from a word's, its left and its right neighbour's features, and transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves  # (3, SPACE, labels), (labels + 1, labels): the last row is the start

    def word_scores(self, raw: bytes) -> np.ndarray:
        """(3, labels): what a word's shape says of itself, of its right neighbour and of its left one."""
        return self.weights[:, list(slots(raw))].sum(1)

    def viterbi(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of sequences laid end to end, all decoded side by side, one position at a time."""
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        starts = (np.cumsum(sizes) - sizes)[order]
        lengths = sizes[order]
        out = np.zeros(len(emissions), np.int8)
        if not len(order):
            return out
        back = np.zeros((len(emissions), emissions.shape[1]), np.int8)
        score = emissions[starts] + self.moves[-1]
        moves = self.moves[:-1]
        active = len(order) - np.searchsorted(lengths[::-1], np.arange(lengths[0] + 1), "right")
        for t in range(1, int(lengths[0])):
            n = active[t]
            paths = score[:n, :, None] + moves
            best = paths.argmax(1)
            back[starts[:n] + t] = best
            score[:n] = np.take_along_axis(paths, best[:, None], 1)[:, 0] + emissions[starts[:n] + t]
        last = score.argmax(1)
        out[starts + lengths - 1] = last
        state = last
        for t in range(int(lengths[0]) - 1, 0, -1):
            n = active[t]
            state[:n] = back[starts[:n] + t, state[:n]]
            out[starts[:n] + t - 1] = state[:n]
        return out


#: The small labelled table: invented sentences with personal data, secrets, and numbers that are neither.
LABELLED = resources.files("tidemark.llm") / "labelled_words.tsv"  # there in a zip of the package, too
#: Sentences that the driver trains on at most.
MOST_SENTENCES = 5000


def labelled_sentences(path: Path | Traversable = LABELLED) -> list[list[tuple[bytes, int]]]:
    """Sentences of (word, label) from a file with a word and its label on each line and an empty line after each sentence."""
    out: list[list[tuple[bytes, int]]] = [[]]
    for line in path.read_text(encoding="utf-8").splitlines():
        if line.startswith("# "):
            continue
        if not line:
            out.append([])
            continue
        word, _, label = line.rpartition("\t")
        out[-1].append((word.encode(), LABELS.index(label)))
    return [s for s in out if s]


def train_on(df: DataFrame, most: int = MOST_SENTENCES) -> Field:
    """A field from a labelled table (sentence, position, word, label): the driver reads at most ``most`` sentences, picked by a hash of their name.

    Words or labels that are null and labels outside ``LABELS`` count as ``O``. An empty table is an error.
    """
    ids = df.select("sentence").distinct()
    some = ids.orderBy(F.xxhash64("sentence"), "sentence").limit(most)
    rows = df.join(F.broadcast(some), df["sentence"].eqNullSafe(some["sentence"]), "left_semi").select(F.col("sentence").cast("string").alias("s"), "position", "word", "label")
    held: dict[str | None, list[tuple[int, bytes, int]]] = {}
    for r in rows.toLocalIterator():
        label = LABELS.index(r["label"]) if r["label"] in LABELS else 0
        held.setdefault(r["s"], []).append((r["position"] or 0, (r["word"] or "-").encode(), label))
    if not held:
        raise ValueError("the labelled table has no rows")
    return train([[(w, y) for _, w, y in sorted(held[k])] for k in sorted(held, key=lambda k: (k is not None, k))])


def train(sentences: list[list[tuple[bytes, int]]], rounds: int = 60, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximum likelihood by full-batch Adam; forward and backward sums run over all sentences side by side."""
    n, long, k = len(sentences), max(map(len, sentences)), len(LABELS)
    gold = np.zeros((n, long), np.int64)
    mask = np.zeros((n, long), bool)
    rows: list[int] = []
    cols: list[int] = []
    for i, sentence in enumerate(sentences):
        for t, (word, label) in enumerate(sentence):
            gold[i, t], mask[i, t] = label, True
            for shift in (-1, 0, 1):  # the feature of word t scores position t + shift
                if 0 <= t + shift < len(sentence):
                    got = slots(shape(word))
                    rows += [i * long + t + shift] * len(got)
                    cols += [(0 if shift == 0 else 1 if shift == 1 else 2) * SPACE + s for s in got]
    row, col = np.array(rows), np.array(cols)
    used, col = np.unique(col, return_inverse=True)
    by_row, by_col = np.argsort(row, kind="stable"), np.argsort(col, kind="stable")
    row_at, col_at = row[by_row], col[by_row]
    first = np.flatnonzero(np.concatenate(([True], row_at[1:] != row_at[:-1])))
    row_names = row_at[first]
    col_first = np.flatnonzero(np.concatenate(([True], col[by_col][1:] != col[by_col][:-1])))
    w, moves = np.zeros((len(used), k)), np.zeros((k + 1, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    one = np.eye(k)
    size = mask.sum(1)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, rounds + 1):
        e = np.zeros((n * long, k))
        e[row_names] = np.add.reduceat(w[col_at], first, axis=0)
        e = e.reshape(n, long, k)
        alpha, beta = np.zeros((n, long, k)), np.zeros((n, long, k))
        alpha[:, 0] = e[:, 0] + moves[-1]
        for t in range(1, long):
            alpha[:, t] = np.where(mask[:, t, None], lse(alpha[:, t - 1, :, None] + moves[:-1], 1) + e[:, t], alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        for t in range(long - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], lse(moves[:-1] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        delta = one[gold] * mask[..., None] - p
        grad_w = np.add.reduceat(delta.reshape(-1, k)[row[by_col]], col_first, axis=0) / n - decay * w
        grad_m = np.zeros_like(moves)
        for t in range(1, long):
            on = t < size
            pair = np.exp(alpha[on, t - 1, :, None] + moves[:-1] + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
            grad_m[:-1] += one[gold[on, t - 1]].T @ one[gold[on, t]] - pair.sum(0)
        grad_m[-1] = delta[:, 0].sum(0)
        grad_m = grad_m / n - decay * moves
        for x, g, a, b in ((w, grad_w, 0, 1), (moves, grad_m, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.99 * state[b] + 0.01 * g * g
            x += rate * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((3 * SPACE, k), np.float32)
    weights[used] = w
    return Field(weights.reshape(3, SPACE, k), moves.astype(np.float32))


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_sentences())


#: Words of a decoding batch, and distinct shapes whose scores a task remembers before it starts anew.
DECODE_WORDS, REMEMBERED = 1 << 18, 1 << 17
_TRIM = ".,;:!?\"'()[]{}<>"


class Tagger:
    """Labels of the words of many texts, given as shapes; scores of a distinct shape are worked out once."""

    def __init__(self, field: Field) -> None:
        self.field, self.index, self.scores, self.n = field, {}, np.zeros((1024, 3, len(LABELS)), np.float32), 0

    def ids(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        out = [index.get(w, -1) for w in words]
        if -1 in out:
            for k, w in enumerate(words):
                if out[k] < 0:
                    if (at := index.get(w)) is None:
                        if self.n == len(self.scores):
                            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                        self.scores[self.n] = self.field.word_scores(w)
                        at = index[w] = self.n
                        self.n += 1
                    out[k] = at
        return np.array(out, np.int64)

    def labels(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if self.n > REMEMBERED:
            self.index, self.n = {}, 0
        sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate([self.ids(t) for t in texts]) if len(texts) else np.zeros(0, np.int64)
        scores = self.scores[ids]
        e = scores[:, 0].copy()
        ends = np.cumsum(sizes)
        inner = np.ones(len(ids), bool)
        inner[(ends - sizes)[sizes > 0]] = False  # first words have no left neighbour
        right = np.flatnonzero(inner)
        e[right] += scores[right - 1, 1]
        e[right - 1] += scores[right, 2]
        return np.split(self.field.viterbi(e, sizes), ends[:-1])


def added_spans(text: str, labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of words labelled secret, without marks around them, that no base span overlaps."""
    words = [m.span() for m in _WORD.finditer(text)]
    hit = np.flatnonzero(labels == LABELS.index("secret")).tolist()
    starts = [s for _, s, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    out, k = [], 0
    while k < len(hit):
        last = k
        while last + 1 < len(hit) and hit[last + 1] == hit[last] + 1:
            last += 1
        a, b = words[hit[k]][0], words[hit[last]][1]
        while a < b and text[a] in _TRIM:
            a += 1
        while a < b and text[b - 1] in _TRIM:
            b -= 1
        before = bisect_left(starts, b)  # base spans that start before its end
        if a < b and not (before and reach[before - 1] > a):
            out.append(("secret", a, b))
        k = last + 1
    return out


def batch_spans(tagger: Tagger, texts: list[str]) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text."""
    at = 0
    while at < len(texts):
        group, words = [], 0
        while at < len(texts) and (not group or words + len(group[-1]) < DECODE_WORDS):
            group.append(shape(texts[at].encode("utf-8", "surrogatepass")).split())
            words += len(group[-1])
            at += 1
        for text, labels in zip(texts[at - len(group) : at], tagger.labels(group), strict=True):
            base = base_spans(text)
            more = added_spans(text, labels, base) if (labels == LABELS.index("secret")).any() else []
            yield base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones merged, replaced by its first kind in square brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def find_pii(df: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans) of every row of (doc_id, text)."""
    shared = _broadcast(df, field)

    def make():  # noqa: ANN202
        tagger = Tagger(Field(*shared.value))

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, told = [], []
            for base, spans in batch_spans(tagger, texts):
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in spans) if spans else 0)
                digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
                told.append(_told(spans))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(told, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        return each

    counted = ", ".join(f"n_{k} long" for k in KINDS)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, make, f"doc_id long, {counted}, base_sha256 string, spans string")


def _broadcast(df: DataFrame, field: Field | None):  # noqa: ANN202
    """The field's weights: a fixed size, whatever the input."""
    field = field or default_field()
    return df.sparkSession.sparkContext.broadcast((field.weights, field.moves))


def redact(df: DataFrame, column: str = "text", field: Field | None = None) -> DataFrame:
    """The same rows and columns with every span in ``column`` replaced by its kind; null stays null."""
    shared = _broadcast(df, field)

    @F.arrow_udf("string")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(Field(*shared.value))
        for part in parts:
            done = [pa.array([], pa.string())]
            for at in range(0, len(part), 512):  # so that few texts at a time are Python strings
                given = part.slice(at, 512).to_pylist()
                spans = batch_spans(tagger, [t or "" for t in given])
                done.append(pa.array([None if t is None else redacted(t, s) for t, (_, s) in zip(given, spans, strict=True)], pa.string()))
            yield pa.concat_arrays(done)

    small_batches(df.sparkSession)
    return df.withColumn(column, clean(F.col(column)))


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
