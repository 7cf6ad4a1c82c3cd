"""Small tables with every awkward case, shared by the tests of the training-data operators."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

from tidemark.llm import langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key long, fp long, run string, doc long, marks string, length long"


def words(seed: int, n: int, vocabulary: int = 60) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) + str(rng.randrange(vocabulary)) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empties, exact and near copies, shared passages, repeats within a text, odd white space, long texts, repeated rows."""
    passage = " ".join(words(1, 80))
    base = words(2, 120)
    near = [*base[:60], "changed", *base[61:]]
    long = " ".join(words(3, 6000, 5000))
    rng = random.Random(9)
    rows: list[tuple[int | None, str | None]] = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two"), (9, passage),
        (10, " ".join(words(4, 30)) + "\n" + passage + "  " + " ".join(words(5, 30))), (11, " ".join(words(6, 20)) + " " + passage), (12, "again " * 200),
        (13, "x" * 3000), (14, "ab" * 700 + "x" * 100), (15, long), (16, long[:20000]), (17, long[5000:]), (None, " ".join(base)), (None, None), (18, "日本語 " * 60 + "🙂"),
        (19, "A B C " * 30), (20, passage.upper()), (20, passage.upper()), (21, passage[:49]), (22, passage[:50]), (23, passage[:51]), (24, "."), (25, "\x00\x01 \x00"),
        (-5, " ".join(words(7, 40)) + " " + passage), (1 << 40, "one"),
    ]
    for k in range(30, 60):
        rows.append((k, " ".join(words(k, rng.randint(0, 90)) + base[rng.randint(0, 60) : rng.randint(60, 120)])))
    for k in range(60, 75):
        rows.append((k, " ".join(base)))
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, ("en", "de", None)[k % 3], ("src0", None, "src1")[k % 3], None if t is None else len(t), k, k, k, "r", k, "m", -k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def slow_language(texts_by_language, text):
    """The classifiers, the decoding and the score one trigram and one bit at a time; (language, score, ambiguous, fit)."""
    def buckets(t):
        folded = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in t.encode()) + b" "
        n = len(t.encode())
        return [((folded[k] | folded[k + 1] << 8 | folded[k + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for k in range(n)]

    names = sorted(texts_by_language)
    counts = {x: Counter(b for t in texts_by_language[x] for b in buckets(t)) for x in names}
    share = lambda x, b: (counts[x][b] + 0.1) / (counts[x].total() + 0.1 * 65536)
    code = langid.codewords(len(names)).tolist()
    margins = []
    for bit in range(len(code[0])):
        plus, minus = [x for x, c in zip(names, code, strict=True) if c[bit] > 0], [x for x, c in zip(names, code, strict=True) if c[bit] < 0]
        odds = [math.log(sum(share(x, b) for x in plus) / len(plus)) - math.log(sum(share(x, b) for x in minus) / len(minus)) for b in buckets(text)]
        margins.append(sum(odds) / max(1, len(odds)))
    losses = [sum(math.log1p(math.exp(-4.0 * m * bit)) for m, bit in zip(margins, word, strict=True)) for word in code]
    best = min(range(len(names)), key=lambda k: losses[k])
    score = 1 / sum(math.exp(losses[best] - x) for x in losses)
    fit = sum(math.log(share(names[best], b) * 65536) for b in buckets(text)) / max(1, len(buckets(text)))
    return names[best], score, score < 0.6, fit


def in_a_language(rows):
    """The rows of (doc_id, text) that the pipeline's first stage keeps of ``table(spark, rows)``: with a letter, and likelier in the language predicted than by chance."""
    learned: dict = {}
    for k, (i, t) in enumerate(rows):
        if k % 3 < 2 and i is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            learned.setdefault(("en", "de")[k % 3], []).append(t)
    return [(i, t) for i, t in rows if t and any(c.isalpha() for c in t) and slow_language(learned, t)[3] > 0]
