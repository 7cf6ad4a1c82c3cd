"""Quality rules against a slow twin: counts word by word, cut-offs by exact fractions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import table, texts, words_of
from tidemark.llm import quality, registry


def slow_counts(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    starts = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if starts[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def slow_value(rule, c):
    return math.floor(Fraction(eval(rule.value, {}, c), max(c[quality.PER[rule.name]], 1)))


def slow_rules(docs, labels, risk, doubt):
    """docs: (doc_id, text, stratum); labels: (doc_id, quality)."""
    good = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            good[i].append(q == 1)
    rows = [(i, s, c := slow_counts(t), c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]) for i, t, s in docs]
    held = [(s, any(good[i]), {r.name: slow_value(r, c) for r in quality.RULES}) for i, s, c, base in rows if not base and i in good]
    strata = {s for s, _, _ in held}
    share = Fraction(str(risk)) / len(quality.RULES)
    cut = {}
    for s in strata:
        n = sum(g for x, g, _ in held if x == s)
        for r in quality.RULES:
            best = None
            for c in r.ladder:
                k, bad = (sum(g == want and v[r.name] > c for x, g, v in held if x == s) for want in (True, False))
                tail = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
                if bad and k <= share * n and tail <= Fraction(str(doubt)) / (len(strata) * len(quality.RULES)):
                    best = max(best or (0, -(10**9)), (bad, c))
            if best:
                cut[s, r.name] = best[1]
    out = []
    for i, s, c, base in rows:
        why = "base" if base else ",".join(r.name for r in quality.RULES if (s, r.name) in cut and slow_value(r, c) > cut[s, r.name])
        out.append((i, *[c[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base, why == "", why))
    return Counter(out), cut


def test_counts_of_awkward_texts(spark):
    own = [*[t for _, t in texts()], "a b c d e f g h " * 3, "a b c d e f g h a b c d e f g h", "a b c d e f g h x a b c d e f g h", "x\n\nx\n x\nx\r\nx", "🙂 é#*$%&|<>\n#", "a\x0bb\x0cc\rd", "a\x85b c d"]
    got = quality.counted(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), F.col("doc_id")).collect()
    assert len(got) == len(own)
    for r in got:
        assert {k: r[k] for k in r.asDict() if k != "keep0"} == slow_counts(own[r["keep0"]])


def labelled(n, seed=1):
    """Good and bad documents in two strata and without one; symbols and repeated lines tell the bad ones, not all of them."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(18, 60))]
        if not good and rng.random() < 0.6:
            words = [w + "###" for w in words]
        lines = [" ".join(words[j : j + 6]) for j in range(0, len(words), 6)]
        if rng.random() < (0.02 if good else 0.5):
            lines += lines[:2]
        docs.append((k, "\n".join(lines), ("en", "de", None)[k % 3] if rng.random() < 0.95 else "rare"))
        if rng.random() < 0.8:
            labels.append((k, int(good)))
    return docs + [(3, docs[5][1], "en"), (None, docs[6][1], "en"), (n, None, "en"), (n + 1, "", None)], labels + [(None, 1), (4, None), (5, 1), (5, 0), (10**9, 1)]


@pytest.mark.parametrize(("n", "risk", "doubt"), [(400, 0.6, 0.2), (1500, 0.3, 0.05), (60, 0.9, 0.9)])
def test_cutoffs_against_exact_fractions(spark, n, risk, doubt):
    docs, labels = labelled(n)
    rows = [(i, t, s, k, "x", k, k, k, "y") for k, (i, t, s) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, good long, words string, n long, keep0 int, value int, rule string").repartition(5)
    want, cut = slow_rules(docs, labels, risk, doubt)
    assert cut or n == 60
    got = quality.apply_rules(df, spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, stratum int"), "lang", risk, doubt)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_promise_holds_on_fresh_rows(spark):
    """Of good documents that were not labelled, each stratum loses no more than the risk."""
    docs, labels = labelled(3000, 8)
    fresh, truth = labelled(2000, 9)
    known = {i for i, _ in labels}
    df = spark.createDataFrame([d for d in docs if d[0] in known] + [(i + 10**6, t, s) for i, t, s in fresh if i is not None], "doc_id long, text string, lang string")
    got = quality.apply_rules(df, spark.createDataFrame(labels, "doc_id long, quality int"), "lang", 0.1, 0.05).where("doc_id >= 1000000 AND NOT base_failed").collect()
    good, stratum = {i for i, q in truth if q == 1}, {i: s for i, _, s in fresh}
    lost, bad_lost = defaultdict(list), []
    for r in got:
        i = r["doc_id"] - 10**6
        if i in good:
            lost[stratum[i]].append(not r["kept"])
        elif any(i == j for j, _ in truth):
            bad_lost.append(not r["kept"])
    assert all(sum(x) <= 0.1 * len(x) + 1 for x in lost.values()) and sum(bad_lost) > 0.5 * len(bad_lost)


def test_binomial_tail(spark):
    cases = [(0, 1), (0, 500), (3, 10), (10, 10), (40, 1000), (2000, 100_000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for share in (0.02, 0.3):
        for r in df.select("k", "n", quality.tail(F.col("k"), F.col("n"), share).alias("t")).collect():
            if r["n"] <= 1000:
                want = sum(Fraction(math.comb(r["n"], i)) * Fraction(str(share)) ** i * (1 - Fraction(str(share))) ** (r["n"] - i) for i in range(r["k"] + 1))
                assert r["t"] == pytest.approx(math.log(want.numerator) - math.log(want.denominator), rel=1e-9, abs=1e-12)
            assert r["t"] <= 1e-9


def test_rules_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.apply_rules(table(spark), none).collect()
    assert len(got) == len(texts()) and all(r["kept"] != r["base_failed"] and r["rejected_by"] == ("base" if r["base_failed"] else "") for r in got)
    assert quality.apply_rules(table(spark, []), none).count() == 0


def test_rules_plan_is_native(spark, sf):
    plan = registry.queries()["op12_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert not re.search("Python|Pandas|Arrow", quality.counted(docs, F.col("doc_id"))._jdf.queryExecution().executedPlan().toString())
