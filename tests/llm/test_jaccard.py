"""Near copies against brute-force Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from tests.llm.cases import table, texts, words
from tidemark.llm import jaccard, keybits


def brute_shingles(text: str | None) -> set[tuple[bytes, ...]]:
    w = (text or "").encode().lower().split()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_labels(rows):
    """The smallest id of each id's component, linking at 0.8 or more."""
    held = [(i, brute_shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in held}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, s) in enumerate(held):
        for j, t in held[:k]:
            both = len(s & t)
            if 5 * both >= 4 * (len(s) + len(t) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up}


def copies():
    """Families at all similarities around 0.8, a chain, a large group of near copies, and a passage common to many texts."""
    rng, rows = random.Random(3), []
    for family in range(12):
        base = words(100 + family, 40 + 30 * family, 3000)
        for k in range(8):
            one = list(base)
            for _ in range(k * len(base) // 120 + (k > 0)):
                one[rng.randrange(len(one))] = f"new{rng.randrange(10**9)}"
            rows.append((1000 + 10 * family + k, " ".join(one)))
    chain = words(200, 130, 3000)
    rows += [(2000 - k, " ".join(chain[3 * k : 3 * k + 100])) for k in range(10)]
    base = words(201, 150, 3000)
    for k in range(120):
        one = list(base)
        for _ in range(rng.randrange(6)):
            one[rng.randrange(len(one))] = f"new{rng.randrange(10**9)}"
        rows.append((3000 + k, " ".join(one)))
    passage = " ".join(words(202, 60, 3000))
    rows += [(4000 + k, passage + " " + " ".join(words(300 + k, rng.randint(0, 40), 3000))) for k in range(60)]
    return rows


def found(spark, rows):
    return {r["node"]: r["label"] for r in jaccard.near_copies(table(spark, rows)).collect()}


def test_near_copies_on_awkward_rows(spark):
    want = brute_labels(texts())
    assert found(spark, texts()) == {i: x for i, x in want.items() if i != x}


def test_near_copies_of_many_kinds(spark):
    want = brute_labels(copies())
    gone = {i: x for i, x in want.items() if i != x}
    assert found(spark, copies()) == gone and 100 < len(gone) < len(want) - 50


def test_near_copies_of_nothing(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, "alone here"), (None, "alone here")]) == {}


def test_the_order_of_shingles_only_decides_about_speed(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_common", lambda docs: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert found(spark, copies()) == {i: x for i, x in brute_labels(copies()).items() if i != x}


def test_the_stage_takes_near_copies_beyond_three_bits(spark):
    base = words(5, 100, 3000)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:10], "x", *base[11:60], "y", *base[61:]])), (3, " ".join(words(6, 100, 3000)))]
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_the_stage_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_labels([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, x in want.items() if i == x)


def test_rows_of_keys_that_one_id_has_stay_in_python(spark):
    rows = [(1, " ".join(words(1, 100, 3000))), (2, " ".join(words(2, 100, 3000))), (3, None)]
    docs = table(spark, rows).selectExpr("CAST(doc_id AS long) AS id", "text")
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = {(r["key"], r["id"]) for r in jaccard._prefixes(docs, none).collect()}
    some = spark.createDataFrame([(k,) for k, i in every if i == 2], "key long")
    got = jaccard._prefixes(docs, none, keybits.key_bits(some, keybits.long_keys, 20)).collect()
    assert {(r["key"], r["id"]) for r in got} == {(k, i) for k, i in every if i == 2} and {r["n"] for r in got} == {96}
