"""The corpus pipeline: what each stage keeps, on awkward rows and on the small tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.cases import in_a_language, table, texts, words
from tests.llm.test_jaccard import brute_labels


def test_stages_on_awkward_rows(spark):
    rows = texts() + [(400, "Mail an.na@mail.example.com or 10.1.2.3 please"), (5, "five again")]
    docs = table(spark, rows)
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    said = corpus_pipeline.language_id(spark, docs, "")
    want = Counter(in_a_language(rows))
    assert len(want) < sum(1 for _, t in rows if t and any(c.isalpha() for c in t))  # some are in no language
    assert pairs(said) == want and said.columns == docs.columns
    once = corpus_pipeline.exact_dedup(spark, said, "")
    best = {}
    for i, t in want:
        if i is not None:
            best[t] = max(best.get(t, i), i)
    assert pairs(once) == Counter((i, t) for t, i in best.items()) and once.columns == docs.columns
    near = corpus_pipeline.near_dedup(spark, once, "")
    label = brute_labels([(i, t) for t, i in best.items()])  # five words, similarity 0.8 or more
    assert pairs(near) == Counter((i, t) for t, i in best.items() if label[i] == i)
    clean = corpus_pipeline.redact_pii(spark, near, "")
    assert clean.columns == docs.columns and clean.count() == near.count()
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[400] == "Mail [EMAIL] or [IP] please"
    packed = corpus_pipeline.pack(spark, clean, "")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in pairs(near)}


def test_an_id_with_several_texts_is_several_documents(spark):
    base = words(5, 100, 3000)
    a, close, other = " ".join(base), " ".join([*base[:50], "x", *base[51:]]), " ".join(words(6, 100, 3000))
    docs = table(spark, [(3, a), (5, close), (5, other), (None, other), (7, other + " end")])
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, a), (5, other), (None, other)]) and kept.columns == docs.columns


def test_columns_with_the_stages_own_names(spark):
    docs = table(spark, [(2, "plain words in a row"), (3, None)]).select("*", F.lit("mine").alias("language"), F.lit("too").alias("node"), F.lit(3).alias("Language_"))
    said = corpus_pipeline.language_id(spark, docs, "")
    assert said.columns == docs.columns and [(r["doc_id"], r["language"], r["Language_"]) for r in said.collect()] == [(2, "mine", 3)]
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert near.columns == docs.columns and {r["node"] for r in near.collect()} == {"too"}


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    import types

    import pytest
    from tidemark.llm import common

    context = types.SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: d), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_null_ids_stay(spark):
    docs = table(spark, [(None, "some words here"), (None, "other words there"), (1, "some words here")])
    once = corpus_pipeline.exact_dedup(spark, docs, "")
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in once.collect()) == [(0, "other words there"), (1, "some words here")]
    assert corpus_pipeline.near_dedup(spark, once, "").count() == 2


def test_empty_table(spark):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run(spark, sf):
    packed = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < packed.select("doc_id").distinct().count() < docs.count()
    assert packed.groupBy("bin_id").sum("length").where("`sum(length)` > 2048").count() == 0
    import os

    where = packed.inputFiles()[0].split("/4-pack/")[0].removeprefix("file://")
    assert os.listdir(where) == ["4-pack"]  # what the other stages wrote is gone


def test_cuts_can_be_dropped(spark):
    from tidemark.llm.common import cut, drop_cuts

    drop_cuts(spark)
    held = cut(table(spark))
    assert held.count() == len(texts()) and held.schema == table(spark).schema
    assert drop_cuts(spark) == 1 and drop_cuts(spark) == 0


def test_texts_in_no_learned_language_go(spark):
    """Gibberish has letters, and a nearest language, but chance explains it better; short and long texts of a learned language stay."""
    import random

    rng = random.Random(12)
    say = lambda alphabet, n: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(k, say("aeiou bcd", 30), "l0") for k in range(60)] + [(100 + k, say("xyzwq jk", 30), "l1") for k in range(60)]
    rows += [(300, say("aeiou bcd", 2), None), (301, say("xyzwq jk", 4000), None), (302, say("ĂĐȘȚŽŁŃŠ", 40), None), (303, "\u4e2d\u6587" * 50, None), (304, "12 34", None), (305, None, "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {302, 303, 304, 305}


def test_texts_with_letters_stay_where_no_language_is_known(spark):
    docs = table(spark).withColumn("lang", F.lit(None).cast("string"))
    said = corpus_pipeline.language_id(spark, docs, "")
    want = Counter((i, t) for i, t in texts() if t and any(c.isalpha() for c in t))
    assert Counter((r["doc_id"], r["text"]) for r in said.collect()) == want and said.columns == docs.columns


def test_run_against_brute_force(spark, tmp_path):
    from tests.llm.cases import words_of
    from tidemark.llm import pii

    secret = "Mail an.na@mail.example.com or 10.1.2.3 please"
    rows = texts() + [(400, secret), (5, "five again")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    best = {}
    for i, t in in_a_language(rows):
        if i is not None:
            best[t] = max(best.get(t, i), i)
    label = brute_labels([(i, t) for t, i in best.items()])
    field = pii.default_field()
    one = lambda t: pii.redacted(t, next(iter(pii.batch_spans(pii.Tagger(field), [t])))[1])
    left = {i: one(t) for t, i in best.items() if label[i] == i}
    assert left[400] == "Mail [EMAIL] or [IP] please"
    packed = corpus_pipeline.run(spark, str(tmp_path), keep_stages=True)
    got = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {i: len(words_of(t)) for i, t in left.items()}
    where = packed.inputFiles()[0].split("/4-pack/")[0]
    redacted = spark.read.parquet(f"{where}/3-redact_pii")
    assert {r["doc_id"]: r["text"] for r in redacted.collect()} == left and redacted.count() == len(left)
