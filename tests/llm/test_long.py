"""Every operator on one very long text beside short ones: whole texts, right results."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from tests.llm.cases import table, words
from tests.llm.test_dedup import brute_bytes, brute_components, brute_fingerprint, brute_substrings
from tidemark.llm import chat, exact, jaccard, langid, mpegts, packing, pii, repeats, sentencepiece, simhash, substring


@pytest.fixture(scope="module")
def rows():
    part = words(1, 40_000, 50_000)
    long = " ".join(part)
    return [(1, "short text of one passage " + " ".join(part[30_000:30_060])), (2, long), (3, long), (4, long + " and an end"), (5, "x" * 300_000), (6, None), (7, " ".join(part[5:100]))]


def counted(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_media(spark, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"]) for r in mpegts.media_features(mpegts.store_media(table(spark, rows))).collect()}
    assert got == {i: (len((t or "").encode()), hashlib.sha256(mpegts.padded((t or "").encode())).hexdigest()) for i, t in rows}


def test_dedup(spark, rows):
    assert counted(exact.exact_classes(table(spark, rows)), "doc_id", "keep_id", "group_size") == Counter({(i, 3 if i in (2, 3) else i, 2 if i in (2, 3) else 1): 1 for i, _ in rows})
    assert counted(substring.dedup_substrings(table(spark, rows)), "doc_id", "n_words", "n_removed", "kept") == brute_substrings(rows, 35)
    assert counted(repeats.dedup_bytes(table(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 50)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    label = brute_components(list(prints.items()))
    assert {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_components(table(spark, rows)).collect()} == {i: (prints[i], label[i]) for i in prints}
    assert {r["node"]: r["label"] for r in jaccard.near_copies(table(spark, rows)).collect()} == {3: 2, 4: 2}


def test_texts(spark, rows):
    done = sentencepiece.decode_ids(sentencepiece.encode_texts(table(spark, rows)))
    assert done.where("decoded_sha256 = text_sha256").count() == len(rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(table(spark, [*rows, (8, ("a@b.example " * 30_000))])).collect()}
    assert spans[8].count("email:") == 30_000
    df = table(spark, rows)
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.fit(df)).collect()}[6] == "und"
    packed = packing.pack_documents(packing.sized(df)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len((t or "").split()) for i, t in rows}
    chats = df.select("doc_id", "text").selectExpr("doc_id AS conv_id", "1 AS turn", "'assistant' AS role", "text")
    told = chat.parse_chat(chat.format_chat(chats.withColumn("parts", chat.text_parts("text")))).collect()
    assert {r["conv_id"]: r["loss_text"] for r in told} == {i: t or "" for i, t in rows}
