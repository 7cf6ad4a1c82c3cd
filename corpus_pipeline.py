"""The corpus pipeline: language ID, exact dedup, near-duplicate dedup, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet into the shared
checkpoint folder and reads it back as the next one's docs. All stages but the last return the columns of documents, whatever their
names: columns that a stage adds on its way take names that the table doesn't have.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KeyBitmap, cut, cuts_so_far, drop_cuts, drop_folder, shared_dir, table, without
from tidemark.llm.exact import exact_classes
from tidemark.llm.jaccard import near_gone, with_nodes
from tidemark.llm.langid import fit, with_language
from tidemark.llm.packing import pack_documents, sized
from tidemark.llm.pii import redact


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts go that are in none of the learned languages: their trigrams, all of them however long the text, are no likelier in the language
    predicted than if all trigrams were equally likely. Null texts and texts without a letter go too; a tie at zero goes, repeated rows fare alike.

    Where no language could be learned, texts with a letter stay.
    """
    model = fit(docs)
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    told = free_name(docs, "language")
    return with_language(docs, model, told).where((F.col(told)["lang_pred"] != "und") & (F.col(told)["fit"] > 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that with the largest doc_id; of rows that repeat id and text one."""
    classes = cut(exact_classes(docs).where("group_size > 1"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    # ids that come with several texts can't be told apart by id alone
    keys = [F.col("doc_id").cast("long"), digest]
    left = without(docs, classes.where("NOT kept").select("doc_id", "text_sha256"), keys)
    twice = classes.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256")
    if twice.isEmpty():
        return left
    bitmap = KeyBitmap(cut(twice), "doc_id", "text_sha256")
    return bitmap.others(left, *keys).union(bitmap.held(left, *keys).dropDuplicates(["doc_id", "text"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id; null ids stay.

    The SimHash operator proposes groups; links are pairs with a five-word Jaccard similarity of 0.8 or more on the whole texts, and an exact
    join finds those that fingerprints miss. A document is an id with its text: an id that comes with several texts is several documents.
    """
    node = free_name(docs, "node")
    rows, surrogates = with_nodes(docs, node)
    return without(rows, near_gone(rows, node, surrogates), [F.col(node)]).drop(node)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """E-mail and IP addresses, card and phone numbers and secrets become their kind in brackets; n_chars follows.

    Null texts stay null, very long ones are redacted whole, rows that repeat are redacted alike.
    """
    done = redact(docs)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words: a row for each piece of each document that is left.

    A longer text comes in several pieces, a text without words (null, too) as one piece of length zero. Ties and repeated rows are as ``tidemark.llm.packing`` states.
    """
    return pack_documents(sized(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("pack", pack),
]

#: SQL can't express the language model, the linked components, the field or the packing; a test holds run() on a small table against brute force
#: (which ids stay, words packed of each), and its redaction against the field on one text at a time.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, keep_stages: bool = False) -> DataFrame:
    """All stages over the whole documents table. What stages wrote goes when the next has read it, unless ``keep_stages``; the last one's stays."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path, mark = f"{where}/{k}-{name}", cuts_so_far(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_cuts(spark, mark)
        if before and not keep_stages:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
