"""Chat formatting: typed content parts flattened into one string per conversation, DataFrame functions only.

A visitor walks the ordered parts of each turn. Text is escaped; an image, audio clip or document becomes a
placeholder ``<|kind:k|>`` numbered through the conversation, and its reference and expanded token count are
recorded. Each turn becomes ``<|turn|>role<|text|>...<|end|>``. Control strings all begin with ``<|``; inside texts and
roles a run ``<``, any backslashes, ``|`` gets one more backslash, so no control string survives there and
unescaping gives the exact text back. The loss mask is a run of (start, length) code-point ranges that cover
the text of assistant turns and nothing else.

Null text counts as empty, null role as the empty role, null turn sorts first; turns that tie sort by role, then
parts. Repeated rows are repeated turns. Rows with null conv_id form one conversation with a null id. An empty table gives an
empty table; other columns are dropped. A conversation is one row of the result, so its turns meet in one task; very long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Token cost of attachments: an image pays for each tile and for itself, audio for each second, documents for each page.
TILE, TILE_TOKENS, IMAGE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 750
PART = "struct<kind: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def text_parts(name: str) -> Column:
    """A plain text column as an array with one text part."""
    empty = "'ref', string(null), 'width', bigint(null), 'height', bigint(null), 'seconds', double(null), 'pages', bigint(null)"
    return F.expr(f"array(named_struct('kind', 'text', 'text', coalesce({name}, ''), {empty}))")


def part_tokens(p: Column) -> Column:
    """Expanded token count of an attachment; 0 for text."""
    tiles = F.ceil(F.coalesce(p["width"], F.lit(TILE)) / TILE) * F.ceil(F.coalesce(p["height"], F.lit(TILE)) / TILE)
    return (
        F.when(p["kind"] == "image", F.lit(IMAGE_TOKENS) + tiles * TILE_TOKENS)
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * SECOND_TOKENS))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_chat(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask, attachments) from rows (conv_id, turn, role, parts array of ``PART``).

    mask: array of (start, length), code points from 0, one for each assistant turn in order. attachments: array of
    (slot, kind, ref, tokens) in the order of their placeholders. Parts of an unknown kind count as text.

    The visitor is a row per part with running sums over the conversation, for slots and for code points, so work grows with the parts
    and not with their square. All of it is on one partitioning by conversation: one shuffle.
    """
    rows = df.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    conversation = Window.partitionBy("conv_id")
    so_far = lambda *order: conversation.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = rows.withColumn("k", F.row_number().over(conversation.orderBy(F.asc_nulls_first("turn"), "role", "parts")))
    parts = turns.select("conv_id", "k", "role", F.posexplode_outer("parts").alias("j", "p"))
    media = F.coalesce(F.col("p")["kind"].isin("image", "audio", "document"), F.lit(False))
    parts = parts.withColumn("media", media).withColumn("slot", F.sum(F.col("media").cast("int")).over(so_far("k", "j")) - 1)
    mark = F.concat(F.lit("<|"), F.col("p")["kind"], F.lit(":"), F.col("slot").cast("string"), F.lit("|>"))
    told = F.when(F.col("media"), mark).otherwise(escape(F.coalesce(F.col("p")["text"], F.lit(""))))
    held = F.when(F.col("media"), F.struct(F.col("slot").cast("int").alias("slot"), F.col("p")["kind"].alias("kind"), F.col("p")["ref"].alias("ref"), part_tokens(F.col("p")).alias("tokens")))
    bodies = parts.groupBy("conv_id", "k", "role").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("j", F.lit(0)).alias("j"), told.alias("t")))), lambda x: x["t"]), "").alias("body"),
        F.array_sort(F.collect_list(held)).alias("held"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    bodies = bodies.withColumn("head", head).withColumn("size", F.char_length("body").cast("long"))
    whole = F.char_length("head") + F.col("size") + len(END)
    bodies = bodies.withColumn("start", F.sum(whole).over(so_far("k")) - F.col("size") - len(END))
    piece = F.struct("k", F.concat("head", "body", F.lit(END)).alias("text"), "held", F.when(F.col("role") == "assistant", F.struct("start", F.col("size").alias("length"))).alias("run"))
    done = bodies.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return done.select(
        "conv_id", F.array_join(F.col("pieces")["text"], "").alias("formatted"), F.array_compact(F.col("pieces")["run"]).alias("mask"),
        F.flatten(F.col("pieces")["held"]).alias("attachments"),
    )


def parse_chat(df: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) read back from ``formatted`` and ``mask`` alone: role and text of each turn, and the text under the mask."""
    blocks = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)

    def turn(b: Column) -> Column:
        role = F.substring_index(b, TEXT, 1)
        body = F.substr(b, F.char_length(role) + len(TEXT) + 1, F.char_length(b) - F.char_length(role) - len(TEXT) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    loss = F.transform("mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return df.select("conv_id", "formatted", F.transform(blocks, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the extra one of the contract, formatted, then read back."""
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(i AS BIGINT) AS turn, IF(i = 0, 'user', 'assistant') AS role, '{probe}' AS text FROM range(2) t(i)")
    formatted = format_chat(rows.unionByName(extra).withColumn("parts", text_parts("text")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_chat(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB's version; formatted_chars counts the marks and one backslash for each escaped run.
OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(role) + length(text)
    + length(regexp_extract_all(role, '<\\*\|')) + length(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
