"""Perspective rotation of multi-party dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant, the others as named users and system turns as they
are.  Only what the assistant says (with its end mark) is trained on.

The result has one row per perspective and message: the rendered segment, where
it starts in the rendered dialogue, and the span of characters to train on.
Segments in order of `position` are the whole dialogue, so a conversation of
any length is never gathered into one row.  Offsets are summed in blocks of
turns first and then over blocks, so one huge conversation is spread over tasks.

A null speaker is the participant "unknown", null text is empty, null turns come
first, ties are ordered by speaker and text, a null conversation id is one
conversation, and repeated rows are messages of their own.  The marks of turns
are escaped in texts and names, and a name is one line.  Conversations with
system turns alone have no perspective and give no rows; an empty table gives
none.  Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: How marks begin, and what stands for that in texts and names, so that nobody writes another's turn.
MARK, ESCAPED = "<|im_", "<| im_"
SYSTEM, UNKNOWN = "system", "unknown"
BLOCK_TURNS = 256


def _block(turn: Column, size: int) -> Column:
    return F.floor(turn / size)


def rotate(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, perspective, position, turn, chat_role, name, segment, start, loss_start, loss_end)."""
    said = messages.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit(UNKNOWN)).alias("speaker"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(ESCAPED)).alias("text"),
    )
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, "system").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    seen = seen.withColumns({"chat_role": role, "name": name, "block": _block(F.col("turn"), block_turns)})
    shown = F.replace(F.regexp_replace("name", r"[\r\n]", " "), F.lit(MARK), F.lit(ESCAPED))
    head = F.concat(F.lit(START), F.col("chat_role"), F.coalesce(F.concat(F.lit(" name="), shown), F.lit("")), F.lit("\n"))
    seen = seen.withColumns({"head": F.length(head).cast("long"), "segment": F.concat(head, "text", F.lit(END))})
    seen = seen.withColumn("chars", F.length("segment").cast("long"))

    dialogue = ["conv_id", "perspective"]
    totals = seen.groupBy(*dialogue, "block").agg(F.count("*").alias("block_n"), F.sum("chars").alias("block_chars"))
    over_blocks = Window.partitionBy(*dialogue).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("b_conv"),
        F.col("perspective").alias("b_perspective"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("block_n").over(over_blocks), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("block_chars").over(over_blocks), F.lit(0)).alias("chars_before"),
    )
    in_block = Window.partitionBy(*dialogue, "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumns({"n_here": F.count(F.lit(1)).over(in_block), "chars_here": F.coalesce(F.sum("chars").over(in_block), F.lit(0))})
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_perspective")) & F.col("block").eqNullSafe(F.col("b_block"))
    start = F.col("chars_before") + F.col("chars_here")
    trained = F.col("chat_role") == "assistant"
    return placed.join(totals, same).select(
        *dialogue,
        (F.col("n_before") + F.col("n_here")).alias("position"),
        "turn",
        "chat_role",
        "name",
        "segment",
        start.alias("start"),
        F.when(trained, start + F.col("head")).alias("loss_start"),
        F.when(trained, start + F.col("chars")).alias("loss_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT s.conv_id, perspective, turn, speaker, text,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN speaker END AS name,
         '<|im_start|>' || chat_role || coalesce(CASE WHEN chat_role = 'user' THEN ' name=' || replace(regexp_replace(speaker, '[\\r\\n]', ' ', 'g'), '<|im_', '<| im_') END, '') || chr(10) AS head
  FROM seen),
rendered AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, row_number() OVER o - 1 AS position,
         coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rendered WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, position, turn, chat_role, name, segment, CAST(start AS BIGINT) AS start,
       CAST(CASE WHEN chat_role = 'assistant' THEN start + length(head) END AS BIGINT) AS loss_start,
       CAST(CASE WHEN chat_role = 'assistant' THEN start + length(segment) END AS BIGINT) AS loss_end
FROM placed"""
