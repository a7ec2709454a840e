"""Conversation operators: token accounting and tiered compaction of message logs.

A log has (conversation, turn, role, text).  Windows are over one conversation;
their rows carry keys and flags, not texts, where a conversation may be long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.tables import kept

# Limits of the context and of the tiers.
CONTEXT_LIMIT, THRESHOLD, MARGIN_PERCENT = 60_000, 0.92, 110
KEEP_RESULTS, RESULT_TOKENS, REBUILT_TOKENS, SAME_RATIO, CLEARED = 5, 2_000, 50_000, 0.05, "[cleared]"


def approximate_tokens(text: Column) -> Column:
    """Tokens of a text by a rule: a token for each run of up to 4 letters or digits, or other sign.  Stands in for a vocabulary."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]{1,4}|[^\s\p{L}\p{N}_]"), F.lit(0)))


def token_count(text: Column, tokens: Callable[[Column], Column] = approximate_tokens) -> Column:
    """Tokens of one message with the safety margin, rounded down."""
    return F.floor(tokens(text) * MARGIN_PERCENT / 100).cast("long")


def usage(log: DataFrame, key: str = "conv_id", text: str = "text", limit: int = CONTEXT_LIMIT, tokens: Callable[[Column], Column] = approximate_tokens, calls: str | None = None) -> DataFrame:
    """(key, messages, tokens, ratio, needs_compaction); `calls` is a column with the tool calls of messages as JSON, whose tokens count too."""
    own = token_count(F.col(text), tokens)
    if calls:
        own = own + F.when(F.coalesce(F.length(calls), F.lit(0)) > 0, token_count(F.col(calls), tokens)).otherwise(0)
    total = log.groupBy(key).agg(F.count("*").alias("messages"), F.sum(own).alias("tokens"))
    return total.withColumn("ratio", F.round(F.col("tokens") / limit, 6)).withColumn("needs_compaction", F.col("tokens") / limit >= THRESHOLD)


def clear_old(log: DataFrame, role: str, keep: int = KEEP_RESULTS, key: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Tier 1: of the messages of `role` all but the last `keep` of a conversation are cleared; messages without a turn are the oldest."""
    newest = Window.partitionBy(key, F.col("role") == role).orderBy(F.desc_nulls_last(turn), F.xxhash64(text))
    old = (F.col("role") == role) & (F.row_number().over(newest) > keep)
    return log.withColumn("_old", old).withColumn(text, F.when(F.col("_old"), CLEARED).otherwise(F.col(text))).drop("_old")


def last_messages(log: DataFrame, role: str, k: int = KEEP_RESULTS, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last k messages of a role in each conversation."""
    newest = Window.partitionBy(key).orderBy(F.desc(turn))
    return log.where(F.col("role") == role).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= k).drop("_rank")


def trailing_run(log: DataFrame, role: str, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of `role` after the last message of any other."""
    last = log.where(F.col("role") != role).groupBy(key).agg(F.max(turn).alias("_last"))
    return log.join(last, key, "left").where((F.col("role") == role) & (F.col(turn) > F.coalesce("_last", F.lit(-1)))).drop("_last")


def last_of(log: DataFrame, role: str = "user", key: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(key, turn, text) of the last message of a role."""
    return log.where(F.col("role") == role).groupBy(key).agg(F.max_by(F.struct(turn, text), turn).alias("x")).select(key, "x.*")


def compress(text: Column) -> Column:
    """Without table rows, rules and runs of blank lines, stripped."""
    out = F.regexp_replace(text, r"\|[^\n]*\|[^\n]*\n", "")
    out = F.regexp_replace(out, r"(?md)^[=\-*]{3,}$", "")
    return T.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def cut_middle(text: Column, most: int | Column, mark: str = "\n\n... [cut] ...\n\n") -> Column:
    """Head and tail of texts of more than `most` tokens of the approximate rule."""
    half = most // 2 if isinstance(most, int) else F.floor(most / 2).cast("int")
    piece = r"(?s:[\p{L}\p{N}_]{1,4}\s*|[^\s\p{L}\p{N}_]\s*|^\s+)"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    both = F.concat(F.array_join(F.slice(pieces, 1, half), ""), F.lit(mark), F.array_join(F.slice(pieces, F.size(pieces) - half + 1, half), ""))
    return F.when(approximate_tokens(text) <= most, text).otherwise(both)


def compress_results(log: DataFrame, role: str, most: int = RESULT_TOKENS, text: str = "text") -> DataFrame:
    """Tier 2: messages of `role` that are not cleared are compressed and cut."""
    hit = (F.col("role") == role) & (F.col(text) != CLEARED)
    return log.withColumn(text, F.when(hit, cut_middle(compress(F.col(text)), most)).otherwise(F.col(text)))


def without_sections(text: Column, titles: list[str]) -> Column:
    """Markdown text without the sections (## ...) whose titles begin with one of `titles`."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=## )")
    some = F.filter(parts, lambda x: ~F.rlike(x, F.lit("^## (?:" + "|".join(f"\\Q{t}\\E" for t in titles) + ")"))) if titles else parts
    return F.regexp_replace(F.array_join(some, "\n"), r"^\n", "")


def last_request(log: DataFrame, key: str, turn: str = "turn", text: str = "text") -> DataFrame:
    """(key, summary): a summary that needs no model: how many messages there were and what the user asked last."""
    asked = F.max_by(F.when(F.col("role") == "user", F.col(text)), F.when(F.col("role") == "user", F.col(turn)))
    return log.groupBy(key).agg(F.concat(F.count("*").cast("string"), F.lit(" messages; last request: "), F.coalesce(asked, F.lit(""))).alias("summary"))


def rebuild(
    log: DataFrame,
    role: str,
    prompt: str,
    drop_sections: list[str],
    summarise: Callable[..., DataFrame] = last_request,
    key: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    limit: int = CONTEXT_LIMIT,
    keep: int = KEEP_RESULTS,
    most: int = REBUILT_TOKENS,
    tokens: Callable[[Column], Column] = approximate_tokens,
) -> DataFrame:
    """Tier 3: (key, turn, role, text) of new conversations: the prompt, a summary and the last `keep` results, which share `most` tokens.

    What is still over the threshold gets the prompt without `drop_sections`; what is even then, no results and a
    quarter of the limit for its summary.  Turns count from 0.
    """
    recent = last_messages(log, role, keep, key, turn).select(key, F.col(turn).alias("_turn"), F.col(text).alias("text"))
    number = F.count("*").over(Window.partitionBy(key))
    share = F.floor(F.lit(most) / number).cast("int")
    order = F.row_number().over(Window.partitionBy(key).orderBy("_turn")) + 1
    results = recent.select(key, order.cast("long").alias("turn"), F.lit(role).alias("role"), cut_middle(F.col("text"), share).alias("text"))
    results = results.withColumn("tokens", token_count(F.col("text"), tokens))
    cost = lambda value: token_count(value, tokens)
    head = F.concat(F.lit("[context compacted]\n\n"), F.lit(prompt))
    short = F.concat(F.lit("[context compacted]\n\n"), without_sections(F.lit(prompt), drop_sections))
    made = summarise(log, key, turn, text).join(results.groupBy(key).agg(F.sum("tokens").alias("spent")), key, "left")
    spent = F.coalesce("spent", F.lit(0)) + cost(F.col("summary"))
    over = lambda used: used / limit >= THRESHOLD
    made = made.withColumn("level", F.when(~over(spent + cost(head)), 0).when(~over(spent + cost(short)), 1).otherwise(2))
    rows = F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), F.when(F.col("level") == 0, head).otherwise(short).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("level") < 2, F.col("summary")).otherwise(cut_middle(F.col("summary"), F.lit(limit // 4))).alias("text")),
    )
    held = results.join(made.where("level < 2").select(key), key, "left_semi").drop("tokens")
    return made.select(key, F.inline(rows)).unionByName(held)


def compact(
    log: DataFrame,
    role: str,
    key: str = "conv_id",
    limit: int = CONTEXT_LIMIT,
    keep: int = KEEP_RESULTS,
    most: int = RESULT_TOKENS,
    last_ratio: DataFrame | None = None,
    prompt: str | None = None,
    drop_sections: list[str] | None = None,
) -> DataFrame:
    """Tiers 1, 2 and, where a prompt is given, 3 in turn for conversations over the threshold; adds `tier`, the last one applied.

    Each tier only changes the conversations that still need it, so one that is
    small enough keeps its texts.  `last_ratio` (key, ratio) has the usage after the
    last compaction; a conversation within `SAME_RATIO` of it is left alone, since
    compaction does not help it.  What a tier leaves is written once.
    """

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        need = usage(df, key, limit=limit).where("needs_compaction")
        if last_ratio is not None:
            stuck = need.join(last_ratio.select(key, F.col("ratio").alias("_last")), key).where((F.col("_last") > 0) & (F.abs(F.col("ratio") - F.col("_last")) < SAME_RATIO))
            need = need.join(stuck.select(key), key, "left_anti")
        need = need.select(key)
        return df.join(need, key, "left_anti"), df.join(need, key, "left_semi")

    done, rest = split(log.withColumn("tier", F.lit(0)))
    last_ratio = None  # the guard is for the first tier alone
    done1, rest = split(kept(clear_old(rest, role, keep, key).withColumn("tier", F.lit(1)), "tier1"))
    rest = compress_results(rest, role, most).withColumn("tier", F.lit(2))
    if prompt is None:
        return done.unionByName(done1).unionByName(rest)
    done2, rest = split(kept(rest, "tier2"))
    third = rebuild(rest, role, prompt, drop_sections or [], key=key, limit=limit, keep=keep).withColumn("tier", F.lit(3))
    return done.unionByName(done1).unionByName(done2).unionByName(third.select(*done.columns))
