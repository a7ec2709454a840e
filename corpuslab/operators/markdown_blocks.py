"""Kinds of the lines of Markdown texts, and the styles within a line.

What a line is depends on whether it stands in a fenced block, and so on all lines
before it.  Lines are dealt by (text, chunk), so a text of any length is read by
many tasks.  Each chunk is summed up by what it makes of every state that it may
begin in; these maps, a few numbers for each chunk, are composed from the first
chunk to the last, which gives the state at the begin of each; then chunks are
classified independently of one another.

An automaton is data: patterns of the lines that may change the state, and the next
state for each state and pattern.  TOGGLE takes every line that begins with three
backticks as the begin or the end of a block; FENCES tells backticks from tildes
and lets only a bare fence of its kind end a block (how long a fence is makes no
difference).

Null lines are empty lines.  Rows of one text that share a line number are taken in
the order of their text.  Texts are told apart by their keys, null keys being keys
like others; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.tables import kept

CHUNK = 512


@dataclass(frozen=True)
class Automaton:
    """State 0 is plain text. `moves[state][k]` follows a line that fits `marks[k]`, the first that does."""

    marks: tuple[str, ...]
    moves: tuple[tuple[int, ...], ...]

    def mark(self, line: Column) -> Column:
        """Number of the pattern that a line fits, or -1."""
        found = F.lit(-1)
        for k in reversed(range(len(self.marks))):
            found = F.when(F.rlike(line, F.lit(self.marks[k])), k).otherwise(found)
        return found

    def after(self, state: Column, mark: Column) -> Column:
        """The state behind a mark."""
        table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in self.moves])
        return F.get(F.get(table, state), mark)


# How fences, and blocks outside of them, begin.
TOGGLE = Automaton(("^```",), ((1,), (0,)))
FENCES = Automaton(
    (r"^ {0,3}`{3,}[ \t]*$", r"^ {0,3}`{3,}[^`]*$", r"^ {0,3}~{3,}[ \t]*$", r"^ {0,3}~{3,}"),
    ((1, 1, 2, 2), (0, 1, 1, 1), (2, 2, 0, 2)),
)
_RULE = r"^[-*_]{3,}$"
_HEADING, _QUOTE = r"^(#{1,4})\s+(.*)", "> "
_BULLET, _NUMBER = r"^(\s*)[-*+]\s+(.*)", r"^(\s*)\d+\.\s+(.*)"
_STYLED = r"\*\*[^*\n]+\*\*|`[^`\n]+`"
#: What ends a line.
_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def lines_of(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, at, line): the lines of texts, from 0; no empty one behind a last break."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), _BREAKS)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select(*keys, F.posexplode(whole).alias("at", "line"))


def _entries(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, entry): the state at the begin of each chunk.

    A prefix scan over the maps of chunks: in each step a map takes in the one as
    far before it as it reaches itself, so n chunks take log n steps over rows that
    are sorted once.
    """
    most = chunks.agg(F.max("chunk")).head()[0] or 0
    order, reach = Window.partitionBy(*keys).orderBy("chunk"), 1
    scanned = chunks.select(*keys, "chunk", "map")
    while reach <= most:
        before = F.lag("map", reach).over(order)
        scanned = scanned.withColumn("_before", before)
        both = F.transform("_before", lambda state: F.get("map", state))
        scanned = scanned.withColumn("map", F.coalesce(both, "map")).drop("_before")
        reach *= 2
    return scanned.select(*keys, "chunk", F.coalesce(F.get(F.lag("map", 1).over(order), 0), F.lit(0)).alias("entry"))


def states(lines: DataFrame, keys: list[str], at: str = "at", line: str = "line", automaton: Automaton = TOGGLE, chunk: int = CHUNK) -> DataFrame:
    """(keys, at, line, mark, state): of every line the pattern it fits and the state before it."""
    own = lines.select(*keys, F.col(at).cast("long").alias("at"), F.coalesce(F.col(line), F.lit("")).alias("line"))
    packed = own.groupBy(*keys, F.floor(F.col("at") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    # only marks matter for what a chunk does to a state
    marked = packed.withColumn("marks", F.transform("lines", lambda x: automaton.mark(x["line"])))
    ends = [F.aggregate(F.filter("marks", lambda m: m >= 0), F.lit(s), automaton.after) for s in range(len(automaton.moves))]
    held = kept(marked.withColumn("map", F.array(*ends)), "chunks")
    same = [*keys, "chunk"]
    entries = _entries(held, keys).select(*[F.col(k).alias(f"_{k}") for k in same], "entry")
    joined = held.join(entries, [held[k].eqNullSafe(entries[f"_{k}"]) for k in same]).drop(*[f"_{k}" for k in same])
    # places of marks in the chunk, and the state behind each
    places = F.filter(F.sequence(F.lit(0), F.size("marks") - 1), lambda i: F.get("marks", i) >= 0)
    begun = joined.withColumn("places", places)
    behind = F.aggregate("places", F.array("entry"), lambda out, i: F.array_append(out, automaton.after(F.element_at(out, -1), F.get("marks", i))))
    each = begun.withColumn("behind", behind).select(*keys, "places", "behind", "marks", F.posexplode("lines").alias("_i", "_x"))
    passed = F.when(F.get("marks", F.col("_i")) >= 0, F.array_position("places", F.col("_i")) - 1).otherwise(_before("places", F.col("_i")))
    return each.select(*keys, F.col("_x.at").alias("at"), F.col("_x.line").alias("line"), F.get("marks", F.col("_i")).alias("mark"), F.get("behind", passed.cast("int")).alias("state"))


def _before(places: str, i: Column) -> Column:
    """How many places are before i."""
    return F.size(F.filter(places, lambda p: p < i))


def classify(lines: DataFrame, keys: list[str], at: str = "at", line: str = "line", automaton: Automaton = TOGGLE, chunk: int = CHUNK) -> DataFrame:
    """(keys, at, kind, level, content): fence, code, rule, heading, quote, bullet, number or text.

    Level is that of a heading, or how far a bullet is indented; content is what of
    the line is shown.
    """
    own = states(lines, keys, at, line, automaton, chunk)
    text = F.col("line")
    moved = automaton.after(F.col("state"), F.col("mark"))
    fits = lambda pattern: F.rlike(text, F.lit(T.java_pattern(pattern)))
    part = lambda pattern, k: F.regexp_extract(text, T.java_pattern(pattern), k)
    kind = (
        F.when((F.col("mark") >= 0) & (moved != F.col("state")), "fence")
        .when(F.col("state") > 0, "code")
        .when(F.rlike(T.strip(text), F.lit(_RULE)), "rule")
        .when(fits(_HEADING), "heading")
        .when(F.startswith(text, F.lit(_QUOTE)), "quote")
        .when(fits(_BULLET), "bullet")
        .when(fits(_NUMBER), "number")
        .otherwise("text")
    )
    is_ = lambda k: F.col("kind") == k
    level = F.when(is_("heading"), F.length(part(_HEADING, 1))).when(is_("bullet"), F.floor(F.length(part(_BULLET, 1)) / 2).cast("int"))
    content = F.when(is_("heading"), part(_HEADING, 2)).when(is_("bullet"), part(_BULLET, 2)).when(is_("quote"), F.substr(text, F.lit(len(_QUOTE) + 1))).when(~is_("fence") & ~is_("rule"), text).otherwise("")
    return own.withColumn("kind", kind).select(*keys, "at", "kind", level.alias("level"), content.alias("content"))


def spans(content: Column) -> Column:
    """Array of (style, text): bold, code and plain parts of a line in order."""
    marked = F.split(F.regexp_replace(content, f"({_STYLED})", "\u0000$1\u0000"), "\u0000")
    inner = lambda x, n: F.substr(x, F.lit(n + 1), F.length(x) - 2 * n)
    within = lambda x, sign: F.startswith(x, F.lit(sign)) & F.endswith(x, F.lit(sign)) & (F.length(x) > 2 * len(sign))
    styled = F.transform(
        F.filter(marked, lambda x: x != ""),
        lambda x: F.when(within(x, "**"), F.struct(F.lit("bold").alias("style"), inner(x, 2).alias("text")))
        .when(within(x, "`"), F.struct(F.lit("code").alias("style"), inner(x, 1).alias("text")))
        .otherwise(F.struct(F.lit("plain").alias("style"), x.alias("text"))),
    )
    return F.coalesce(styled, F.array().cast("array<struct<style: string, text: string>>"))
