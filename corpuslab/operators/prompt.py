"""Prompts put together from unlike relations under a budget, and messages of several dialects made alike.

Sections are rows (key, section, at, text).  Sections are taken in the order of
their priority and rows in the order of `at`, as long as the sum of their costs
fits the budget; a section may have a limit of its own.  A row is in the prompt if
all rows before it are, so the prompt is a prefix, never a choice.

A key with very many rows is not summed up in one task: rows are dealt by ranges,
and in each range only a beginning that fits the budget can be in the prompt; the
rest goes before the sums over the whole key are made.

Null text is empty; null costs nothing; ties are taken in the order of their
text; sections without a priority are left out.  A key without any row has no
prompt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Section:
    """A part of a prompt: its heading, what stands there if it has no rows (nothing, if null), and its own limit."""

    name: str
    heading: str = ""
    otherwise: str | None = None
    limit: int | None = None


def fitting(rows: DataFrame, key: str, sections: list[Section], cost: Column, budget: int) -> DataFrame:
    """(key, section, priority, at, text, cost): the rows that fit."""
    priority, limits = (F.create_map(*[F.lit(x) for k, s in enumerate(sections) for x in (s.name, of(k, s))]) for of in (lambda k, s: k, lambda k, s: s.limit if s.limit is not None else budget))
    asked = rows.select(key, "section", F.element_at(priority, F.col("section")).alias("priority"), "at", F.coalesce("text", F.lit("")).alias("text"), cost.alias("cost"))
    asked = asked.where("priority is not null").withColumn("cost", F.greatest(F.coalesce(F.col("cost").cast("long"), F.lit(0)), F.lit(0)))
    order = ["priority", "at", "text"]
    ranged = asked.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    for group, most in ((["section"], F.element_at(limits, F.col("section"))), ([], F.lit(budget))):
        for salt in (["_range"], []):
            # in a range the first row that does not fit stays, so that none behind it seems to
            last = -1 if salt else 0
            upto = F.sum("cost").over(Window.partitionBy(key, *group, *salt).orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
            ranged = ranged.withColumn("_upto", F.coalesce(upto, F.lit(0))).where(F.col("_upto") <= most)
    return ranged.select(key, "section", *order, "cost")


def assemble(rows: DataFrame, key: str, sections: list[Section], cost: Column | None = None, budget: int = 1 << 62) -> DataFrame:
    """(key, prompt, rows, cost): the prompt of each key; costs, by default characters, are those of rows, headings cost nothing."""
    cost = F.length("text") if cost is None else cost
    own = fitting(rows, key, sections, cost, budget)
    # what fits the budget is one row for each section
    parts = own.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("held"), F.count("*").alias("rows"), F.sum("cost").alias("cost"))
    listed = F.array_join(F.transform("held", lambda x: x["text"]), "\n")
    texts = parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", listed.alias("t")))).alias("texts"), F.sum("rows").alias("rows"), F.sum("cost").alias("cost"))
    every = rows.where(F.col("section").isin([s.name for s in sections])).select(key).distinct()
    texts = every.withColumnRenamed(key, "_key").join(texts, F.col("_key").eqNullSafe(F.col(key)), "left").drop(key).withColumnRenamed("_key", key)
    shown = []
    for s in sections:
        text = F.coalesce(F.element_at("texts", F.lit(s.name)), F.lit(s.otherwise).cast("string"))
        shown.append(F.when(text.isNotNull(), F.concat(F.lit(f"## {s.heading}\n\n" if s.heading else ""), text)))
    return texts.select(key, F.concat_ws("\n\n", *shown).alias("prompt"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("cost", F.lit(0)).alias("cost"))


def _text_of(value: Column) -> Column:
    """A variant as text: strings as they are, lists as the texts of their entries on lines of their own, null as nothing."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    plain = lambda v: F.coalesce(v.try_cast("string"), F.to_json(v))
    entry = lambda v: F.when(F.startswith(kind(v), F.lit("OBJECT")), F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))).otherwise(F.coalesce(plain(v), F.lit("None")))
    many = F.array_join(F.transform(value.try_cast("array<variant>"), entry), "\n")
    return F.when(value.isNull() | (kind(value) == "VOID"), "").when(F.startswith(kind(value), F.lit("ARRAY")), many).otherwise(plain(value))


def normalise(messages: DataFrame, message: str = "message") -> DataFrame:
    """Adds role, content, tool_call_id and tool_calls (JSON) of messages given as JSON.

    Results of tools get the id call_0 where they have none; an assistant's message
    with calls keeps them; other contents become text, lists by their entries.  What
    is no JSON object has null in all four.
    """
    body = F.try_parse_json(message)
    own = messages.withColumn("_m", F.when(F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), body))
    get = lambda path, kind="string": F.try_variant_get(F.col("_m"), path, kind)
    role = F.when(F.col("_m").isNotNull(), F.coalesce(get("$.role"), F.lit("")))
    content, calls = F.try_variant_get(F.col("_m"), "$.content", "variant"), F.try_variant_get(F.col("_m"), "$.tool_calls", "variant")
    called = (role == "assistant") & calls.isNotNull()
    return own.withColumns(
        {
            "role": role,
            "content": F.when(F.col("_m").isNotNull(), F.when(called & (content.isNull() | (F.schema_of_variant(content) == "VOID")), F.lit(None)).otherwise(_text_of(content))),
            "tool_call_id": F.when(role == "tool", F.coalesce(get("$.tool_call_id"), F.lit("call_0"))),
            "tool_calls": F.when(called, F.to_json(calls)),
        }
    ).drop("_m")


def parse_response(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds content and calls (id, name, args) of the first choice of replies; args given as text are read as JSON, or else become {"raw": ...}."""
    message = F.try_variant_get(F.try_parse_json(reply), "$.choices[0].message", "variant")
    found = replies.withColumn("_m", message)
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)

    def call(v: Column) -> Column:
        given = get(v, "$.function.arguments", "variant")
        text = F.when(F.schema_of_variant(given) == "STRING", given.try_cast("string"))
        args = F.when(given.isNull(), "{}").when(text.isNull(), F.to_json(given)).when(F.try_parse_json(text).isNotNull(), F.to_json(F.try_parse_json(text))).otherwise(F.to_json(F.struct(text.alias("raw"))))
        return F.struct(F.coalesce(get(v, "$.id"), F.lit("call_0")).alias("id"), F.coalesce(get(v, "$.function.name"), F.lit("")).alias("name"), args.alias("args"))

    calls = F.coalesce(F.transform(get(F.col("_m"), "$.tool_calls", "variant").try_cast("array<variant>"), call), F.array().cast("array<struct<id:string,name:string,args:string>>"))
    return found.withColumn("content", F.coalesce(get(F.col("_m"), "$.content"), F.lit(""))).withColumn("calls", calls).drop("_m")
