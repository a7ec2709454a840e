"""Server-sent lines from pieces of bytes that were cut anywhere, and their transcoding to chat chunks.

Pieces are (stream, seq, data, last): the bytes of a stream in the order of seq,
from 0 and without gaps, cut within lines or characters; `last` marks the end.
`lines` reads them as a table, `line_stream` as they come, with what is left of a
line, and pieces that came too early, kept as the state of their stream; both give
the same lines.  A piece that comes twice counts once.

A line ends with a line feed, a carriage return before it is no part of it; bytes
that are no UTF-8 become U+FFFD.  What stands behind the last line feed is a line if
the stream has ended.  Null data is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = "stream {kind}, n long, line string"
_STATE = "next long, n long, rest binary, seqs array<long>, held array<binary>, lasts array<boolean>"

# How the lines of either side begin, and what ends a stream.
LEAD, DONE, STOP = "data: ", "[DONE]", "stop"


def _decoded(raw: bytes) -> str:
    return raw.removesuffix(b"\r").decode("utf-8", "replace")


def lines(pieces: DataFrame) -> DataFrame:
    """(stream, n, line): the lines of all streams, from 0.

    Each piece is split on its own; what stands before its first line feed belongs
    to the line that the pieces before it have begun, whose number is how many
    line feeds these hold.  So a long stream is only counted in one task.
    """
    once = pieces.groupBy("stream", "seq").agg(F.first("data").alias("data"), F.max("last").alias("last"))
    # as Latin-1 each byte is a character
    parts = F.split(F.decode(F.coalesce("data", F.lit(b"")), "ISO-8859-1"), "\n")
    own = once.select("stream", "seq", "last", parts.alias("parts"), (F.size(parts) - 1).cast("long").alias("breaks"))
    order = Window.partitionBy("stream").orderBy("seq")
    begun = own.withColumn("base", F.coalesce(F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = begun.select("stream", "seq", "last", "base", "breaks", F.posexplode("parts").alias("k", "part"))
    at_end = F.max(F.col("last") & (F.col("k") == F.col("breaks"))).alias("ended")
    held = F.array_sort(F.collect_list(F.struct("seq", "part")))
    whole = each.groupBy("stream", (F.col("base") + F.col("k")).alias("n")).agg(F.array_join(F.transform(held, lambda x: x["part"]), "").alias("raw"), F.max(F.col("k") < F.col("breaks")).alias("broken"), at_end)
    text = F.make_valid_utf8(F.encode(F.regexp_replace("raw", "\r$", ""), "ISO-8859-1").cast("string"))
    return whole.where(F.col("broken") | (F.col("ended") & (F.col("raw") != ""))).select("stream", "n", text.alias("line"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The lines that a stream's new pieces complete."""
    following, n, rest, seqs, held, lasts = state.get if state.exists else (0, 0, b"", [], [], [])
    early = {s: (bytes(d), e) for s, d, e in zip(seqs, held, lasts, strict=True)}
    for batch in batches:
        for seq, data, last in zip(batch["seq"], batch["data"], batch["last"], strict=True):
            if seq >= following:
                early.setdefault(int(seq), (bytes(data or b""), bool(last)))
    out = []
    while following in early:
        data, last = early.pop(following)
        *whole, rest = (rest + data).split(b"\n")
        if last and rest:
            whole, rest = [*whole, rest], b""
        out += [(key[0], n + k, _decoded(line)) for k, line in enumerate(whole)]
        following, n = following + 1, n + len(whole)
    state.update((following, n, rest, list(early), [d for d, _ in early.values()], [e for _, e in early.values()]))
    yield pd.DataFrame(out, columns=["stream", "n", "line"])


def line_stream(pieces: DataFrame) -> DataFrame:
    """(stream, n, line) of a stream of pieces, as they are complete; pieces may come in any order."""
    kind = pieces.schema["stream"].dataType.simpleString()
    return pieces.groupBy("stream").applyInPandasWithState(_step, LINES.format(kind=kind), _STATE, "append", "NoTimeout")


def _chunk(identity: Column, delta: Column, finish: Column) -> Column:
    choice = F.struct(F.lit(0).alias("index"), delta.alias("delta"), finish.cast("string").alias("finish_reason"))
    return F.struct(identity.alias("id"), F.lit("chat.completion.chunk").alias("object"), F.lit("corpus").alias("model"), F.array(choice).alias("choices"))


def transcode(found: DataFrame) -> DataFrame:
    """(stream, n, part, out): the chunks that the events of lines become; an end gives two, nothing comes behind the first [DONE].

    Lines without `data: `, bad JSON and other events give none.  Stateless but for
    the end, so it may follow `lines` or, where streams end with their last event,
    `line_stream`.
    """
    body = F.when(F.startswith("line", F.lit(LEAD)), F.substring("line", len(LEAD) + 1, 1 << 30))
    event = F.try_parse_json(body)
    get = lambda path: F.try_variant_get(event, path, "string")
    identity = F.concat(F.lit("chatcmpl-"), F.left(F.sha2(F.concat_ws(":", F.col("stream").cast("string"), F.col("n").cast("string")), 256), F.lit(8)))
    as_json = lambda chunk: F.concat(F.lit(LEAD), F.to_json(chunk, {"ignoreNullFields": "false"}))
    message = as_json(_chunk(identity, F.struct(F.coalesce(get("$.answer"), F.lit("")).alias("content")), F.lit(None)))
    empty = F.create_map().cast("map<string,string>")
    ending = as_json(_chunk(identity, empty, F.lit(STOP)))
    done = F.lit(LEAD + DONE)
    none = F.array().cast("array<string>")
    is_done = F.trim(body) == DONE
    outs = F.when(is_done, F.array(done)).when(get("$.event") == "message", F.array(message)).when(get("$.event") == "message_end", F.array(ending, done)).otherwise(none)
    return found.withColumn("_outs", outs).select("stream", "n", F.posexplode("_outs").alias("part", "out"))


def until_done(chunks: DataFrame) -> DataFrame:
    """The chunks of each stream up to its first [DONE] with it."""
    first = chunks.where(F.col("out") == LEAD + DONE).groupBy("stream").agg(F.min(F.struct("n", "part")).alias("end"))
    joined = chunks.join(first, "stream", "left")
    return joined.where(F.col("end").isNull() | (F.struct("n", "part") <= F.col("end"))).drop("end")
