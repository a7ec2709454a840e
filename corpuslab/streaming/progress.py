"""Progress of jobs, folded from init and chunk events: as a query, and as a stream with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "job long, started boolean, ch_max long, ch_val long, pct long, tk_max long, tk_val long, label string"


def events_of(events: DataFrame, job: Column, kind: Column, order: list[Column], **fields: Column) -> DataFrame:
    """(job, kind, seq, ch_i, ch_n, tk_n, tk_cum, title)."""
    return events.select(job.alias("job"), kind.alias("kind"), F.struct(*order).alias("seq"), *(c.alias(k) for k, c in fields.items()))


def fold(events: DataFrame) -> DataFrame:
    """The last state of every job, by aggregates alone.

    An init sets the totals and starts anew; a chunk moves on, and sets the total
    of chunks where nothing has begun.  Only the last init, the first chunk and the
    last chunk of a job matter, so the fold is three aggregates and one join, and a
    job with very many events is summed up before it is shuffled.
    """
    init = events.where("kind = 'init'").groupBy("job").agg(F.max_by(F.struct("seq", "ch_n", "tk_n"), "seq").alias("i"))
    chunks = events.where("kind = 'chunk'").groupBy("job").agg(
        F.min_by(F.struct("seq", "ch_n"), "seq").alias("f"), F.max_by(F.struct("seq", "ch_i", "ch_n", "tk_cum", "title"), "seq").alias("c")
    )
    both = init.join(chunks, "job", "full")
    live = F.col("c").isNotNull() & (F.col("i").isNull() | (F.col("c.seq") > F.col("i.seq")))
    one = F.lit(1).cast("long")
    ch_max = F.when(F.col("i").isNotNull(), F.greatest("i.ch_n", one)).otherwise(F.greatest("f.ch_n", one))
    tk_max = F.greatest("i.tk_n", one)
    return both.select(
        "job",
        F.lit(True).alias("started"),
        ch_max.alias("ch_max"),
        F.when(live, F.col("c.ch_i")).otherwise(0).cast("long").alias("ch_val"),
        F.when(live, F.floor(F.col("c.ch_i") * 100 / F.greatest("c.ch_n", one))).otherwise(0).cast("long").alias("pct"),
        tk_max.alias("tk_max"),
        F.when(F.col("i").isNull(), 0).when(live, F.least("c.tk_cum", tk_max)).otherwise(0).cast("long").alias("tk_val"),
        F.when(live, F.col("c.title")).otherwise("starting").alias("label"),
    )


# The forms of log lines, and the labels of the four steps.
LINE_INIT = r"(?:階層並列処理|セクション処理): (\d+)章.*予算([\d,]+)トークン"
LINE_CHUNK = r"\[(\d+)/(\d+)\].*累計([\d,]+)"
LINE_OVER = "トークン予算超過"
LINE_PDF = r"PDF変換:.*\((\d+)/(\d+)チャンク\)"
LINE_STEP = r"\[(\d)/4\]"
STEPS = {1: "読み込み中...", 2: "分割中...", 3: "構造化中...", 4: "書き出し中..."}


def line_events(log: DataFrame, line: str = "line") -> DataFrame:
    """Adds kind (init, chunk, over, pdf, step or null), ch_i, ch_n, tk_n, tk_cum and title of log lines, by the first form that fits."""
    text = F.col(line)
    number = lambda pattern, k: F.regexp_replace(F.regexp_extract(text, pattern, k), ",", "").try_cast("long")
    forms = {"init": LINE_INIT, "chunk": LINE_CHUNK, "over": LINE_OVER, "pdf": LINE_PDF, "step": LINE_STEP}
    kind = F.coalesce(*[F.when(F.rlike(text, F.lit(p)), k) for k, p in forms.items()])
    is_ = lambda k: F.col("kind") == k
    labels = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    return log.withColumn("kind", kind).withColumns(
        {
            "ch_i": F.when(is_("chunk"), number(LINE_CHUNK, 1)).when(is_("pdf"), number(LINE_PDF, 1)).when(is_("step"), number(LINE_STEP, 1)),
            "ch_n": F.when(is_("init"), number(LINE_INIT, 1)).when(is_("chunk"), number(LINE_CHUNK, 2)).when(is_("pdf"), number(LINE_PDF, 2)).when(is_("step"), F.lit(4).cast("long")),
            "tk_n": F.when(is_("init"), number(LINE_INIT, 2)),
            "tk_cum": F.when(is_("chunk"), number(LINE_CHUNK, 3)),
            "title": F.when(is_("step"), F.element_at(labels, number(LINE_STEP, 1).cast("int"))),
        }
    )


def sse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds kind, piece and conversation of server-sent lines ("data: {...}"); other lines and bad JSON have a null kind."""
    body = F.try_parse_json(F.when(F.startswith(line, F.lit("data: ")), F.substring(line, 7, 1 << 30)))
    get = lambda path: F.try_variant_get(body, path, "string")
    return lines.withColumns({"kind": get("$.event"), "piece": get("$.answer"), "conversation": get("$.conversation_id")})


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One job's new events on top of its state."""
    started, ch_max, ch_val, pct, tk_max, tk_val, label = state.get if state.exists else (False, 1, 0, 0, -1, 0, "")
    columns = ["order", "kind", "ch_i", "ch_n", "tk_n", "tk_cum", "title"]
    rows = sorted((r for batch in batches for r in batch[columns].itertuples()), key=lambda r: r.order)
    for r in rows:
        if r.kind == "init":
            started, ch_max, ch_val, pct, tk_max, tk_val, label = True, max(int(r.ch_n), 1), 0, 0, max(int(r.tk_n), 1), 0, "starting"
        elif r.kind == "chunk":
            if not started:
                started, ch_max = True, max(int(r.ch_n), 1)
            ch_val, pct, label = int(r.ch_i), int(r.ch_i) * 100 // max(int(r.ch_n), 1), r.title
            tk_val = min(int(r.tk_cum), tk_max) if tk_max > 0 else 0
    state.update((started, ch_max, ch_val, pct, tk_max, tk_val, label))
    if started:
        yield pd.DataFrame([(key[0], started, ch_max, ch_val, pct, tk_max if tk_max > 0 else None, tk_val, label)], columns=[c.split()[0] for c in STATE.split(", ")])


def stream(events: DataFrame) -> DataFrame:
    """The states of jobs as a stream of updates; `events` as for fold, with a long `order` in place of seq."""
    state = STATE.removeprefix("job long, ")
    return events.groupBy("job").applyInPandasWithState(_step, STATE, state, "update", "NoTimeout")


def answers(chunks: DataFrame, key: list[str], order: list[str], text: str, kind: str) -> DataFrame:
    """(key, answer, pieces, failed): message pieces of a stream in order; pieces after an error do not count."""
    error = F.min(F.when(F.col(kind) == "error", F.struct(*order))).alias("stop")
    pieces = F.sort_array(F.collect_list(F.when(F.col(kind) == "message", F.struct(*order, F.col(text).alias("piece"))))).alias("all")
    folded = chunks.groupBy(*key).agg(error, pieces)
    names = order
    kept = F.filter("all", lambda x: F.col("stop").isNull() | (F.struct(*[x[n] for n in names]) < F.col("stop")))
    return folded.withColumn("kept", kept).select(*key, F.array_join(F.transform("kept", lambda x: x["piece"]), "").alias("answer"), F.size("kept").cast("long").alias("pieces"), F.col("stop").isNotNull().alias("failed"))
