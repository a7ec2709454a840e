"""Queries over tables that are written in several steps, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.tables import for_session, kept, shared_folder
from corpuslab.operators import blocks, code, conversation, coverage, markdown_blocks, prompt, resolve, tree
from corpuslab.operators.extraction_cache import ExtractionCache
from corpuslab.plans.catalog import _SQL_CODE, _SQL_LINES, _SQL_TITLE, _SQL_TOKENS, code_files, query, table
from corpuslab.sources import readers
from corpuslab.sources.versions import VersionedTable
from corpuslab.streaming import reframe


def _folder(spark, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.range(0).write.parquet(f"{path}/begun")
    for_session(spark, path)
    return path


@query(
    "versioned_writeback",
    """WITH last AS (SELECT max(lang) AS lang FROM documents)
SELECT doc_id, d.lang, CASE WHEN d.lang < last.lang THEN 'done' ELSE 'open' END AS state, CASE WHEN d.lang < last.lang THEN 2 * n_chars ELSE n_chars END AS n_chars
FROM documents d, last WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def versioned_writeback(spark, sf_dir):
    """All documents, then one batch for each language; the last one dies before its commit, others come twice, and toxic documents are deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("open").alias("state"), "n_chars")
    held = VersionedTable(spark, _folder(spark, "writeback"), ["doc_id"])
    held.commit(docs, "load", 0)
    languages = [r.lang for r in docs.where("lang is not null").select("lang").distinct().orderBy("lang").collect()]
    numbers = spark.createDataFrame(list(enumerate(languages)), "batch int, lang string")
    work = docs.join(F.broadcast(numbers), "lang").select(*docs.columns, "batch")
    done = lambda df: df.withColumn("state", F.lit("done")).withColumn("n_chars", F.col("n_chars") * 2)
    last = len(languages) - 1
    done(work.where(F.col("batch") == last).drop("batch")).write.parquet(f"{held.path}/data/{uuid.uuid4().hex}")
    held.commit_each(work.where(F.col("batch") < last), "batch", done)
    for k in range(last):
        held.commit(docs.withColumn("state", F.lit("sent again")), "work", k)
    held.commit(docs.limit(0), "clean", 0, deleted=table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return held.read()


_SQL_REVISED = """revised AS (
  SELECT d.doc_id, d.source, CASE WHEN l.quality = 0 THEN 'Revised' || chr(10) || coalesce(d.text, '') ELSE coalesce(d.text, '') END AS text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    "incremental_extraction",
    f"WITH {_SQL_REVISED}, {_SQL_LINES.replace('documents', 'revised')}, {_SQL_TITLE}"
    """, known AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents)
SELECT r.doc_id, t.title, CAST(len(s.lines) AS BIGINT) AS n_lines, CASE WHEN k.text IS NULL THEN 'second' ELSE 'first' END AS run
FROM revised r JOIN titled t USING (doc_id) JOIN split s USING (doc_id) LEFT JOIN known k ON r.text = k.text""",
)
def incremental_extraction(spark, sf_dir):
    """Titles and lines of all documents, extracted again after those of low quality were revised: only what they became is read the second time."""

    def extract(df: DataFrame) -> DataFrame:
        return df.select("content", T.first_line(F.col("text")).alias("title"), F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"))

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("poor"))
    text = F.when(F.col("poor"), F.concat(F.lit("Revised\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    revised = docs.join(poor, "doc_id", "left").select("doc_id", text.alias("text"))
    cache = ExtractionCache(spark, _folder(spark, "extracted"), extract, "titles 1")
    cache.run(docs, "first")
    cache.run(revised, "second")
    cache.collect(revised)
    return cache.results(revised).select("doc_id", "title", "n_lines", "run")


#: Lines of documents as Markdown: by the length of a line a fence, rule, heading, quote, bullet or number, with bold and code within it.
_SQL_MARKDOWN = rf"""{_SQL_LINES},
raw AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS "at" FROM split),
styled AS (SELECT doc_id, "at", replace(replace(line, ' the ', ' **the** '), 'queue', '`queue`') AS line, length(line) % 17 AS r FROM raw),
md AS (
  SELECT doc_id, "at", CASE r WHEN 1 THEN '```' WHEN 2 THEN '---' WHEN 3 THEN '## ' || line WHEN 4 THEN '> ' || line WHEN 5 THEN '    - ' || line WHEN 6 THEN '3. ' || line ELSE line END AS line
  FROM styled),
fenced AS (SELECT *, starts_with(line, '```') AS fence, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY "at") % 2 = 1 AS inside FROM md),
kinds AS (
  SELECT doc_id, "at", line, CASE WHEN fence THEN 'fence' WHEN inside THEN 'code' WHEN regexp_full_match(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[-*_]{{3,}}') THEN 'rule'
           WHEN regexp_matches(line, '^#{{1,4}}\s+') THEN 'heading' WHEN starts_with(line, '> ') THEN 'quote' WHEN regexp_matches(line, '^\s*[-*+]\s+') THEN 'bullet'
           WHEN regexp_matches(line, '^\s*\d+\.\s+') THEN 'number' ELSE 'text' END AS kind
  FROM fenced),
shown AS (
  SELECT doc_id, "at", kind, CASE kind WHEN 'heading' THEN length(regexp_extract(line, '^#+')) WHEN 'bullet' THEN length(regexp_extract(line, '^\s*')) // 2 END AS level,
         CASE kind WHEN 'fence' THEN '' WHEN 'rule' THEN '' WHEN 'heading' THEN regexp_replace(line, '^#+\s+', '') WHEN 'quote' THEN line[3:] WHEN 'bullet' THEN regexp_replace(line, '^\s*[-*+]\s+', '') ELSE line END AS content
  FROM kinds)"""


@query(
    "markdown_blocks",
    rf"""WITH {_SQL_MARKDOWN} SELECT doc_id, CAST("at" AS BIGINT) AS "at", kind, CAST(level AS INT) AS level, content,
len(list_filter(regexp_extract_all(content, '\*\*[^*\n]+\*\*|`[^`\n]+`'), lambda x: x[1] = '*')) AS n_bold,
len(list_filter(regexp_extract_all(content, '\*\*[^*\n]+\*\*|`[^`\n]+`'), lambda x: x[1] = '`')) AS n_code FROM shown""",
)
def markdown_blocks_query(spark, sf_dir):
    """Kinds of all lines of documents that were made Markdown."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "line"))
    line, r = F.replace(F.replace("line", F.lit(" the "), F.lit(" **the** ")), F.lit("queue"), F.lit("`queue`")), F.length("line") % 17
    made = F.when(r == 1, "```").when(r == 2, "---")
    for k, lead in ((3, "## "), (4, "> "), (5, "    - "), (6, "3. ")):
        made = made.when(r == k, F.concat(F.lit(lead), line))
    found = markdown_blocks.classify(lines.select("doc_id", "at", made.otherwise(line).alias("line")), ["doc_id"])
    count = lambda style: F.size(F.filter(markdown_blocks.spans(F.col("content")), lambda s: s["style"] == style)).cast("long")
    return found.withColumns({"n_bold": count("bold"), "n_code": count("code")})


def _package_files(spark, sf_dir):
    """A Python package for each source, with a module for each document: all have a function `step`, and name others' by imports."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.size(T.lines(F.col("text"))).alias("n"))
    order = Window.partitionBy("source").orderBy("doc_id")
    each = docs.withColumns({"before": F.lag("doc_id").over(order), "first": F.min("doc_id").over(Window.partitionBy("source"))})
    back = F.coalesce(F.format_string("from .m%d import step as before\n", F.col("before")), F.lit(""))
    body = F.format_string("from %s import begin\n\ndef step(x):\n    return x\n\ndef f_%d(x):\n    before(x); step(x); begin(x); gone_%d(x)\n", "source", "doc_id", "n")
    modules = each.select(F.format_string("%s/m%d.py", "source", "doc_id").alias("path"), F.concat(back, body).alias("text"))
    packages = each.where("doc_id = first").select(F.concat("source", F.lit("/__init__.py")).alias("path"), F.format_string("from .m%d import step as begin\n", "first").alias("text"))
    return modules.unionByName(packages).select("path", F.lit("py").alias("lang"), F.col("text").alias("source"))


@query(
    "code_resolved_calls",
    rf"""WITH {_SQL_LINES},
each AS (
  SELECT coalesce(source, 'none') AS source, d.doc_id, len(lines) AS n, lag(d.doc_id) OVER (PARTITION BY coalesce(source, 'none') ORDER BY d.doc_id) AS before, min(d.doc_id) OVER (PARTITION BY coalesce(source, 'none')) AS first
  FROM documents d JOIN split USING (doc_id)),
calls AS (
  SELECT *, 'before' AS callee, before AS target, CASE WHEN before IS NOT NULL THEN 'name' END AS how FROM each
  UNION ALL SELECT *, 'step', doc_id, 'local' FROM each UNION ALL SELECT *, 'begin', first, 'name' FROM each UNION ALL SELECT *, 'gone_' || n, NULL, NULL FROM each)
SELECT source || '/m' || doc_id || '.py' AS path, 'f_' || doc_id AS caller, callee, source || '/m' || target || '.py' AS callee_path, CASE WHEN target IS NOT NULL THEN 'step' END AS callee_name, how
FROM calls""",
)
def code_resolved_calls(spark, sf_dir):
    """The files of all called functions, where every file has one of the same name."""
    found = kept(code.symbols(_package_files(spark, sf_dir)), "symbols")
    return resolve.resolve_calls(found).drop("line")


_SQL_TREE = r"""WITH page AS (
  SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '' AND x <> '.') AS parts, strlen(html) AS bytes FROM pages),
once AS (SELECT parts, CAST(sum(bytes) AS BIGINT) AS bytes FROM page WHERE len(parts) > 0 GROUP BY parts),
above AS (SELECT parts[:k] AS parts, bytes FROM (SELECT parts, bytes, unnest(range(1, len(parts))) AS k FROM once)),
dirs AS (SELECT parts, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM above GROUP BY parts),
below AS (SELECT parts[:k] AS parts, count(*) AS folders FROM (SELECT parts, unnest(range(1, len(parts))) AS k FROM dirs) GROUP BY parts[:k]),
entry AS (SELECT parts, true AS folder, bytes FROM dirs UNION ALL SELECT parts, false, bytes FROM once),
keyed AS (
  SELECT parts, folder, bytes, array_to_string(list_transform(parts, lambda x, i: CASE WHEN folder OR i < len(parts) THEN '0' ELSE '1' END || x), chr(1)) AS key FROM entry),
ending AS (SELECT *, key = max(key) OVER (PARTITION BY parts[:len(parts) - 1]) AS last FROM keyed),
bars AS (
  SELECT e.key, string_agg(CASE WHEN f.last THEN '    ' ELSE '│   ' END, '' ORDER BY len(f.parts)) AS bars
  FROM ending e JOIN ending f ON f.folder AND len(f.parts) < len(e.parts) AND f.parts = e.parts[:len(f.parts)] GROUP BY e.key)"""


def _pages_as_files(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").alias("length"))


@query(
    "project_tree",
    _SQL_TREE
    + r""" SELECT key, coalesce(bars, '') || CASE WHEN last THEN '└── ' ELSE '├── ' END || CASE WHEN folder THEN parts[-1] || '/' ELSE parts[-1] || ' (' || format('{:,}', bytes) || 'B)' END AS line
FROM ending LEFT JOIN bars USING (key)""",
)
def project_tree(spark, sf_dir):
    """All pages as a drawn tree of hosts and paths."""
    return tree.draw(tree.entries(_pages_as_files(spark, sf_dir)), most_depth=50)


@query("project_folders", _SQL_TREE + " SELECT array_to_string(dirs.parts, '/') AS path, files, coalesce(folders, 0) AS folders, bytes FROM dirs LEFT JOIN below USING (parts)")
def project_folders(spark, sf_dir):
    return tree.entries(_pages_as_files(spark, sf_dir)).where("folder").select("path", "files", "folders", "bytes")


@query(
    "sse_transcode",
    """WITH line AS (
  SELECT user_id AS stream, 2 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS n, event_id,
         CASE event_type WHEN 'click' THEN 'message' WHEN 'view' THEN 'message' WHEN 'purchase' THEN 'message_end' WHEN 'error' THEN 'error' ELSE 'ping' END AS kind
  FROM events),
ending AS (SELECT stream, min(n) AS stop FROM line WHERE kind = 'message_end' GROUP BY stream)
SELECT stream, CAST(n AS BIGINT) AS n, part, CASE WHEN kind = 'message' THEN 'é' || event_id || ' 東' END AS content, CASE WHEN kind = 'message_end' AND part = 0 THEN 'stop' END AS finish
FROM line LEFT JOIN ending USING (stream), (VALUES (0), (1)) AS parts(part)
WHERE (stop IS NULL OR n <= stop) AND (kind = 'message_end' OR (kind = 'message' AND part = 0))""",
)
def sse_transcode(spark, sf_dir):
    """The events of every user as a stream of bytes, cut every 13 of them, put together again and made chunks up to its first end."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "message").when(F.col("event_type") == "purchase", "message_end").when(F.col("event_type") == "error", "error").otherwise("ping")
    line = F.format_string('data: {"event": "%s", "answer": "é%d 東"}\n\n', kind, "event_id")
    each = events.groupBy(F.col("user_id").alias("stream")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line")))).alias("lines"))
    whole = each.select("stream", F.encode(F.array_join("lines.line", ""), "UTF-8").alias("raw"))
    count = F.ceil(F.octet_length("raw") / 13).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.cast("long").alias("seq"), F.substring("raw", i * 13 + 1, F.lit(13)).alias("data"), (i == count - 1).alias("last")))
    pieces = whole.select("stream", F.inline(cut))
    found = reframe.until_done(reframe.transcode(reframe.lines(pieces)))
    choice = F.try_parse_json(F.substring("out", len(reframe.LEAD) + 1, 1 << 30))
    get = lambda path: F.try_variant_get(choice, path, "string")
    return found.select("stream", "n", "part", get("$.choices[0].delta.content").alias("content"), get("$.choices[0].finish_reason").alias("finish"))


PROMPT_BUDGET, MEMORY_LIMIT = 600, 200
_SECTIONS = [prompt.Section("memory", "Memory", limit=MEMORY_LIMIT), prompt.Section("index", "Index", "(none)"), prompt.Section("tasks", "Tasks")]


@query(
    "prompt_assembly",
    rf"""WITH each AS (
  SELECT conv_id, CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS priority, turn AS "at", coalesce(CASE role WHEN 'user' THEN '- [ ] ' || left(text, 60) ELSE left(text, 120) END, '') AS text
  FROM conversations),
limited AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id, priority ORDER BY "at", text ROWS UNBOUNDED PRECEDING) AS own FROM each),
fit AS (
  SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY priority, "at", text ROWS UNBOUNDED PRECEDING) AS used
  FROM limited WHERE own <= CASE priority WHEN 0 THEN {MEMORY_LIMIT} ELSE {PROMPT_BUDGET} END),
parts AS (SELECT conv_id, priority, string_agg(text, chr(10) ORDER BY "at", text) AS t, count(*) AS n, sum(length(text)) AS c FROM fit WHERE used <= {PROMPT_BUDGET} GROUP BY conv_id, priority),
whole AS (
  SELECT conv_id, max(t) FILTER (priority = 0) AS memory, max(t) FILTER (priority = 1) AS index, max(t) FILTER (priority = 2) AS tasks, sum(n) AS n, sum(c) AS c FROM parts GROUP BY conv_id)
SELECT k.conv_id, concat_ws(chr(10) || chr(10), '## Memory' || chr(10) || chr(10) || memory, '## Index' || chr(10) || chr(10) || coalesce(index, '(none)'), '## Tasks' || chr(10) || chr(10) || tasks) AS prompt,
       CAST(coalesce(n, 0) AS BIGINT) AS rows, CAST(coalesce(c, 0) AS BIGINT) AS cost
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN whole USING (conv_id)""",
)
def prompt_assembly(spark, sf_dir):
    """For every conversation a prompt of what was answered (memory), its system turns (index) and its open questions (tasks)."""
    role = F.col("role")
    section = F.when(role == "assistant", "memory").when(role == "system", "index").otherwise("tasks")
    text = F.when(role == "user", F.concat(F.lit("- [ ] "), F.left("text", F.lit(60)))).otherwise(F.left("text", F.lit(120)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", section.alias("section"), F.col("turn").alias("at"), text.alias("text"))
    return prompt.assemble(rows, "conv_id", _SECTIONS, budget=PROMPT_BUDGET)


@query(
    "message_normalise",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'tool' ELSE role END AS role, CASE WHEN role = 'user' THEN coalesce(text, '') || chr(10) || 'more' WHEN role = 'assistant' AND turn % 2 = 0 THEN NULL ELSE coalesce(text, '') END AS content,
CASE role WHEN 'system' THEN 'call_0' END AS tool_call_id, CASE WHEN role = 'assistant' AND turn % 2 = 0 THEN '[{"id":"c' || turn || '"}]' END AS tool_calls FROM conversations""",
)
def message_normalise(spark, sf_dir):
    """Messages as JSON in three dialects, made alike: users' texts as lists of parts, every other answer a call, system turns as results of tools."""
    role = F.col("role")
    none = {"ignoreNullFields": "false"}
    user = F.to_json(F.struct(role, F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")), F.struct(F.lit("text").alias("type"), F.lit("more").alias("text"))).alias("content")))
    called = F.to_json(F.struct(role, F.lit(None).cast("string").alias("content"), F.array(F.struct(F.format_string("c%d", "turn").alias("id"))).alias("tool_calls")), none)
    tool = F.to_json(F.struct(F.lit("tool").alias("role"), F.col("text").alias("content")), none)
    message = F.when(role == "user", user).when((role == "assistant") & (F.col("turn") % 2 == 0), called).when(role == "system", tool).otherwise(F.to_json(F.struct(role, F.col("text").alias("content")), none))
    return prompt.normalise(table(spark, sf_dir, "conversations").select("conv_id", "turn", message.alias("message"))).drop("message")


_SQL_BOXES = """boxes AS (
  SELECT l_orderkey AS page, CAST(l_linenumber * 30 + l_suppkey % 25 AS DOUBLE) AS y0, CAST(l_partkey % 400 AS DOUBLE) AS x0,
         CAST(l_linenumber * 30 + l_suppkey % 25 + 12 AS DOUBLE) AS y1, CAST(l_partkey % 400 + l_quantity * 4 AS DOUBLE) AS x1 FROM lineitem)"""
_SQL_SWEEP = """{0} AS (SELECT *, sum(fresh) OVER (PARTITION BY page, {3} ORDER BY {1}, {2}, x0, y0, x1, y1 ROWS UNBOUNDED PRECEDING) AS s_{0} FROM (
  SELECT *, CASE WHEN {1} > max({2}) OVER (PARTITION BY page, {3} ORDER BY {1}, {2}, x0, y0, x1, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM {4}))"""


def _sql_sweeps(n: int) -> str:
    """`n` pairs of sweeps: as many as the lines of an order can take, which have at most seven boxes."""
    out, before, marks = [], "boxes", "1"
    for k in range(2 * n):
        begin, end = ("y0", "y1") if k % 2 == 0 else ("x0", "x1")
        name = f"w{k}"
        out.append(_SQL_SWEEP.format(name, begin, end, marks, before).replace("SELECT *, CASE", "SELECT * EXCLUDE (fresh), CASE" if k else "SELECT *, CASE"))
        before, marks = name, f"{marks}, s_{name}" if marks != "1" else f"s_{name}"
    return ", ".join(out) + f", blocks AS (SELECT page, count(*) AS boxes, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {before} GROUP BY page, {marks})"


@query("page_blocks", f"WITH {_SQL_BOXES}, {_sql_sweeps(4)} SELECT page, row_number() OVER (PARTITION BY page ORDER BY y0, x0, y1, x1) - 1 AS block, boxes, x0, y0, x1, y1 FROM blocks")
def page_blocks(spark, sf_dir):
    """Orders as pages, their lines as boxes: which of them make one block."""
    at, down = F.col("l_partkey") % 400, F.col("l_linenumber") * 30 + F.col("l_suppkey") % 25
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), at.alias("x0"), down.alias("y0"), (at + F.col("l_quantity") * 4).alias("x1"), (down + 12).alias("y1"))
    return blocks.merged(boxes, ["page"], gap=1.0).withColumn("block", F.col("block").cast("long"))


@query(
    "block_texts",
    """SELECT conv_id, coalesce(regexp_replace(string_agg(coalesce(text, ''), ' ' ORDER BY turn, text), '^\\s+|\\s+$', '', 'g'), '') AS text, greatest(9.0, max(CAST(turn % 17 AS DOUBLE))) AS size, count(*) AS spans,
CAST(min(turn) AS DOUBLE) AS x0, CAST(min(length(coalesce(text, ''))) AS DOUBLE) AS y0, CAST(max(turn + 5) AS DOUBLE) AS x1, CAST(max(length(coalesce(text, '')) + 2) AS DOUBLE) AS y1
FROM conversations WHERE role <> 'system' GROUP BY conv_id""",
)
def block_texts(spark, sf_dir):
    """Conversations as blocks, their turns as spans: text, largest size and box; system turns stand for pictures."""
    size, long = F.col("turn").cast("double"), F.length(F.coalesce("text", F.lit(""))).cast("double")
    spans = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("role") == "system", 1).otherwise(0).alias("kind"), (size % 17).alias("size"), size.alias("x0"), long.alias("y0"), (size + 5).alias("x1"), (long + 2).alias("y1"))
    return blocks.summed(blocks.text_only(spans), ["conv_id"], ["turn"])


@query(
    "code_skeleton_text",
    _SQL_CODE
    + """ SELECT path, line, text FROM imported UNION ALL SELECT path, 4 * i - CASE lang WHEN 'py' THEN 0 ELSE 2 END,
CASE lang WHEN 'py' THEN 'def ' || name || '(x):' || chr(10) || '    ...' WHEN 'js' THEN 'function ' || name || '(x) { ... }' ELSE 'static int ' || name || '(int x) { ... }' END FROM once""",
)
def code_skeleton_text(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return code.skeleton_text(files, kept(code.symbols(files, ("py", "c", "js")), "symbols"))


@query(
    "delimited_tables",
    """WITH line AS (
  SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, '| ' || c_custkey || ' | ' || c_name || ', "' || c_mktsegment || '" x | a\\|b c |' AS line FROM customer)
SELECT 'n' || c_nationkey || '.csv' AS path, '| key | the "name" | note |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY k) FILTER (k <= 100)
       || CASE WHEN count(*) > 100 THEN chr(10) || '(100 of ' || count(*) || ' rows)' ELSE '' END AS text FROM line GROUP BY c_nationkey""",
)
def delimited_tables(spark, sf_dir):
    """The customers of each nation as a delimited file with quoted separators, quotes and line breaks, read as a table."""
    row = F.format_string('%d,"%s, ""%s"" x","a|b\nc"\n', "c_custkey", "c_name", "c_mktsegment")
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row"))))
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(rows, lambda x: x["row"]), "").alias("rows"))
    text = F.concat(F.lit('key,"the ""name""",note\n'), "rows")
    return readers.as_markdown(files.select(F.format_string("n%d.csv", "c_nationkey").alias("path"), F.lit(".csv").alias("ext"), text.alias("text"))).select("path", "text")


@query(
    "open_contents",
    """WITH first AS (SELECT source, min(doc_id) AS first FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source)
SELECT source, CAST(n_chars % 3 + 1 AS BIGINT) AS level, 'p. ' || doc_id AS title, doc_id AS page FROM documents JOIN first USING (source) WHERE n_chars % 3 < 2 AND doc_id >= first
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 50""",
)
def open_contents(spark, sf_dir):
    """Sources as documents with a table of contents, whose toxic pages are open: the first fifty headings from there on."""
    docs = table(spark, sf_dir, "documents")
    contents = docs.select("source", (F.col("n_chars") % 3 + 1).alias("level"), F.format_string("p. %d", "doc_id").alias("title"), F.col("doc_id").alias("page"))
    gaps = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("source", F.col("doc_id").alias("lo"), F.col("doc_id").alias("hi"))
    return coverage.open_contents(contents, gaps, "source")


_SQL_CALL = """CASE role WHEN 'assistant' THEN '[{"name": "f", "args": {"turn": ' || turn || '}}]' END"""


@query(
    "token_totals_with_calls",
    f"""SELECT *, round(tokens / 2000.0, 6) AS ratio, tokens / 2000.0 >= 0.92 AS needs_compaction FROM (
SELECT conv_id, count(*) AS messages, CAST(sum({_SQL_TOKENS} + {_SQL_TOKENS.replace('text', _SQL_CALL)}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)""",
)
def token_totals_with_calls(spark, sf_dir):
    """Tokens of conversations whose answers carry tool calls."""
    call = F.when(F.col("role") == "assistant", F.format_string('[{"name": "f", "args": {"turn": %d}}]', "turn"))
    return conversation.usage(table(spark, sf_dir, "conversations").withColumn("calls", call), limit=2000, calls="calls")
