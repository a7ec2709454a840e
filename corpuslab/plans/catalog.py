"""Queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.tables import kept
from corpuslab.operators import batching, conversation, corpus, coverage, relations

PATTERN = "keit|tion on"
SEARCH = "the tion heit queue"
BUDGET = 4000
#: Line numbers repeat within an order, so further columns settle ties.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_SQL_LINES = """split AS (
  SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS lines
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM documents))"""

_SQL_GREP = f"""WITH {_SQL_LINES},
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM split),
hit AS (SELECT *, regexp_matches(line, '(?i){PATTERN}') AS hit FROM line),
near AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM hit),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM near WHERE near = 1),
found AS (
  SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS island, i, hit,
         CASE WHEN length(CAST(i AS VARCHAR)) < 4 THEN lpad(CAST(i AS VARCHAR), 4, ' ') ELSE CAST(i AS VARCHAR) END
           || CASE WHEN hit THEN ' >>> ' ELSE '     ' END || regexp_replace(line, '\\s+$', '') AS shown FROM island),
grep AS (
  SELECT doc_id, island, min(i) AS first_line, max(i) AS last_line, count(*) FILTER (hit) AS n_hits, string_agg(shown, chr(10) ORDER BY i) AS snippet
  FROM found GROUP BY doc_id, island)"""


def _grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grep(table(spark, sf_dir, "documents"), PATTERN)


@query("grep_context_islands", _SQL_GREP + " SELECT * FROM grep")
def grep_context_islands(spark, sf_dir):
    return _grep(spark, sf_dir)


@query("grep_page2", _SQL_GREP + ", pages AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM (SELECT DISTINCT doc_id FROM grep)) SELECT grep.* FROM grep JOIN pages USING (doc_id) WHERE r BETWEEN 21 AND 40")
def grep_page2(spark, sf_dir):
    return corpus.page_of(_grep(spark, sf_dir), 2)


_SQL_TITLE = """titled AS (
  SELECT doc_id, coalesce(left(list_filter(list_transform(lines, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^#+', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], 100), '(no summary)') AS title
  FROM split)"""


@query("corpus_list_first_line", f"WITH {_SQL_LINES}, {_SQL_TITLE} SELECT d.doc_id, source AS scope, title FROM documents d JOIN titled USING (doc_id)")
def corpus_list_first_line(spark, sf_dir):
    return corpus.listing(table(spark, sf_dir, "documents"))


@query(
    "search_topk_scored",
    f"WITH {_SQL_LINES}, {_SQL_TITLE}, scored AS (SELECT d.doc_id, source AS scope, title, "
    + " + ".join(f"CAST(contains(lower(title), '{w}') AS INT)" for w in SEARCH.split())
    + " AS score FROM documents d JOIN titled USING (doc_id)) SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10",
)
def search_topk_scored(spark, sf_dir):
    return corpus.search(corpus.listing(table(spark, sf_dir, "documents")), SEARCH)


@query("read_by_key", "SELECT * FROM documents WHERE doc_id = 7")
def read_by_key(spark, sf_dir):
    return corpus.read(table(spark, sf_dir, "documents"), 7)


@query(
    "doc_stats_by_scope",
    f"""WITH {_SQL_LINES}, stats AS (SELECT source AS scope, count(*) AS n_docs, CAST(sum(len(lines)) AS BIGINT) AS n_lines, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes
FROM documents JOIN split USING (doc_id) GROUP BY source)
SELECT *, CASE WHEN n_bytes < 1024 THEN n_bytes || ' B' WHEN n_bytes < 1048576 THEN printf('%.1f', n_bytes / 1024.0) || ' KB' ELSE printf('%.1f', n_bytes / 1048576.0) || ' MB' END AS size FROM stats""",
)
def doc_stats_by_scope(spark, sf_dir):
    return corpus.scope_stats(table(spark, sf_dir, "documents"))


@query(
    "slug_names",
    r"""SELECT page_id, left(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1'), '[^\p{L}\p{N}_\x{3000}-\x{9fff}-]', '_', 'g'), 50) AS name,
CASE WHEN regexp_extract(url, '[^/]*$') = '' THEN 'unknown' ELSE regexp_replace(regexp_extract(url, '[^/]*$'), '[^A-Za-z0-9_]', '_', 'g') END AS id FROM pages""",
)
def slug_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("name"), T.mermaid_id(F.col("url")).alias("id"))


@query("latest_50", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def latest_50(spark, sf_dir):
    newest = table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(50)
    return newest.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "event_type")


@query(
    "index_upsert",
    "SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labelled' AS source, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS lang FROM labels",
)
def index_upsert(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("source"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("lang"))
    return corpus.upsert(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), new, "doc_id")


@query("index_delete", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_delete(spark, sf_dir):
    return corpus.delete(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query(
    "fk_violations",
    """SELECT 'line without order' AS rule, CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS row, CAST(l_orderkey AS VARCHAR) AS value FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'order without customer', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT 'line without supplier', CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber, CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""",
)
def fk_violations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("line", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    orders, customers, suppliers = (table(spark, sf_dir, n) for n in ("orders", "customer", "supplier"))
    return relations.violations(
        relations.dangling(lines, "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey", "line without order", "line"),
        relations.dangling(orders, "o_custkey", customers.where("c_acctbal >= 0"), "c_custkey", "order without customer", "o_orderkey"),
        relations.dangling(lines, "l_suppkey", suppliers.where("s_acctbal >= 0"), "s_suppkey", "line without supplier", "line"),
    )


_PACKED = """packed AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS bits,
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lineitem)"""


def _packed(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, F.col("l_quantity").cast("long").alias("bits"))
    return relations.running_offset(parts, "l_orderkey", LINE_ORDER, "bits").select("l_orderkey", "l_linenumber", "bits", "offset")


@query("running_offset", f"WITH {_PACKED} SELECT * FROM packed")
def running_offset(spark, sf_dir):
    return _packed(spark, sf_dir)


@query("next_offset", f'WITH {_PACKED} SELECT l_orderkey, max("offset" + bits) AS next_offset FROM packed GROUP BY l_orderkey')
def next_offset(spark, sf_dir):
    return relations.next_offset(_packed(spark, sf_dir), "l_orderkey", "offset", "bits")


@query("overflow_check", f"""WITH {_PACKED}, frames AS (SELECT o_orderkey, 8 + o_orderkey % 8 AS size FROM orders)
SELECT l_orderkey, l_linenumber, bits, "offset", size AS frame_bytes FROM packed JOIN frames ON l_orderkey = o_orderkey WHERE "offset" + bits > size * 8""")
def overflow_check(spark, sf_dir):
    frames = table(spark, sf_dir, "orders").select("o_orderkey", (8 + F.col("o_orderkey") % 8).alias("size"))
    return relations.overflows(frames, "o_orderkey", "size", _packed(spark, sf_dir), "l_orderkey", "offset", "bits")


@query("cascade_delete", """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def cascade_delete(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return relations.cascade(rows, [("c_nationkey", nations, "n_nationkey"), ("c_custkey", orders, "o_custkey")])


@query("blank_references", "SELECT s_suppkey, CASE WHEN s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN s_nationkey END AS s_nationkey FROM supplier")
def blank_references(spark, sf_dir):
    return relations.blank_references(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", table(spark, sf_dir, "nation").where("n_regionkey = 2"), "n_nationkey")


_PICK = "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber {0}, l_partkey {0}, l_suppkey {0}, l_quantity {0}) = 1"


@query("first_wins_dedupe", _PICK.format("ASC"))
def first_wins_dedupe(spark, sf_dir):
    return relations.first_wins(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE_ORDER, ["l_partkey", "l_quantity"])


@query("last_wins_assignment", _PICK.format("DESC"))
def last_wins_assignment(spark, sf_dir):
    return relations.last_wins(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE_ORDER, ["l_partkey", "l_quantity"])


def _batches(spark, sf_dir, barrier):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.contains("text", F.lit(" | ")).alias("has_table"))
    return batching.greedy_batches(rows, ["source"], "doc_id", "n_chars", BUDGET, barrier)


def _sql_batches(barrier: str) -> str:
    return f"""WITH RECURSIVE rows_ AS (
  SELECT source, doc_id, n_chars, {barrier} AS alone, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
fold AS (
  SELECT source, doc_id, n_chars, r, alone, CAST(0 AS BIGINT) AS batch, n_chars AS used FROM rows_ WHERE r = 1
  UNION ALL
  SELECT x.source, x.doc_id, x.n_chars, x.r, x.alone,
         f.batch + CASE WHEN f.alone OR x.alone OR f.used + x.n_chars > {BUDGET} THEN 1 ELSE 0 END,
         CASE WHEN f.alone OR x.alone OR f.used + x.n_chars > {BUDGET} THEN x.n_chars ELSE f.used + x.n_chars END
  FROM fold f JOIN rows_ x ON x.source = f.source AND x.r = f.r + 1)
SELECT source, doc_id, n_chars, batch FROM fold"""


@query("greedy_budget_batches", _sql_batches("false"))
def greedy_budget_batches(spark, sf_dir):
    return _batches(spark, sf_dir, None)


@query("greedy_batches_with_barriers", _sql_batches("contains(text, ' | ')"))
def greedy_batches_with_barriers(spark, sf_dir):
    return _batches(spark, sf_dir, "has_table")


@query("framed_encode_decode", "SELECT source, doc_id // 20 AS batch, doc_id AS page, regexp_replace(text, '\\n=== PAGE ', chr(10) || '=== PAGE ', 'g') AS text FROM documents")
def framed_encode_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 20).alias("batch"), "doc_id", "text")
    return batching.unframe(batching.frame(rows, ["source", "batch"], "doc_id", "text", "doc_id"), ["source", "batch"])


@query("resume_antijoin", "SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150)")
def resume_antijoin(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return batching.pending(events.select("event_id", "user_id", "event_type"), events.where("value > 150"), "user_id")


@query(
    "rolling_throughput",
    """SELECT user_id, event_id, units, CASE WHEN s > 0 THEN round(u / s * 60, 6) END AS per_minute, CASE WHEN s > 0 THEN round(greatest(500 - d, 0) / (u / s * 60), 6) END AS minutes_left FROM (
SELECT user_id, event_id, units, sum(units) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d, CAST(sum(units) OVER w AS DOUBLE) AS u, epoch_us(ts) / 1e6 - epoch_us(first_value(ts) OVER w) / 1e6 AS s
FROM (SELECT *, event_id % 5 + 1 AS units FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""",
)
def rolling_throughput(spark, sf_dir):
    done = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 5 + 1).alias("units"), F.lit(500).alias("all"))
    return batching.throughput(done, "user_id", "ts", "units", tie="event_id", total="all").drop("ts", "all")


_TOKENS = r"[\p{L}\p{N}_]{1,4}|[^\s\p{L}\p{N}_]"
_SQL_TOKENS = f"floor(len(regexp_extract_all(coalesce(text, ''), '{_TOKENS}')) * 110 / 100)"


@query("tier1_clear", """SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND r > 2 THEN '[cleared]' ELSE text END AS text FROM (
SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)""")
def tier1_clear(spark, sf_dir):
    return conversation.clear_old(table(spark, sf_dir, "conversations"), "assistant", keep=2)


@query("last_k_results", "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_k_results(spark, sf_dir):
    return conversation.last_messages(table(spark, sf_dir, "conversations"), "assistant", 3)


@query("trailing_run", "SELECT c.* FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role <> 'assistant' GROUP BY conv_id) l USING (conv_id) WHERE role = 'assistant' AND turn > coalesce(last, -1)")
def trailing_run(spark, sf_dir):
    return conversation.trailing_run(table(spark, sf_dir, "conversations"), "assistant").select("conv_id", "turn", "role", "text")


@query("last_user_message", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_user_message(spark, sf_dir):
    return conversation.last_of(table(spark, sf_dir, "conversations"))


_COMPRESSED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\|[^\n]*\|[^\n]*\n', '', 'g'), '(?m)^[=\-*]{3,}$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("tier2_compress", f"SELECT doc_id, {_COMPRESSED} AS text FROM documents")
def tier2_compress(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", conversation.compress(F.col("text")).alias("text"))


@query("token_totals", f"""SELECT *, round(tokens / 2000.0, 6) AS ratio, tokens / 2000.0 >= 0.92 AS needs_compaction FROM (
SELECT conv_id, count(*) AS messages, CAST(sum({_SQL_TOKENS}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)""")
def token_totals(spark, sf_dir):
    return conversation.usage(table(spark, sf_dir, "conversations"), limit=2000)


_CUT = r"""CASE WHEN len(regexp_extract_all(coalesce({0}, ''), '{1}')) <= {2} THEN {0} ELSE
array_to_string(list_slice(regexp_extract_all({0}, '{3}'), 1, {2} // 2), '') || chr(10) || chr(10) || '... [cut] ...' || chr(10) || chr(10) ||
array_to_string(list_slice(regexp_extract_all({0}, '{3}'), len(regexp_extract_all({0}, '{3}')) - {2} // 2 + 1, len(regexp_extract_all({0}, '{3}'))), '') END"""
_PIECE = r"[\p{L}\p{N}_]{1,4}\s*|[^\s\p{L}\p{N}_]\s*|^\s+"
_SQL_CUT = lambda value, most: _CUT.format(value, _TOKENS, most, _PIECE)
_TIERS = rf"""tier0 AS (SELECT conv_id, turn, role, text, sum({_SQL_TOKENS}) OVER (PARTITION BY conv_id) / 800.0 >= 0.92 AS over FROM conversations),
tier1 AS (SELECT *, sum({_SQL_TOKENS}) OVER (PARTITION BY conv_id) / 800.0 >= 0.92 AS over FROM (
  SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) > 2 THEN '[cleared]' ELSE text END AS text FROM tier0 WHERE over)),
packed_ AS (SELECT conv_id, turn, role, {_COMPRESSED} AS c, text FROM tier1 WHERE over),
tier2 AS (SELECT *, sum({_SQL_TOKENS}) OVER (PARTITION BY conv_id) / 800.0 >= 0.92 AS over FROM (
  SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND text <> '[cleared]' THEN {_SQL_CUT('c', 60)} ELSE text END AS text FROM packed_))"""


@query("compaction_cascade", f"""WITH {_TIERS} SELECT conv_id, turn, role, text, 0 AS tier FROM tier0 WHERE NOT over
UNION ALL SELECT conv_id, turn, role, text, 1 FROM tier1 WHERE NOT over UNION ALL SELECT conv_id, turn, role, text, 2 FROM tier2""")
def compaction_cascade(spark, sf_dir):
    return conversation.compact(table(spark, sf_dir, "conversations"), "assistant", limit=800, keep=2, most=60)


_PROMPT, _PROMPT_SHORT = "You help.\n## Index\na\nb\n## Rules\nBe brief.", "You help.\n## Rules\nBe brief."


@query("compaction_rebuild", rf"""WITH recent AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS place FROM (
  SELECT * FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)),
results AS (SELECT conv_id, place AS turn, role, {_SQL_CUT('text', '(150 // n)')} AS text FROM recent),
made AS (SELECT conv_id, count(*) || ' messages; last request: ' || coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS text FROM conversations GROUP BY conv_id),
spent AS (SELECT conv_id, sum({_SQL_TOKENS}) AS spent FROM results GROUP BY conv_id),
level AS (SELECT conv_id, text, CASE WHEN (coalesce(spent, 0) + t + 26) / 200.0 < 0.92 THEN 0 WHEN (coalesce(spent, 0) + t + 19) / 200.0 < 0.92 THEN 1 ELSE 2 END AS level
  FROM (SELECT conv_id, text, {_SQL_TOKENS} AS t FROM made) LEFT JOIN spent USING (conv_id))
SELECT conv_id, 0 AS turn, 'system' AS role, '[context compacted]' || chr(10) || chr(10) || CASE level WHEN 0 THEN '{_PROMPT}' ELSE '{_PROMPT_SHORT}' END AS text FROM level
UNION ALL SELECT conv_id, 1, 'assistant', CASE WHEN level < 2 THEN text ELSE {_SQL_CUT('text', 50)} END FROM level
UNION ALL SELECT conv_id, turn, role, text FROM results WHERE conv_id IN (SELECT conv_id FROM level WHERE level < 2)""")
def compaction_rebuild(spark, sf_dir):
    return conversation.rebuild(table(spark, sf_dir, "conversations"), "assistant", _PROMPT, ["Index"], limit=200, keep=3, most=150)


_RANGES = "ranges AS (SELECT source, 1000 AS total, greatest(doc_id % 997, 1) AS lo, least(doc_id % 997 + n_chars % 7, 1000) AS hi FROM documents)"
_MERGED = f"""{_RANGES}, marked AS (SELECT source, lo, hi, CASE WHEN lo > max(hi) OVER w + 1 THEN 1 ELSE 0 END AS new FROM ranges WINDOW w AS (PARTITION BY source ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM marked),
merged AS (SELECT source, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY source, g)"""


def _covered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranges = docs.select("source", F.lit(1000).cast("long").alias("total"), (F.col("doc_id") % 997).alias("lo"), (F.col("doc_id") % 997 + F.col("n_chars") % 7).alias("hi"))
    clamped = coverage.clamp(ranges, "source", "total")
    return coverage.merge(clamped.distinct(), "source"), ranges.select("source", "total").distinct()


@query("coverage_merge", f"WITH {_MERGED} SELECT * FROM merged")
def coverage_merge(spark, sf_dir):
    return _covered(spark, sf_dir)[0]


@query("coverage_gaps", f"""WITH {_MERGED}, after AS (SELECT source, hi + 1 AS lo, coalesce(lead(lo) OVER (PARTITION BY source ORDER BY lo), 1001) - 1 AS hi FROM merged),
first AS (SELECT source, 1 AS lo, min(lo) - 1 AS hi FROM merged GROUP BY source) SELECT * FROM (SELECT * FROM after UNION ALL SELECT * FROM first) WHERE lo <= hi""")
def coverage_gaps(spark, sf_dir):
    merged, totals = _covered(spark, sf_dir)
    return coverage.gaps(merged, totals, "source", "total")


@query("coverage_pct", f"WITH {_MERGED} SELECT source, 1000 AS total, CAST(sum(hi - lo + 1) AS BIGINT) AS pages, CAST(floor(sum(hi - lo + 1) * 100 / 1000) AS BIGINT) AS pct FROM merged GROUP BY source")
def coverage_pct(spark, sf_dir):
    merged, totals = _covered(spark, sf_dir)
    return coverage.share(merged, totals, "source", "total")


_ASCII = "[a-z]{3,}"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made from the documents: a function for every line of three plain words, in the language the id picks."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.transform(F.split("text", "\n"), lambda x: F.slice(F.regexp_extract_all(F.lower(x), F.lit(_ASCII), F.lit(0)), 1, 3)), lambda w: F.size(w) == 3)
    a, b, c = (lambda k: lambda w: F.concat(F.lit("f_"), F.get(w, k)))(0), (lambda k: lambda w: F.concat(F.lit("f_"), F.get(w, k)))(1), (lambda k: lambda w: F.get(w, k))(2)
    py = F.transform(words, lambda w: F.concat(F.lit("def "), a(w), F.lit("(x):\n    if x and x > 1:\n        "), b(w), F.lit("(x)\n    y = 1\n")))
    js = F.transform(words, lambda w: F.concat(F.lit("function "), a(w), F.lit("(x) {\n  if (x) { "), b(w), F.lit("(x); }\n}\nvar "), c(w), F.lit(" = 1;\n")))
    cc = F.transform(words, lambda w: F.concat(F.lit("static int "), a(w), F.lit("(int x) {\n  while (x) { "), b(w), F.lit("(x); strcpy(x, x); }\n}\nint "), c(w), F.lit(" = 1;\n")))
    heads = {"py": "import os\nfrom json import loads\n\n", "js": "import x from 'lib/tool.js'\n", "c": "#include <stdio.h>\n"}
    lang = F.element_at(F.array(*[F.lit(k) for k in heads]), (F.col("doc_id") % 3 + 1).cast("int"))
    source = F.when(lang == "py", F.concat(F.lit(heads["py"]), F.array_join(py, ""))).when(lang == "js", F.concat(F.lit(heads["js"]), F.array_join(js, ""))).otherwise(F.concat(F.lit(heads["c"]), F.array_join(cc, "")))
    return docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), lang).alias("path"), lang.alias("lang"), source.alias("source"))


#: The same files' functions in SQL: what each line defines and calls.
_SQL_CODE = rf"""WITH files AS (
  SELECT source || '/' || doc_id || '.' || ['py', 'js', 'c'][doc_id % 3 + 1] AS path, ['py', 'js', 'c'][doc_id % 3 + 1] AS lang,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(lower(x), '{_ASCII}')[1:3]), lambda w: len(w) = 3) AS rows_ FROM documents),
word AS (SELECT path, lang, unnest(rows_) AS w, generate_subscripts(rows_, 1) AS i FROM files),
defined AS (SELECT path, lang, 'f_' || w[1] AS name, 'f_' || w[2] AS callee, w[3] AS var, i FROM word),
calls AS (SELECT path, callee AS name FROM defined UNION ALL SELECT path, 'strcpy' FROM defined WHERE lang = 'c'),
once AS (SELECT * FROM defined WHERE lang = 'py' UNION ALL (SELECT DISTINCT ON (path, name) * FROM defined WHERE lang <> 'py' ORDER BY path, name, i)),
edges AS (SELECT path, name AS caller, callee, i, lang FROM once UNION SELECT path, name, 'strcpy', i, lang FROM once WHERE lang = 'c'),
imports(k, line, module, name, how, text) AS (VALUES (0, 1, 'os', 'os', 'import', 'import os'), (0, 2, 'json', 'loads', 'from_import', 'from json import loads'),
  (1, 1, 'lib/tool.js', 'tool', 'import', 'import x from ''lib/tool.js'''), (2, 1, 'stdio.h', 'stdio', 'include', '#include <stdio.h>')),
imported AS (SELECT source || '/' || doc_id || '.' || ['py', 'js', 'c'][doc_id % 3 + 1] AS path, imports.* FROM documents JOIN imports ON doc_id % 3 = k)"""


def _symbols(spark, sf_dir):
    from corpuslab.operators import code

    files = code_files(spark, sf_dir)
    return code, files, kept(code.symbols(files, ("py", "c", "js")), "symbols")  # read once, however many analyses use them


@query("code_unused_functions", _SQL_CODE + """
SELECT path, name FROM once WHERE name NOT IN (SELECT name FROM calls)""")
def code_unused_functions(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.unused_functions(found)


@query("code_unused_imports", _SQL_CODE + """
SELECT path, module, name FROM imported WHERE (path, name) NOT IN (SELECT (path, name) FROM calls)""")
def code_unused_imports(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.unused_imports(found)


@query("code_dependency_graph", _SQL_CODE + " SELECT path, module, how FROM imported")
def code_dependency_graph(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.dependencies(found)


@query("code_metrics", _SQL_CODE + """, counted AS (SELECT lang, count(*) AS functions FROM once GROUP BY lang),
lines AS (SELECT lang, count(*) AS files, CAST(sum(CASE lang WHEN 'py' THEN 2 + 4 * len(rows_) WHEN 'js' THEN 1 + 4 * len(rows_) ELSE 4 * len(rows_) END) AS BIGINT) AS code_lines FROM files GROUP BY lang)
SELECT lang, files, code_lines, coalesce(functions, 0) AS functions FROM lines LEFT JOIN counted USING (lang)""")
def code_metrics(spark, sf_dir):
    code, files, found = _symbols(spark, sf_dir)
    return code.metrics(files, found)


@query("code_data_flow", _SQL_CODE + """, set_ AS (SELECT path, var AS name, 4 * i + CASE lang WHEN 'js' THEN 1 ELSE 1 END AS line FROM defined WHERE lang <> 'py' UNION ALL SELECT path, 'y', 4 * i + 3 FROM defined WHERE lang = 'py')
SELECT path, name, min(line) AS defined, count(*) - 1 AS assigned FROM set_ GROUP BY path, name""")
def code_data_flow(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.data_flow(found)


@query("code_issues", _SQL_CODE + """SELECT path, 'high' AS severity, 'dangerous_function' AS type, 'strcpy' AS message, 4 * i - 1 AS line, 0 AS rank FROM defined WHERE lang = 'c'
UNION ALL SELECT path, 'medium', 'recursion', name || ' calls itself', 4 * i + CASE lang WHEN 'py' THEN 2 ELSE -1 END, 1 FROM defined WHERE name = callee
UNION ALL SELECT path, 'medium', 'missing_return', name || ' may end without a value', 4 * i, 1 FROM defined WHERE lang = 'c'""")
def code_issues(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.issues(found)


@query("code_control_flow", _SQL_CODE + """
SELECT path, name AS function, 4 * i + CASE lang WHEN 'py' THEN 1 ELSE -1 END AS line, CASE lang WHEN 'c' THEN 'loop' ELSE 'branch' END AS type, 1 AS depth FROM defined""")
def code_control_flow(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.control_flow(found)


@query("code_skeleton", _SQL_CODE + """ SELECT path, line, text AS signature FROM imported
UNION ALL SELECT path, 4 * i - CASE lang WHEN 'py' THEN 0 ELSE 2 END, CASE lang WHEN 'py' THEN 'def ' || name || '(x):' WHEN 'js' THEN 'function ' || name || '(x) {' ELSE 'static int ' || name || '(int x) {' END FROM once""")
def code_skeleton(spark, sf_dir):
    code, files, found = _symbols(spark, sf_dir)
    return code.skeleton(files, found)


@query("code_read_symbol", _SQL_CODE + """ SELECT path, 4 * i - CASE lang WHEN 'py' THEN 0 ELSE 2 END AS line, CASE lang
WHEN 'py' THEN 'def f_the(x):' || chr(10) || '    if x and x > 1:' || chr(10) || '        ' || callee || '(x)' || chr(10) || '    y = 1'
WHEN 'js' THEN 'function f_the(x) {' || chr(10) || '  if (x) { ' || callee || '(x); }' || chr(10) || '}'
ELSE 'static int f_the(int x) {' || chr(10) || '  while (x) { ' || callee || '(x); strcpy(x, x); }' || chr(10) || '}' END AS text FROM once WHERE name = 'f_the'""")
def code_read_symbol(spark, sf_dir):
    code, files, found = _symbols(spark, sf_dir)
    return code.read_symbol(files, found, "f_the")


@query("code_complexity", _SQL_CODE + """ SELECT name, path, 4 * i - CASE lang WHEN 'py' THEN 0 ELSE 2 END AS line, CASE lang WHEN 'py' THEN 3 ELSE 2 END AS cyclomatic,
CASE lang WHEN 'py' THEN 1 ELSE 2 END AS max_nesting, CASE lang WHEN 'py' THEN 4 ELSE 3 END AS lines FROM once""")
def code_complexity(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.complexity(found)


@query("code_most_complex", _SQL_CODE + """ SELECT name, path, 4 * i - CASE lang WHEN 'py' THEN 0 ELSE 2 END AS line, CASE lang WHEN 'py' THEN 3 ELSE 2 END AS cyclomatic,
CASE lang WHEN 'py' THEN 1 ELSE 2 END AS max_nesting, CASE lang WHEN 'py' THEN 4 ELSE 3 END AS lines FROM once ORDER BY 4 DESC, 2, 3 LIMIT 100""")
def code_most_complex(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.complexity(found, 100)


@query("code_called_by", _SQL_CODE + " SELECT callee, count(DISTINCT (path, caller)) AS callers, count(*) AS n_sites FROM edges GROUP BY callee")
def code_called_by(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.called_by(found)


@query("code_call_graph", _SQL_CODE + """, place AS (SELECT name, min(path) AS callee_path FROM once GROUP BY name)
SELECT path, caller, callee, 4 * i - CASE lang WHEN 'py' THEN 0 ELSE 2 END AS line, callee_path FROM edges LEFT JOIN place ON place.name = callee""")
def code_call_graph(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.call_graph(found)


@query("code_symbol_table", _SQL_CODE + """ SELECT name, 'function' AS kind, 'module' AS scope, path, 4 * i - CASE lang WHEN 'py' THEN 0 ELSE 2 END AS line FROM once
UNION ALL SELECT CASE lang WHEN 'py' THEN 'y' ELSE var END, 'variable', CASE lang WHEN 'py' THEN 'module' ELSE 'global' END, path, 4 * i + CASE lang WHEN 'py' THEN 3 ELSE 1 END FROM defined""")
def code_symbol_table(spark, sf_dir):
    code, _, found = _symbols(spark, sf_dir)
    return code.symbol_table(found)


@query("code_mermaid", _SQL_CODE + r""" SELECT path, regexp_replace(string_split(path, '/')[-1], '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || how || '| ' ||
regexp_replace(string_split(module, '/')[-1], '[^A-Za-z0-9_]', '_', 'g') AS line FROM imported""")
def code_mermaid(spark, sf_dir):
    code, files, found = _symbols(spark, sf_dir)
    return code.mermaid(found, files)


@query("code_dependency_json", _SQL_CODE + """ SELECT path, '[' || string_agg('{"module":"' || module || '","how":"' || how || '"}', ',' ORDER BY line) || ']' AS dependencies FROM imported GROUP BY path""")
def code_dependency_json(spark, sf_dir):
    code, files, found = _symbols(spark, sf_dir)
    return code.dependency_json(found, files)


@query("code_everything", _SQL_CODE + """, n AS (SELECT (SELECT count(*) FROM once) AS f, (SELECT count(*) FROM imported) AS m, (SELECT count(*) FROM defined) AS d)
SELECT 'metrics' AS analysis, count(*) AS n FROM (SELECT DISTINCT lang FROM files) UNION ALL SELECT 'call_graph', count(*) FROM edges UNION ALL SELECT 'dependency_graph', m FROM n
UNION ALL SELECT 'complexity', f FROM n UNION ALL SELECT 'dead_functions', count(*) FROM once WHERE name NOT IN (SELECT name FROM calls)
UNION ALL SELECT 'dead_imports', count(*) FROM imported WHERE (path, name) NOT IN (SELECT (path, name) FROM calls) UNION ALL SELECT 'symbol_table', f + d FROM n
UNION ALL SELECT 'issues', (SELECT 2 * count(*) FROM defined WHERE lang = 'c') + count(*) FROM defined WHERE name = callee
UNION ALL SELECT 'data_flow', count(DISTINCT (path, CASE lang WHEN 'py' THEN 'y' ELSE var END)) FROM defined UNION ALL SELECT 'control_flow', d FROM n UNION ALL SELECT 'skeleton', f + m FROM n""")
def code_everything(spark, sf_dir):
    code, files, found = _symbols(spark, sf_dir)
    return code.everything(files, found).groupBy("analysis").agg(F.count("*").alias("n"))


def typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made from the documents: a type with a base and a method for every line of three plain words."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.transform(F.split("text", "\n"), lambda x: F.slice(F.regexp_extract_all(F.lower(x), F.lit(_ASCII), F.lit(0)), 1, 3)), lambda w: F.size(w) == 3)
    shapes = {"py": "class T_%s(B_%s):\n    def m_%s(self):\n        pass\n\n", "js": "class T_%s extends B_%s {\n  m_%s(a) {\n    return a\n  }\n}\n", "c": "struct T_%s {\n  int n_%s;\n};\n/* TODO m_%s */\n"}
    lang = F.element_at(F.array(*[F.lit(k) for k in shapes]), (F.col("doc_id") % 3 + 1).cast("int"))
    made = lambda shape: F.array_join(F.transform(words, lambda w: F.format_string(shape, F.get(w, 0), F.get(w, 1), F.get(w, 2))), "")
    source = F.when(lang == "py", made(shapes["py"])).when(lang == "js", made(shapes["js"])).otherwise(made(shapes["c"]))
    return docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), lang).alias("path"), lang.alias("lang"), source.alias("source"))


_SQL_SIZE = "CASE lang WHEN 'py' THEN 4 WHEN 'js' THEN 5 ELSE 4 END"


@query("code_types", _SQL_CODE + f""" SELECT path, 'T_' || w[1] AS name, CASE lang WHEN 'c' THEN 'struct' ELSE 'class' END AS kind, {_SQL_SIZE} * (i - 1) + 1 AS line,
CASE lang WHEN 'c' THEN 'n_' || w[2] || ': int' ELSE 'm_' || w[3] END AS members, CASE lang WHEN 'c' THEN '' ELSE 'B_' || w[2] END AS bases FROM word""")
def code_types(spark, sf_dir):
    from corpuslab.operators import code

    found = code.types(code.symbols(typed_files(spark, sf_dir)))
    return found.select("path", "name", "kind", "line", F.array_join("members", ",").alias("members"), F.array_join("bases", ",").alias("bases"))


@query("code_todo_comments", _SQL_CODE + " SELECT path, 'low' AS severity, 'todo_comment' AS type, '/* TODO m_' || w[3] || ' */' AS message, 4 * i AS line, 2 AS rank FROM word WHERE lang = 'c'")
def code_todo_comments(spark, sf_dir):
    from corpuslab.operators import code

    return code.issues(code.symbols(typed_files(spark, sf_dir))).where("type = 'todo_comment'")


@query("call_graph_reach", """WITH RECURSIVE edge AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem),
walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hops UNION SELECT b, hops + 1 FROM walk JOIN edge ON a = node WHERE hops < 2)
SELECT node, min(hops) AS hops FROM walk GROUP BY node""")
def call_graph_reach(spark, sf_dir):
    from corpuslab.operators import code

    edges = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("to"))
    return code.reachable(edges, "l_suppkey", "to", table(spark, sf_dir, "supplier").where("s_suppkey = 1").select("s_suppkey"), 2)


@query("html_to_markdown")
def html_to_markdown(spark, sf_dir):
    from corpuslab.sources import markdown

    return table(spark, sf_dir, "pages").select("page_id", markdown.from_html(F.col("html")).alias("markdown"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies made from the messages: a thought, a tagged call and a JSON call around each text."""
    said = table(spark, sf_dir, "conversations")
    call = F.to_json(F.struct(F.lit("search").alias("name"), F.struct(F.col("turn").alias("turn")).alias("arguments")))
    tagged = F.concat(F.lit("<tool_call><name>read</name><args>{\"c\": "), F.col("conv_id").cast("string"), F.lit("}</args></tool_call>"))
    return said.select("conv_id", "turn", F.concat(F.lit("<think>so</think>"), F.col("text"), F.lit("\n"), tagged, F.lit("\n"), call).alias("text"))


@query("toolcall_extract", """SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS clean, 2 AS n_calls, 'read' AS first_call, 'search' AS last_call, '{"turn": ' || turn || '}' AS last_args FROM conversations""")
def toolcall_extract(spark, sf_dir):
    from corpuslab.operators import tool_calls

    found = tool_calls.extract(replies(spark, sf_dir), ["search", "read"])
    last = F.element_at("calls", -1)
    return found.select("conv_id", "turn", "clean", F.size("calls").cast("long").alias("n_calls"), F.get("calls", F.lit(0))["name"].alias("first_call"), last["name"].alias("last_call"), last["args"].alias("last_args"))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.streaming import progress

    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "signup", "init").when(F.col("event_type").isin("click", "view"), "chunk")
    return progress.events_of(
        table(spark, sf_dir, "events"), F.col("user_id"), kind, [F.col("ts"), F.col("event_id")], ch_i=k, ch_n=F.col("event_id") % 50 + 1, tk_n=F.col("event_id") % 900, tk_cum=k * 10, title=F.col("event_type")
    )


_SQL_PROGRESS = """WITH e AS (SELECT user_id AS job, CASE WHEN event_type = 'signup' THEN 'init' WHEN event_type IN ('click', 'view') THEN 'chunk' END AS kind, event_id,
CAST(json_extract(props, '$.k') AS BIGINT) AS ch_i, event_id % 50 + 1 AS ch_n, event_id % 900 AS tk_n, CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS tk_cum, event_type AS title, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events),
i AS (SELECT * FROM e WHERE kind = 'init' QUALIFY row_number() OVER (PARTITION BY job ORDER BY seq DESC) = 1),
f AS (SELECT * FROM e WHERE kind = 'chunk' QUALIFY row_number() OVER (PARTITION BY job ORDER BY seq) = 1),
c AS (SELECT * FROM e WHERE kind = 'chunk' QUALIFY row_number() OVER (PARTITION BY job ORDER BY seq DESC) = 1),
j AS (SELECT coalesce(i.job, c.job) AS job, i.seq AS iseq, i.ch_n AS ich, i.tk_n AS itk, f.ch_n AS fch, c.*, c.seq IS NOT NULL AND (i.seq IS NULL OR c.seq > i.seq) AS live
      FROM i FULL JOIN c ON i.job = c.job LEFT JOIN f ON f.job = c.job)
SELECT job, true AS started, CASE WHEN iseq IS NOT NULL THEN greatest(ich, 1) ELSE greatest(fch, 1) END AS ch_max, CASE WHEN live THEN ch_i ELSE 0 END AS ch_val,
CASE WHEN live THEN ch_i * 100 // greatest(ch_n, 1) ELSE 0 END AS pct, CASE WHEN iseq IS NOT NULL THEN greatest(itk, 1) END AS tk_max,
CASE WHEN iseq IS NULL THEN 0 WHEN live THEN least(tk_cum, greatest(itk, 1)) ELSE 0 END AS tk_val, CASE WHEN live THEN title ELSE 'starting' END AS label FROM j"""


@query("progress_fold", _SQL_PROGRESS.replace("SELECT coalesce(i.job, c.job) AS job, i.seq", "SELECT coalesce(i.job, c.job) AS job, i.seq").replace("c.*,", "c.seq AS cseq, c.ch_i, c.ch_n, c.tk_cum, c.title,"))
def progress_fold(spark, sf_dir):
    from corpuslab.streaming import progress

    return progress.fold(progress_events(spark, sf_dir))


@query("sse_fold", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type, CAST(json_extract(props, '$.k') AS VARCHAR) AS piece FROM events),
s AS (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS dead FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, day, coalesce(string_agg(piece, '' ORDER BY ts, event_id) FILTER (dead IS NULL AND event_type = 'click'), '') AS answer,
count(*) FILTER (dead IS NULL AND event_type = 'click') AS pieces, bool_or(dead IS NOT NULL) AS failed FROM s GROUP BY user_id, day""")
def sse_fold(spark, sf_dir):
    from corpuslab.streaming import progress

    kind = F.when(F.col("event_type") == "click", "message").when(F.col("event_type") == "error", "error")
    chunks = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", kind.alias("kind"), F.get_json_object("props", "$.k").alias("piece_"))
    return progress.answers(chunks, ["user_id", "day"], ["ts", "event_id"], "piece_", "kind")


@query("heading_carry_forward", f"""WITH {_SQL_LINES}, line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split)
SELECT doc_id, i, last_value(CASE WHEN length(line) < 60 THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS head,
CAST(sum(CASE WHEN contains(line, ' | ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) % 2 AS BIGINT) AS inside FROM line""")
def heading_carry_forward(spark, sf_dir):
    from pyspark.sql import Window

    line = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("long").alias("i"), "line")
    upto = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.length("line") < 60, F.col("i")), ignorenulls=True).over(upto)
    return line.select("doc_id", "i", head.alias("head"), (F.sum(F.contains("line", F.lit(" | ")).cast("long")).over(upto) % 2).alias("inside"))


_NAMES = r"""SELECT page_id, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS ext, left(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS title FROM pages"""


@query("file_names", _NAMES)
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extension(F.col("url")).alias("ext"), T.safe_title(F.col("url")).alias("title"))


@query("edit_once", """SELECT doc_id, CASE WHEN n = 1 THEN replace(text, ' the ', ' THE ') ELSE text END AS text, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'several' END AS error
FROM (SELECT doc_id, text, (length(text) - length(replace(text, ' the ', ''))) // 5 AS n FROM documents)""")
def edit_once(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(T.edit(F.col("text"), " the ", " THE "))))


_SQL_LOG = """SELECT event_id, CASE event_type WHEN 'signup' THEN 'セクション処理: ' || event_id % 50 || '章 予算1,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || 'トークン'
WHEN 'click' THEN '[' || event_id % 7 || '/9] 累計' || event_id % 900 WHEN 'view' THEN '[' || (event_id % 4 + 1) || '/4] x' ELSE 'other' END AS line, event_type AS t FROM events"""


@query("log_line_events", f"""SELECT event_id, line, CASE t WHEN 'signup' THEN 'init' WHEN 'click' THEN 'chunk' WHEN 'view' THEN 'step' END AS kind,
CASE t WHEN 'click' THEN event_id % 7 WHEN 'view' THEN event_id % 4 + 1 END AS ch_i, CASE t WHEN 'signup' THEN event_id % 50 WHEN 'click' THEN 9 WHEN 'view' THEN 4 END AS ch_n,
CASE t WHEN 'signup' THEN 1000 + event_id % 1000 END AS tk_n, CASE t WHEN 'click' THEN event_id % 900 END AS tk_cum,
CASE WHEN t = 'view' THEN ['読み込み中...', '分割中...', '構造化中...', '書き出し中...'][event_id % 4 + 1] END AS title FROM ({_SQL_LOG})""")
def log_line_events(spark, sf_dir):
    from corpuslab.streaming import progress

    n = F.col("event_id")
    line = (
        F.when(F.col("event_type") == "signup", F.format_string("セクション処理: %d章 予算1,%03dトークン", n % 50, n % 1000))
        .when(F.col("event_type") == "click", F.format_string("[%d/9] 累計%d", n % 7, n % 900))
        .when(F.col("event_type") == "view", F.format_string("[%d/4] x", n % 4 + 1))
        .otherwise("other")
    )
    return progress.line_events(table(spark, sf_dir, "events").select("event_id", line.alias("line")))


@query("sse_lines", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'message' WHEN event_type = 'error' THEN 'error' END AS kind,
CASE WHEN event_type = 'click' THEN 'é ' || event_id END AS piece, CASE WHEN event_type = 'click' THEN 'c' || user_id END AS conversation FROM events""")
def sse_lines(spark, sf_dir):
    from corpuslab.streaming import progress

    message = F.to_json(F.struct(F.lit("message").alias("event"), F.concat(F.lit("é "), "event_id").alias("answer"), F.concat(F.lit("c"), "user_id").alias("conversation_id")))
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("data: "), message)).when(F.col("event_type") == "error", F.lit('data: {"event": "error"}')).otherwise("data: {bad")
    return progress.sse_events(table(spark, sf_dir, "events").select("event_id", line.alias("line"), "user_id")).drop("line", "user_id")


@query("index_append", """SELECT source AS section, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS at, lang AS line FROM documents
UNION ALL SELECT d.source, n + 1 + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id), 'more' FROM documents d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source) JOIN labels USING (doc_id)""")
def index_append(spark, sf_dir):
    from pyspark.sql import Window

    from corpuslab.sources import readers

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    index = docs.select(F.col("source").alias("section"), place.alias("at"), F.col("lang").alias("line"))
    more = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("source").alias("section"), place.alias("at"), F.lit("more").alias("line"))
    return readers.append_entries(index, more)


def lin_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A LIN description for every order: its lines are signals in one frame, their suppliers nodes, and the order's priority a schedule."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER).repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER))).alias("lines"))
    bits = lambda x: x["l_quantity"].cast("long")
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<long>").alias("at"))
    lines = lines.withColumn("at", F.aggregate("lines", begin, lambda acc, x: F.struct((acc["end"] + F.coalesce(bits(x), F.lit(0))).alias("end"), F.concat(acc["at"], F.array(acc["end"])).alias("at")))["at"])
    signal = lambda x, k: F.format_string("  S%d: %d, %d, N%d, ECU, P%d;\n", k + 1, bits(x), x["l_partkey"] % 9, x["l_suppkey"], x["l_partkey"] % 7)
    placed = lambda at, k: F.format_string("    S%d, %d;\n", k + 1, at)
    nodes = F.sort_array(F.array_distinct(F.transform("lines", lambda x: F.format_string("N%d", x["l_suppkey"]))))
    parts = lines.select("l_orderkey", F.array_join(F.transform("lines", signal), "").alias("signals"), F.array_join(F.transform("at", placed), "").alias("placed"), F.array_join(nodes, ", ").alias("nodes"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_replace("o_orderpriority", r"\W", "_").alias("table"))
    joined = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.col("o_orderkey").cast("string").alias("path"),
        F.format_string(
            "LIN_description_file; // order\nNodes {\n  Master: ECU, 5 ms, 0.1 ms;\n  Slaves: %s;\n}\nSignals {\n%s}\nFrames {\n  F1: 0x%02X, ECU, 8 {\n%s  }\n}\nSchedule_tables {\n  T%s {\n    F1 delay 10 ms;\n  }\n}\n",
            "nodes", "signals", F.col("o_orderkey") % 60, "placed", "table",
        ).alias("text"),
    )


_SQL_LIN = """WITH line AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, row_number() OVER o AS k, CAST(l_quantity AS BIGINT) AS bits, l_suppkey, l_partkey,
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))"""


@query("lin_signals", _SQL_LIN + """ SELECT path, k - 1 AS seq, 'S' || k AS name, bits AS size, CAST(l_partkey % 9 AS VARCHAR) AS init_value, 'N' || l_suppkey AS publisher,
'ECU,P' || l_partkey % 7 AS subscribers, 'F1' AS frame, place AS "offset" FROM line""")
def lin_signals(spark, sf_dir):
    from corpuslab.sources import lin

    return lin.signals(lin_files(spark, sf_dir)).withColumn("subscribers", F.array_join("subscribers", ","))


@query("lin_nodes", _SQL_LIN + """, slaves AS (SELECT path, 'N' || l_suppkey AS name, row_number() OVER (PARTITION BY path ORDER BY 'N' || l_suppkey) AS seq FROM (SELECT DISTINCT path, l_suppkey FROM line))
SELECT path, seq, name, 'Slave' AS role, 0.0::DOUBLE AS time_base, 0.0::DOUBLE AS jitter FROM slaves UNION ALL SELECT DISTINCT path, 0, 'ECU', 'Master', 5.0::DOUBLE, 0.1::DOUBLE FROM line""")
def lin_nodes(spark, sf_dir):
    from corpuslab.sources import lin

    return lin.nodes(lin_files(spark, sf_dir))


@query("lin_schedules", _SQL_LIN + """ SELECT DISTINCT path, 'T' || regexp_replace(o_orderpriority, '\\W', '_', 'g') AS "table", 0 AS seq, 'F1' AS frame, 10.0::DOUBLE AS delay_ms FROM line JOIN orders ON path = CAST(o_orderkey AS VARCHAR)
UNION ALL SELECT DISTINCT path, 'T2', 0, 'F1', 20.0::DOUBLE FROM line""")
def lin_schedules(spark, sf_dir):
    from corpuslab.sources import lin

    files = lin_files(spark, sf_dir)
    new = files.select("path", F.lit("T2").alias("table"), F.lit("F1").alias("frame"), F.lit(20.0).alias("delay_ms"), F.lit(0).alias("k"))
    return lin.append_schedule(lin.schedules(files), new)


@query("lin_save", _SQL_LIN + """, wide AS (SELECT path, count(*) AS n_signals, CAST(sum(bits) AS BIGINT) AS bits FROM line GROUP BY path)
SELECT path, n_signals, bits * 2 AS bits, true AS comment_stays, 1 AS n_frames FROM wide""")
def lin_save(spark, sf_dir):
    """Doubles all signals, packs them anew, writes the four sections back and reads the files again."""
    from corpuslab.sources import lin

    files = lin.read(lin_files(spark, sf_dir)).withColumn("size", F.transform("size", lambda x: x * 2))
    saved = lin.write(files.withColumn("offset", lin.packed(F.col("size"))))
    bits = F.aggregate("size", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return lin.read(saved).select("path", F.contains("text", F.lit("; // order")).alias("comment_stays"), F.size("signal").cast("long").alias("n_signals"), bits.alias("bits"), F.size("frame").cast("long").alias("n_frames"))


def _tasks(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("held")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lower(F.substring_index("o_orderpriority", "-", -1)).alias("priority"), status.alias("status"), F.col("o_orderpriority").alias("content"))


@query("todo_progress", "SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total FROM orders")
def todo_progress(spark, sf_dir):
    from corpuslab.operators import notes

    return notes.progress(_tasks(spark, sf_dir))


@query("todo_invalid", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR lower(string_split(o_orderpriority, '-')[-1]) NOT IN ('high', 'medium', 'low')")
def todo_invalid(spark, sf_dir):
    from corpuslab.operators import notes

    return notes.invalid(_tasks(spark, sf_dir)).select("id")


@query("memory_upsert", "SELECT c_name AS key, CASE WHEN c_custkey = 7 THEN 'seen' ELSE c_mktsegment END AS content FROM customer")
def memory_upsert(spark, sf_dir):
    from corpuslab.operators import notes

    memory = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("content"))
    name = table(spark, sf_dir, "customer").where("c_custkey = 7").head()["c_name"]
    return notes.remember(memory, name, "seen")


@query("blocked_calls", "SELECT conv_id, turn, 'read' AS name FROM conversations UNION ALL SELECT conv_id, turn, 'search' FROM conversations WHERE role = 'user'")
def blocked_calls(spark, sf_dir):
    """Calls of replies that the rules of their roles do not allow: users may not search, and nobody may read."""
    from corpuslab.operators import tool_calls

    roles = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    calls = tool_calls.extract(replies(spark, sf_dir), ["search", "read"]).select("conv_id", "turn", F.explode("calls.name").alias("name"))
    asked = calls.join(roles, ["conv_id", "turn"]).withColumn("rule", F.concat_ws(":", "role", "name"))
    allowed = roles.where("role <> 'user'").select(F.concat_ws(":", "role", F.lit("search")).alias("rule")).distinct()
    return tool_calls.blocked(asked, allowed, "rule").select("conv_id", "turn", "name")


from corpuslab.plans import workflows  # noqa: E402, F401  registers its queries
