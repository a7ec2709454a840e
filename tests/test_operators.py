import ast
import re
import time
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import batching, braces, code, conversation, corpus, coverage, relations, tool_calls
from corpuslab.sources import markdown


def plain_grep(text, pattern, context):
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    if lines[-1] == "":
        lines.pop()
    hit = [bool(re.search(pattern, x + "\n", re.IGNORECASE)) for x in lines]
    near = sorted({j for i, h in enumerate(hit) if h for j in range(max(0, i - context), min(len(lines), i + context + 1))})
    out = []
    for j in near:
        if out and j == out[-1][1] + 1:
            out[-1][1] = j
        else:
            out.append([j, j])
    return [(a + 1, b + 1, sum(hit[a : b + 1])) for a, b in out]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_grep_edges(spark, context):
    texts = ["", "x", "hit", "a\r\nHIT\r\nb\n", "hit\n" * 3, "\n".join("hit" if k % 5 == 0 else "no" for k in range(40)), "ÜBER x\nz", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern in ("hit", r"^\w+$", r"über|t\s"):
        got = defaultdict(list)
        for r in corpus.grep(df, pattern, context).orderBy("doc_id", "island").collect():
            got[r.doc_id].append((r.first_line, r.last_line, r.n_hits))
        want = {k: w for k, t in enumerate(texts) if (w := plain_grep(t or "", pattern, context))}
        assert dict(got) == want


def test_pages_of_results(spark):
    df = spark.createDataFrame([(k, j) for k in range(45) for j in range(2)], "doc_id long, island long")
    assert [sorted({r.doc_id for r in corpus.page_of(df, p).collect()}) for p in (1, 2, 3, 4)] == [list(range(20)), list(range(20, 40)), list(range(40, 45)), []]
    with pytest.raises(ValueError):
        corpus.page_of(df, 0)


def test_text_functions(spark):
    rows = [("\n ## Title here \nbody",), ("```\n| t |\nReal",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(T.first_line(F.col("t")).alias("a"), T.summary(F.col("t")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("Title here", "Title here"), ("```", "Real"), ("(no summary)", "(no summary)"), ("(no summary)", "(no summary)")]
    one = spark.createDataFrame([("a/b/My file (1).tar.md", "日本語é", 2048)], "p string, u string, n long")
    r = one.select(T.slug(F.col("p")), T.utf8_prefix(F.col("u"), 4), T.size_label(F.col("n")), T.replace_unique(F.col("u"), "本", "x"), T.replace_unique(F.col("u"), "z", "x"), T.markdown_cell(F.lit("a|b"))).first()
    assert tuple(r) == ("My_file__1__tar", "日", "2.0 KB", "日x語é", None, "a\\|b")


def test_patterns_carry_over():
    assert T.java_pattern(r"(?P<n>\w+)\Z") == r"(?d)(?U)(?<n>\w+)\z"
    with pytest.raises(ValueError):
        T.java_pattern(r"(?P<n>a)(?P=n)")
    with pytest.raises(re.error):
        T.java_pattern("(")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 6)), min_size=1, max_size=12))
def test_coverage(spark, ranges):
    df = spark.createDataFrame([("d", 30, a, a + n) for a, n in ranges], "d string, total long, lo long, hi long")
    merged = coverage.merge(coverage.clamp(df, "d", "total"), "d")
    pages = {p for a, n in ranges for p in range(a, min(a + n, 30) + 1)}
    assert {p for r in merged.collect() for p in range(r.lo, r.hi + 1)} == pages
    found = sorted((r.lo, r.hi) for r in merged.collect())
    assert all(b + 1 < c for (_, b), (c, _) in zip(found, found[1:]))
    totals = df.select("d", "total").distinct()
    open_ = [p for r in coverage.gaps(merged, totals, "d", "total").collect() for p in range(r.lo, r.hi + 1)]
    assert sorted(open_) == sorted(set(range(1, 31)) - pages)
    assert coverage.share(merged, totals, "d", "total").first().pct == len(pages) * 100 // 30


def test_batches_and_frames(spark):
    df = spark.createDataFrame([("k", i, c, b) for i, (c, b) in enumerate([(30, False), (15, False), (20, True), (5, False), (41, False), (1, False)])], "k string, i long, c long, b boolean")
    got = lambda barrier: [r.batch for r in batching.greedy_batches(df, ["k"], "i", "c", 40, barrier).orderBy("i").collect()]
    assert got(None) == [0, 1, 1, 1, 2, 3]
    assert got("b") == [0, 1, 2, 3, 4, 5]
    many = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.lit(1).cast("long").alias("c"))
    assert {(r.i // 40, r.batch) for r in batching.greedy_batches(many, ["k"], "i", "c", 40).collect()} == {(n, n) for n in range(75)}
    assert [batching.page_range(x, 9) for x in (None, "", "3-5", "3-", "-4", "7", "5-99")] == [(1, 9), (1, 9), (3, 5), (3, 9), (1, 4), (7, 7), (5, 9)]
    wanted = spark.createDataFrame([("b", 1, "a"), ("b", 2, "b"), ("c", 3, "c")], "b string, page long, text string")
    answers = spark.createDataFrame([("b", 1, "new")], "b string, page long, text string")
    assert sorted((r.page, r.text, r.failed) for r in batching.outcome(answers, ["b"], wanted).collect()) == [(1, "new", False), (2, "b", False), (3, "c", True)]
    pages = spark.createDataFrame([("b", 1, "one\ntwo"), ("b", 2, ""), ("b", 10, "ten")], "b string, page long, text string")
    back = batching.unframe(batching.frame(pages, ["b"], "page", "text", "page"), ["b"])
    assert sorted((r.page, r.text) for r in back.collect()) == [(1, "one\ntwo"), (2, ""), (10, "ten")]


def test_relations(spark):
    nodes = spark.createDataFrame([("m",), ("s",)], "name string")
    frames = spark.createDataFrame([("f", "m", 1), ("g", "gone", 2)], "name string, publisher string, size long")
    signals = spark.createDataFrame([("a", "f", 6, 0), ("b", "f", 4, 1), ("c", "", 1, 2), ("d", "h", 1, 3)], "name string, frame string, bits long, seq long")
    bad = relations.violations(relations.dangling(frames, "publisher", nodes, "name", "frame publisher", "name"), relations.dangling(signals, "frame", frames, "name", "signal frame", "name"))
    assert sorted((r.rule, r.row) for r in bad.collect()) == [("frame publisher", "g"), ("signal frame", "d")]
    packed = relations.running_offset(signals, "frame", ["seq"], "bits")
    assert [r.name for r in relations.overflows(frames, "name", "size", packed.withColumnRenamed("name", "signal"), "frame", "offset", "bits").select(F.col("signal").alias("name")).collect()] == ["b"]
    edited = relations.edit_first(signals, "frame", "f", "seq", {"bits": F.lit(9)})
    assert sorted((r.name, r.bits) for r in edited.collect())[:2] == [("a", 9), ("b", 4)]
    with pytest.raises(KeyError):
        relations.edit_first(signals, "frame", "none", "seq", {})


def test_tool_calls(spark):
    texts = [
        '<think>x</think>hi <tool_call><name> read </name><args>{"p": 1}</args></tool_call>',
        '<tool_call><name>read</name><args>not json</args></tool_call>',
        'a {"name": "read", "arguments": {"q": "é"}} b {"other": 1} {broken',
        '{"function": {"name": "read", "arguments": "{\\"x\\": 2}"}}',
        '[{"name": "read", "args": {}}, {"function": "read", "parameters": {"y": 3}}]',
        '{"tool_calls": [{"function": {"name": "nope"}}]} tail',
        None,
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    got = [(r.clean, [(c.name, c.args) for c in r.calls]) for r in tool_calls.extract(df, ["read"]).orderBy("k").collect()]
    assert got == [
        ("hi", [("read", '{"p": 1}')]),
        ("", [("read", '{"raw":"not json"}')]),
        ('a  b {"other": 1} {broken', [("read", '{"q": "é"}')]),
        ("", [("read", '{"x": 2}')]),
        ("", [("read", "{}"), ("read", '{"y": 3}')]),
        ("tail", []),
        ("", []),
    ]


def test_compaction(spark):
    log = spark.createDataFrame([("a", t, "tool" if t % 2 else "user", "word " * 50) for t in range(20)] + [("b", 0, "tool", "short")], "conv_id string, turn long, role string, text string")
    cleared = conversation.clear_old(log, "tool").where("text = '[cleared]'")
    assert sorted(r.turn for r in cleared.collect()) == [1, 3, 5, 7, 9]
    out = conversation.compact(log, "tool", limit=700, most=10)
    assert {r.conv_id: r.tier for r in out.select("conv_id", "tier").distinct().collect()} == {"a": 2, "b": 0}
    ratio = conversation.usage(log, limit=700).select("conv_id", "ratio")
    assert {r.tier for r in conversation.compact(log, "tool", limit=700, most=10, last_ratio=ratio).collect()} == {0}
    third = conversation.compact(log, "tool", limit=200, most=10, prompt="P\n## Index\nlong\n## End", drop_sections=["Index"]).where("conv_id = 'a'")
    assert [(r.turn, r.role) for r in third.orderBy("turn").collect()][:2] == [(0, "system"), (1, "assistant")] and {r.tier for r in third.collect()} == {3}
    assert out.count() == log.count()
    text = spark.createDataFrame([("a\n| x | y |\nb\n----\n\n\n\nc ",)], "t string").select(conversation.compress(F.col("t"))).first()[0]
    assert text == "a\nb\n\nc"


PYTHON = '''import os
from json import loads as read

class Box(Base):
    def put(self, x):
        for i in x:
            if i and x or i:
                self.put(i)
        return helper(x)

def helper(x):
    try:
        return helper(x)
    except:
        pass

limit = 3
'''


C = """#include <stdio.h>
#define MAX(a) ((a) > limit(a))
/* gone(x)
   TODO in a comment */
static int add(int a, int b)
{
  if (a && b) { return sub(a); }
  strcpy(a, b); // not(this)
  printf(a);
  printf("call(%d) {", a);
}
int total = 0;
int declared(int a);
struct point { int x; };
void *walk(struct point *p) {
  for (int i = 0; i < 3; i++) {
    switch (p->x) {
      case 1: add(1, 2); break;
      case 2: add(2, 3);
      default: walk(p); return p;
    }
  }
  return p;
}
int tiny(void) { return 1; }
""" + "int big(void) {\n" + "  total = total + 1;\n" * 60 + "  last(total);\n  return 0;\n}\n"
JS = """import x from './lib/tool.js'
const fs = require("fs");
export const go = (a) => { run(a) }
const one = a => two(a);
function main() { return go(1) }
class A extends B {
  async step(a) { eval(a) }
}
let n = 1;
items.map(function (q) { return main(q) })
"""
GO = 'import "fmt"\nfunc (s *Server) Main(a int) {\n  // TODO later\n  for a > 0 { fmt.Println(a) }\n  total := 1\n}\n'


def test_code_analysis(spark):
    files = spark.createDataFrame([("a.py", "py", PYTHON), ("b.c", "c", C), ("c.js", "js", JS), ("d.go", "other", GO), ("bad.py", "py", "def ("), ("e.py", "py", None), ("f.c", "c", "}} {{ ((( \" ' /* "), ("g.rs", "rust", "")], "path string, lang string, source string")
    found = code.symbols(files)
    by = lambda df, *cols: sorted(tuple(r[k] for k in cols) for r in df.collect())
    assert by(code.complexity(found).where("path = 'a.py'"), "name", "cyclomatic", "max_nesting", "line") == [("helper", 2, 1, 11), ("put", 5, 2, 5)]
    assert by(code.complexity(found).where("path = 'b.c'"), "name", "cyclomatic", "max_nesting", "line", "lines") == [("add", 3, 2, 5, 7), ("big", 1, 1, 26, 64), ("tiny", 1, 1, 25, 1), ("walk", 5, 3, 15, 10)]
    assert by(code.complexity(found).where("path in ('c.js', 'd.go')"), "name", "line", "lines") == [("Main", 2, 5), ("go", 3, 1), ("main", 5, 1), ("one", 4, 1), ("step", 7, 1)]
    assert by(code.call_edges(found).where("path <> 'a.py'"), "caller", "callee") == [
        ("Main", "Println"), ("add", "printf"), ("add", "strcpy"), ("add", "sub"), ("big", "last"), ("go", "run"), ("main", "go"), ("one", "two"), ("step", "eval"), ("walk", "add"), ("walk", "walk")
    ]
    assert by(code.unused_functions(found), "path", "name") == [("b.c", "big"), ("b.c", "tiny"), ("c.js", "one"), ("c.js", "step"), ("d.go", "Main")]
    assert by(code.unused_imports(found).where("path = 'a.py'"), "name") == [("os",), ("read",)]
    assert by(code.issues(found).where("path = 'b.c'"), "type", "line") == [
        ("dangerous_function", 8), ("format_string", 9), ("missing_return", 11), ("recursion", 20), ("switch_fallthrough", 19), ("todo_comment", 4)
    ]
    assert {("a.py", "recursion"), ("a.py", "bare_except"), ("c.js", "eval_usage"), ("d.go", "todo_comment")} <= set(by(code.issues(found), "path", "type"))
    assert by(code.types(found), "path", "name", "bases", "members") == [("a.py", "Box", ["Base"], ["put"]), ("b.c", "point", [], ["x: int"]), ("c.js", "A", ["B"], ["step"])]
    assert by(code.dependencies(found), "path", "module", "how") == [
        ("a.py", "json", "from_import"), ("a.py", "os", "import"), ("b.c", "stdio.h", "include"), ("c.js", "./lib/tool.js", "import"), ("c.js", "fs", "require"), ("d.go", "fmt", "import")
    ]
    assert by(found.where("kind = 'variable' and path <> 'a.py'"), "path", "name") == [("b.c", "total"), ("c.js", "fs"), ("c.js", "n"), ("d.go", "total")]
    assert by(code.control_flow(found).where("function = 'walk'"), "type", "depth") == [("exit", 1), ("exit", 3), ("loop", 1), ("switch", 2)]
    assert ("helper", 2) in by(code.called_by(found), "callee", "callers")
    assert ("walk", "add", "b.c") in by(code.call_graph(found).where("callee_path is not null"), "caller", "callee", "callee_path")
    assert 'a_py -->|import| os' in [r.line for r in code.mermaid(found).collect()]
    assert ("e.py", "e_py") in by(code.mermaid(found, files), "path", "line")
    assert ("e.py", "[]") in by(code.dependency_json(found, files), "path", "dependencies")
    assert ("b.c", 2, "#define MAX(a) ((a) > limit(a))") in by(code.skeleton(files, found), "path", "line", "signature")
    assert code.read_symbol(files, found, "tiny").first().text == "int tiny(void) { return 1; }"
    assert [r.name for r in code.complexity(found, 2).collect()] == ["put", "walk"]
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(2, 0)], "a long, b long")
    assert by(code.reachable(edges, "a", "b", spark.createDataFrame([(0,)], "x long"), 10), "node", "hops") == [(k, k) for k in range(6)]
    assert code.symbols(files.where("false")).count() == 0


def test_braces_are_read_in_linear_time():
    began = time.process_time()
    for source in ("{" * 100_000, "f(" * 100_000, "int f() {" * 3_000, "switch (x) { case 1: " * 3_000, '"' * 100_000, "/*" * 100_000, "require('x')\n" * 50_000):
        for lang in ("c", "js", "other"):
            list(braces.symbols(source, lang))
    assert time.process_time() - began < 60


def test_markdown_of_pages_and_tables(spark, tmp_path):
    html = "<head><title>t</title></head><body><nav>n</nav><h2>Head</h2><p>a <b>bold</b> <a href='u'>l</a></p><ul><li>x<li>y</ul><pre>  c\n d</pre><table><tr><th>p</th><th>q</th></tr><tr><td>1</td><td>2</td></tr></table></body>"
    assert markdown.markdown(html) == "## Head\n\na **bold** [l](u)\n\n- x\n- y\n\n```\n  c\n d\n```\n\n| p | q |\n|---|---|\n| 1 | 2 |"
    assert markdown.markdown(None) == ""
    (tmp_path / "t.csv").write_bytes("﻿a,b\n1,x|y\n2,\n".encode())
    df = markdown.read_table(spark, str(tmp_path / "t.csv"))
    assert [r.line for r in markdown.table_lines(df, ["a"], most=1).orderBy("at").collect()] == ["| a | b |", "|---|---|", "| 1 | x\\|y |", "(1 of 2 rows)"]
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("no")
    (tmp_path / "x.PY").write_text("yes")
    assert [r.text for r in markdown.read_files(spark, str(tmp_path), [".py"]).collect()] == ["yes"]
