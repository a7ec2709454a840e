"""Delimited files with quotes, comments that leave something to do, skeletons, open contents and the tokens of calls."""

from corpuslab.operators import code, conversation, coverage
from corpuslab.sources import readers

PYTHON = '''import os  # TODO none
def f(
    a,
):
    """What f does."""
    return a  # fixme later
class A(B):
    "Doc."
    def g(self): return "# TODO no comment"
    def h(self):
        x = 1
'''


def test_delimited_files(spark):
    text = '﻿a,"b ""x""",c\r\n1,"two\nlines",x|y\r\n\r\n"q,r",,\r\n5\n'
    assert readers.table_text(text, ",", None) == '| a | b "x" | c |\n|---|---|---|\n| 1 | two lines | x\\|y |\n| q,r |  |  |\n| 5 |  |  |'
    assert readers.table_text(text, ",", 1).endswith("x\\|y |\n(1 of 3 rows)") and readers.table_text(None, ",", 1) == "" == readers.table_text("\n\n", ",", 3)
    files = spark.createDataFrame([("a.csv", ".csv", text), ("b.tsv", ".tsv", 'x\ty\n"1\t2"\t3\n' + "4\t5\n" * 100), ("c.csv", ".csv", "w" * 200_000 + ",2\n")], "path string, ext string, text string")
    got = {r.path: r.text for r in readers.as_markdown(files).collect()}
    assert got["a.csv"].count("\n") == 4 and got["b.tsv"].endswith("(100 of 101 rows)") and "| 1\t2 | 3 |" in got["b.tsv"] and len(got["c.csv"]) > 200_000
    assert {r.path: r.text for r in readers.as_markdown(files, None).collect()}["b.tsv"].count("\n") == 102


def test_python_comments_errors_and_skeletons(spark):
    files = spark.createDataFrame([("a.py", "py", PYTHON), ("bad.py", "py", "x = 1  # XXX\ndef ("), ("c.c", "c", "#define M 1\nint f(int a) { return a; }\nstruct s {\n  int x;\n};\n")], "path string, lang string, source string")
    found = code.symbols(files)
    issues = sorted((r.path, r.type, r.line, r.severity, r.message) for r in code.issues(found).where("path <> 'c.c'").collect())
    assert [i[:4] for i in issues] == [("a.py", "todo_comment", 1, "low"), ("a.py", "todo_comment", 6, "low"), ("bad.py", "syntax_error", 2, "high"), ("bad.py", "todo_comment", 1, "low")]
    assert issues[1][4] == "return a  # fixme later"
    text = {(r.path, r.line): r.text for r in code.skeleton_text(files, found).collect()}
    assert text == {
        ("a.py", 1): "import os  # TODO none", ("a.py", 2): 'def f(\n    a,\n):\n    """What f does."""\n    ...', ("a.py", 7): 'class A(B):\n    """Doc."""\n    ...',
        ("a.py", 9): "    def g(self):\n        ...", ("a.py", 10): "    def h(self):\n        ...", ("c.c", 1): "#define M 1", ("c.c", 2): "int f(int a) { ... }", ("c.c", 3): "struct s { ... }",
    }


def test_open_contents(spark):
    contents = spark.createDataFrame([("a", lvl, f"t{p}", p) for p in range(1, 200) for lvl in (p % 3 + 1,)] + [("b", 1, "x", 1)], "doc string, level int, title string, page long")
    gaps = spark.createDataFrame([("a", 40, 50), ("a", 90, 99)], "doc string, lo long, hi long")
    got = coverage.open_contents(contents, gaps, "doc").collect()
    assert len(got) == 50 and min(r.page for r in got) == 40 and all(r.level <= 2 for r in got)
    assert coverage.open_contents(contents, gaps, "doc", most=None).count() == sum(p % 3 + 1 <= 2 for p in range(40, 200))


def test_tokens_of_calls(spark):
    log = spark.createDataFrame([("a", "one two", '[{"name": "f"}]'), ("a", None, None), ("b", "x", "")], "conv_id string, text string, calls string")
    plain, both = ({r.conv_id: r.tokens for r in conversation.usage(log, calls=c).collect()} for c in (None, "calls"))
    assert plain["b"] == both["b"] and both["a"] > plain["a"]
