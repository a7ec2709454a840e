"""Kinds of lines against a reading from the first line to the last."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import markdown_blocks as M


def plain(text, automaton):
    """One line after the other."""
    state, out = 0, []
    for line in (text or "").splitlines():
        mark = next((k for k, p in enumerate(automaton.marks) if re.search(p, line)), -1)
        before, state = state, automaton.moves[state][mark] if mark >= 0 else state
        if before != state:
            out.append(("fence", None, ""))
        elif state:
            out.append(("code", None, line))
        elif re.fullmatch(r"[-*_]{3,}", line.strip()):
            out.append(("rule", None, ""))
        elif m := re.match(r"(#{1,4})\s+(.*)", line):
            out.append(("heading", len(m[1]), m[2]))
        elif line.startswith("> "):
            out.append(("quote", None, line[2:]))
        elif m := re.match(r"(\s*)[-*+]\s+(.*)", line):
            out.append(("bullet", len(m[1]) // 2, m[2]))
        elif re.match(r"(\s*)\d+\.\s+(.*)", line):
            out.append(("number", None, line))
        else:
            out.append(("text", None, line))
    return out


TEXT = """# Title
text with **bold** and `code`
- a
  - b
    * c
1. one
> said
---
 ***
##### too deep
```python
# no heading
- no list
~~~
```
~~~
```
inside tildes
~~~
| a | b |
|---|---|
   ```
indented
   ```
> 
#
-
```
never closed
# still code"""


def texts():
    rng = random.Random(1)
    pieces = [*TEXT.split("\n"), "```", "~~~ x", "", "   ", "plain", "``` a`b"]
    out = [None, "", "\n", TEXT, TEXT.replace("\n", "\r\n"), "a b\x0cc\rd"]
    out.append("\u3000- wide\n\u0663. digits\n#\u00a0x")
    return out + ["\n".join(rng.choice(pieces) for _ in range(rng.choice([3, 40, 300]))) for _ in range(8)]


@pytest.mark.parametrize("automaton", [M.TOGGLE, M.FENCES])
@pytest.mark.parametrize("chunk", [1, 7, M.CHUNK])
def test_same_as_reading_in_order(spark, automaton, chunk):
    rows = [(k if k else None, t, "x") for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(3)
    lines = M.lines_of(df, ["doc_id"])
    assert {(r.doc_id, r.at): r.line for r in lines.collect()} == {(k, n): x for k, t, _ in rows for n, x in enumerate((t or "").splitlines())}
    got = {(r.doc_id, r.at): (r.kind, r.level, r.content) for r in M.classify(lines, ["doc_id"], automaton=automaton, chunk=chunk).collect()}
    assert got == {(k, n): x for k, t, _ in rows for n, x in enumerate(plain(t, automaton))}


def test_marks_far_apart(spark):
    lines = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("at"), F.when(F.col("id") % 777 == 5, "```").otherwise("x").alias("line"))
    got = M.classify(lines, ["doc_id"], chunk=100)
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"fence": 26, "code": 10_088, "text": 9_886}


def test_spans(spark):
    rows = ["a **b** `c` d", "**only**", "``", "** no **bold** here", "**a*b**", "`x`**y**", "", None, "**** ` **"]
    df = spark.createDataFrame([(x,) for x in rows], "line string")
    got = [[tuple(s) for s in r.s] for r in df.select(M.spans(F.col("line")).alias("s")).collect()]

    def by_parts(text):
        out = []
        for x in re.split(r"(\*\*[^*\n]+\*\*|`[^`\n]+`)", text or ""):
            bold, code = (x.startswith(s) and x.endswith(s) and len(x) > 2 * len(s) for s in ("**", "`"))
            out += [("bold", x[2:-2])] if bold else [("code", x[1:-1])] if code else [("plain", x)] if x else []
        return out

    assert got == [by_parts(x) for x in rows]


def test_empty_table(spark):
    assert M.classify(spark.createDataFrame([], "k long, at long, line string"), ["k"]).count() == 0
