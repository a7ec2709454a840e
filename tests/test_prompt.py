import json

from pyspark.sql import functions as F

from corpuslab.operators import prompt
from corpuslab.operators.prompt import Section

SECTIONS = [Section("base"), Section("index", "Index", "(none)"), Section("memory", "Memory", limit=6), Section("tasks", "Tasks")]


def plain(rows, budget):
    out = {}
    for key in {r[0] for r in rows if r[1] != "other"}:
        left, stopped, parts, n, cost = budget, False, [], 0, 0
        for s in SECTIONS:
            held, limit = [], s.limit if s.limit is not None else budget
            used = 0
            for _, _, at, text in sorted((r for r in rows if r[0] == key and r[1] == s.name), key=lambda r: (r[2], r[3] or "")):
                used += len(text or "")
                if used > limit:
                    break
                if stopped or len(text or "") > left:
                    stopped = True
                    break
                left -= len(text or "")
                held.append(text or "")
            n, cost = n + len(held), cost + sum(map(len, held))
            text = "\n".join(held) if held else s.otherwise
            if text is not None:
                parts.append((f"## {s.heading}\n\n" if s.heading else "") + text)
        out[key] = ("\n\n".join(parts), n, cost)
    return out


def test_prompts_under_budgets(spark):
    rows = [("a", "base", 0, "hello"), ("a", "index", 2, "two"), ("a", "index", 1, "one"), ("a", "memory", 1, "1234"), ("a", "memory", 2, "56"), ("a", "memory", 3, "7"), ("a", "tasks", 1, None)]
    rows += [("b", "tasks", 1, "do"), ("b", "other", 1, "never"), (None, "base", 0, "x"), ("c", "other", 0, "x")] + [("d", "index", k, f"row {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "k string, section string, at int, text string").repartition(5)
    for budget in (0, 3, 11, 14, 50, 10_000):
        got = {r.k: (r.prompt, r.rows, r.cost) for r in prompt.assemble(df, "k", SECTIONS, budget=budget).collect()}
        assert got == plain(rows, budget)
    assert prompt.assemble(df.where("false"), "k", SECTIONS).count() == 0


def test_messages_of_several_dialects(spark):
    messages = [
        {"role": "tool", "content": {"a": 1}},
        {"role": "tool", "tool_call_id": "call_7", "content": "done"},
        {"role": "assistant", "tool_calls": [{"id": "x"}], "content": None},
        {"role": "user", "content": [{"type": "text", "text": "one"}, "two", {"image": 1}, 3]},
        {"role": "user", "content": "plain é"},
        {"content": ""},
        {"role": "system"},
        [1],
    ]
    df = spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(messages)] + [(8, "no json"), (9, None)], "k int, message string")
    got = {r.k: (r.role, r.content, r.tool_call_id, r.tool_calls) for r in prompt.normalise(df).collect()}
    assert got == {
        0: ("tool", '{"a":1}', "call_0", None), 1: ("tool", "done", "call_7", None), 2: ("assistant", None, None, '[{"id":"x"}]'), 3: ("user", "one\ntwo\n\n3", None, None),
        4: ("user", "plain é", None, None), 5: ("", "", None, None), 6: ("system", "", None, None), 7: (None,) * 4, 8: (None,) * 4, 9: (None,) * 4,
    }


def test_replies(spark):
    call = lambda **f: {"function": f}
    replies = [
        {"choices": [{"message": {"content": "hi", "tool_calls": [call(name="f", arguments='{"a": 1}'), call(name="g", arguments="not json") | {"id": "c"}, call(name="h", arguments={"b": [2]}), call(name="k")]}}]},
        {"choices": [{"message": {"content": None}}]},
        {},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(replies)] + [(3, "broken"), (4, None)], "k int, reply string")
    got = {r.k: (r.content, [tuple(c) for c in r.calls]) for r in prompt.parse_response(df).collect()}
    assert got[0] == ("hi", [("call_0", "f", '{"a":1}'), ("c", "g", '{"raw":"not json"}'), ("call_0", "h", '{"b":[2]}'), ("call_0", "k", "{}")])
    assert all(got[k] == ("", []) for k in range(1, 5))


def test_ranges_cut_long_keys(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.lit("index").alias("section"), F.col("id").alias("at"), F.lit("12345").alias("text"))
    got = prompt.assemble(df.repartition(8), "k", SECTIONS, budget=5003).head()
    assert (got.rows, got.cost) == (1000, 5000)
    wide = df.withColumn("text", F.when(F.col("at") == 10, F.repeat(F.lit("x"), F.lit(9000))).otherwise(F.col("text")))
    got = prompt.assemble(wide.repartition(8), "k", SECTIONS, budget=5003).head()
    assert (got.rows, got.cost) == (10, 50)
