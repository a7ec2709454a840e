"""The audit against plain loops over documents and orders, and tries against dictionaries."""

import itertools
import random
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuslab.llm import filter_audit as A
from tests.test_catalog import normal


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 5))))
def test_trie_holds_texts_in_order(items):
    trie, plain = A.TextTrie(), defaultdict(list)
    for text, i in items:
        trie.insert(text, (i, "x"))
        plain[text].append((i, "x"))
    assert list(trie.terminals()) == [(t, plain[t], min(plain[t])[0]) for t in sorted(plain)]


def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.choice([10, 60, 200]))) for _ in range(40)]
    texts += [t + " A#" for t in texts[:10]] + ["BIG " * 60, "é" * 30, "#" * 5, "   ", "x", "", None]
    long = "same beginning " * 500
    texts += [long + str(k) for k in range(12)] + [long * 40]
    out = [(k, t, rng.choice(["a", "b", None, ""]), 1) for k, t in enumerate(texts)]
    out += [(1000 + k, texts[3], "b", 1) for k in range(200)] + [(2000 - k, long, "a", 1) for k in range(60)]
    out += [(7, texts[7], "a", 1)] * 3 + [(None, texts[7], "a", 1)] * 2 + [(None, None, None, 1), (8, "other", "b", 1)]
    rng.shuffle(out)
    return out


LABELS = [(k, int(k % 3 > 0), int(k % 7 == 0)) for k in range(40)] + [(3, 0, 1), (1001, 1, 1), (None, 1, 1), (9, None, None)]


def plain(rows, labels):
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    quality, toxic = (({i for i, *x in labels if x[k] == 1 and i is not None}) for k in (0, 1))
    docs = []
    for i, t, part, _ in rows:
        t = t or ""
        w = t.split(" ")
        w = [x for x in w if x]
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        docs.append((part or "", {x for x in f if f[x]}, i in quality, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                gone = [bool(d[1] & set(order[: step - 1])) for d in own]
                fails = [x in d[1] for d in own]
                here = [d for d, f, g in zip(own, fails, gone, strict=True) if f and not g]
                shapley[x] += len(here)
                out[part, order, step] = [sum(not f and not g for f, g in zip(fails, gone, strict=True)), len(here), sum(f and g for f, g in zip(fails, gone, strict=True)), sum(d[1] == {x} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("load,remembered", [(A.LOAD, A.REMEMBERED), (3000, 5), (20_000, 0)])
def test_same_as_plain_loops(spark, load, remembered):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n int").repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = A.audit(df, labels, load=load, remembered=remembered).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in NAMES) for r in got} == plain(data, LABELS)
    assert len(got) == 3 * 600


def test_sql_over_the_same_rows(spark):
    data = rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, n INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", data)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    found = con.execute(A.ORACLE)
    names = [d[0] for d in found.description]
    want = [(p, o, s, *x) for (p, o, s), x in plain(data, LABELS).items()]
    assert normal([tuple(r) for r in found.fetchall()], names) == normal(want, ["part", "filter_order", "step", *NAMES])


def test_ids_of_strings_and_an_empty_table(spark):
    df = spark.createDataFrame([("b", "x", "s"), ("a", "x", "s"), ("c", "y", "s")], "doc_id string, text string, source string")
    got = {(r.doc_id, r.failed, r.n) for r in A.failures(df).collect()}
    assert got == {("a", 1, 1), ("b", 17, 1), ("c", 1, 1)}
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    assert A.audit(df.where("false"), labels).count() == 0
