"""Alignment against a plain reading with dictionaries."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuslab.llm import alignment as A
from corpuslab.llm.packing import public_path
from corpuslab.llm.token_counts import encoder

FIRST, SECOND = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")


def plain(docs):
    """One tuple for each (doc_id, text)."""
    tokenizer = Tokenizer.from_file(FIRST)
    tokenizer.encode_special_tokens = True
    own = {i: p for p, i in json.load(open(FIRST, encoding="utf-8"))["model"]["vocab"].items()}
    byte = A.byte_level_characters()
    model = encoder(SECOND).model
    found, counts = [], Counter()
    for doc, text in docs:
        a, b = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        whole = (" " + (text or "")).encode()
        bytes_a = [bytes(byte[c] for c in own[i]) for i in a]
        pieces = [model.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = ([sum(len(x) for x in side[: k + 1]) for k in range(len(side))] for side in (bytes_a, bytes_b))
        groups, links, i, j = [], [], 0, 0
        for x, end in enumerate(ends_a):
            if end in ends_b:
                y = ends_b.index(end)
                groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
                links.append((a[x], b[y]))
                i, j = x + 1, y + 1
        counts.update(links)
        found.append((doc, a, b, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for doc, a, b, groups, links in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out, counts


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("held,fan_in", [(A.HELD, A.FAN_IN), (20, 2)])
def test_same_as_plain_reading(spark, held, fan_in):
    texts = [None, "", " ", "hello world", "Hello, wörld 東京 😀!\n\n x", "a ▁ b", "<|endoftext|> <s></s> <0x0A>", "the the the", "  two  spaces ", "tab\tand\0null", "word " * 700]
    docs = [(k, t) for k, t in enumerate(texts)] + [(3, "hello world")] * 5 + [(None, "hello the")] * 2
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, row string, n_a int").repartition(3)
    got = [tuple(r[c] for c in NAMES) for r in A.align(df, held=held, fan_in=fan_in).collect()]
    want, counts = plain(docs)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r.n for r in A.links(df, held=held, fan_in=fan_in).collect()} == counts


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = [d for d in docs if len(d[1]) < 5000]
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in A.align(spark.createDataFrame(short, "doc_id long, text string"), held=5000, fan_in=3).collect()}
    assert got == {x[0]: x for x in plain(short)[0]}
    assert A.query(spark, sf_dir).count() == len(docs)


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert A.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].count_sum == 0


@given(st.lists(st.dictionaries(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=6))
def test_lists_merge(parts):
    blobs = [A._list_blob(np.array(sorted(p), np.int64), np.array([p[k] for k in sorted(p)], np.int64)) for p in parts]
    assert dict(A.merged(blobs)) == sum((Counter(p) for p in parts), Counter())
    assert [k for k, _ in A.merged(blobs)] == sorted(set().union(*parts))
