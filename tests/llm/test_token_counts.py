"""Counts of huge documents, cut anywhere, against the vocabulary's library over whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import token_counts as T

PATH = T.public_path("piece_bpe_32k.model")


def plain(texts):
    return [len(x) for x in T.encoder(PATH).encode([t or "" for t in texts])]


def texts():
    rng = random.Random(5)
    words = "the of data spark aaaa naïve 東京 12345 ▁x <s> https://a.b/c?d=e \n \t __init__ émoji 😀 ==== ....".split(" ")
    prose = " ".join(rng.choice(words) for _ in range(3000))
    runs = "x " * 40 + "a" * 5000 + " b" + " " * 3000 + "c" + "=" * 2500 + "ab" * 2000
    return [None, "", " ", "short", prose, prose, runs, "▁" * 700 + "word" * 900, "\n" * 4000, "東" * 3000 + "😀" * 1500, "aab" * 3000, "\0a" * 900]


def test_any_cut_gives_the_same_counts(spark):
    rows = [(k if k else None, t, "x") for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    want = sorted((k or 0, len((t or "").encode()), n, n > 500) for (k, t, _), n in zip(rows, plain(texts()), strict=True))
    for chunk, overlap in ((200, 64), (1000, 100), (1 << 15, 256)):
        got = T.count(df, limit=500, chunk=chunk, overlap=overlap)
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


def test_long_runs_need_wider_overlaps(spark, monkeypatch):
    rounds = []
    wider = T._wider_windows
    monkeypatch.setattr(T, "_wider_windows", lambda cores, failed, more: rounds.append(more) or wider(cores, failed, more))
    text = "b" + "a" * 3001
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert T.count(df, chunk=203, overlap=70).head().n_tokens == plain([text])[0]
    assert rounds[:3] == [1, 2, 4] and rounds[-1] <= 16


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab e▁é東\n0<>s", max_size=24), min_size=2, max_size=5))
def test_a_row_of_pieces_is_the_encoding_if_all_neighbours_are(parts):
    own = T.encoder(PATH)
    whole = own.encode(["".join(parts)])[0]
    assert sum(own.lengths[whole]) == len((" " + "".join(parts).replace("▁", " ")).encode()) or not whole
    for a, b in zip(whole[1:], whole[2:], strict=False):
        if not any(own.model.is_byte(x) for x in (a, b)):
            # behind a character that nothing merges with
            pair = "".join(own.model.id_to_piece([a, b]))
            assert own.encode(["\n" + pair])[0][-2:] == [a, b]


def test_empty_table_and_bounds(spark, sf_dir):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.count(df).count() == 0
    with pytest.raises(ValueError):
        T.count(df, chunk=100, overlap=64)
    rows = T.query(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = dict(zip(docs, plain(docs.values()), strict=True))
    assert len(rows) == len(docs) and all(r.n_tokens == counts[r.doc_id] and r.over_limit == (r.n_tokens > 4096) for r in rows)
