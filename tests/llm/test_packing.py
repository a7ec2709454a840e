import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from corpuslab.llm import packing


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing one item at a time: number of bins."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return len(left)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 23), max_size=60))
def test_runs_are_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in lengths}
    bins = defaultdict(list)
    placed = defaultdict(int)
    for length, first, count, first_bin, per_bin, offset in packing.best_fit_decreasing(histogram, 23):
        assert first == placed[length]
        placed[length] += count
        for q in range(count):
            bins[first_bin + q // per_bin].append((offset + q % per_bin * length, length))
    assert placed == histogram
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 23
    assert len(bins) == plain_best_fit(lengths, 23)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé '\t\n  　s9.<|>endoftx", max_size=30), max_size=4))
def test_cached_words_give_the_same_ids(texts):
    path = packing.public_path("byte_bpe_50k.json")
    encoder = packing._encoder(path)
    ids, edges = encoder.encode(pa.array(texts, pa.string()))
    plain = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts] if any("<|endoftext|>" in t for t in texts) else [x.tolist() for x in encoder.whole(texts)]
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == plain


def test_special_strings_are_what_the_tokenizer_makes_of_them():
    path = packing.public_path("byte_bpe_50k.json")
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b\nc", "plain words", None, "x  y", " x", "a\n\nb", "tab\tin word", "\tlead"]
    ids, edges = packing._encoder(path).encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    tokenizer = Tokenizer.from_file(path)
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[0] == [31373, 220, 50256, 995]


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 500)
    encoder = packing.WordCachedEncoder(packing.public_path("byte_bpe_50k.json"))
    for k in range(6):
        texts = [" ".join(f"word{k * j % 97} and" for j in range(60)), f"one\ntwo {k}"]
        ids, edges = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [x.tolist() for x in encoder.whole(texts)]


def check(rows, texts):
    t = Tokenizer.from_file(packing.public_path("byte_bpe_50k.json"))
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = [*t.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 2048 for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_bin)


def test_query_round_trip(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = packing.query(spark, sf_dir).collect()
    assert check(rows, texts) == plain_best_fit([r.length for r in rows], 2048)


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "word " * 6000, 7), (4, "same", 8), (4, "same", 8), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = packing.pack_documents(df).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got)[:3] == [(0, 0, 2), (1, 0, 1), (2, 0, 1)]
    assert sum(r.doc_id == 4 for r in got) == 2
    assert packing.pack_documents(df.where("false")).count() == 0
