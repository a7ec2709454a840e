import math
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import batches, elias_fano, language_model as LM


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**40 - 1), max_size=300), min_size=1, max_size=4), st.lists(st.integers(0, 2**40 - 1), max_size=50))
def test_elias_fano_finds_what_is_there(blocks, others):
    blocks[0] |= set(range(1000, 5000))  # many in one range of high bits
    with tempfile.TemporaryDirectory() as folder:
        writer = elias_fano.Writer(folder, 3)
        for k, values in enumerate(blocks):
            if values:
                writer.add(k + 3, np.array(sorted(values), np.uint64), 40, {"codes": np.arange(len(values), dtype=np.uint16)})
        file = elias_fano.opened(writer.close())
        for k, values in enumerate(blocks):
            asked = np.array([*sorted(values), *others], np.uint64)
            place = {v: i for i, v in enumerate(sorted(values))}
            assert file.held(np.array([k + 3]))[0] == bool(values)
            if values:
                got = file.find(np.full(len(asked), k + 3), asked)
                assert got.tolist() == [place.get(int(v), -1) for v in asked]
                hit = got[got >= 0]
                assert file.column("codes", "u2", np.full(len(hit), k + 3), hit).tolist() == hit.tolist()


def test_neighbours_with_the_same_high_bits_share_one_select(tmp_path, monkeypatch):
    values = np.append(np.arange(5000), np.arange(1, 200) << 30).astype(np.uint64)  # all of the first range and some sparse ones
    writer = elias_fano.Writer(str(tmp_path), 0)
    writer.add(0, values, 40, {})
    file = elias_fano.opened(writer.close())
    asked, select = [], elias_fano.Blocks._zero
    monkeypatch.setattr(elias_fano.Blocks, "_zero", lambda self, of, k: asked.append(len(k)) or select(self, of, k))
    assert file.find(np.zeros(len(values), np.int64), values).tolist() == list(range(len(values)))
    assert sum(asked) <= 2 * 200


def test_select_in_words():
    words = np.random.default_rng(5).integers(1, 2**64, 200, dtype=np.uint64)
    for word in (*words, np.uint64(1), np.uint64(1 << 63), np.uint64(2**64 - 1)):
        places = [k for k in range(64) if int(word) >> k & 1]
        assert elias_fano._select(np.full(len(places), word), np.arange(len(places))).tolist() == places


def tokens_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def plain(train, texts, least=0):
    """The same model in dictionaries, without quantisation."""
    counts = [Counter() for _ in range(3)]
    for t in map(tokens_of, train):
        for n in range(3):
            counts[n].update(tuple(t[i - n : i + 1]) for i in range(n, len(t)))
    total, distinct = sum(counts[0].values()), len(counts[0])
    kept = [counts[0], *({g: c for g, c in x.items() if c > least} for x in counts[1:])]
    follow, mass = Counter(), Counter()
    for n in (1, 2):
        for g, c in counts[n].items():
            follow[g[:-1]] += c
    for n in (1, 2):
        for g, c in kept[n].items():
            mass[g[:-1]] += (c - LM.DISCOUNT) / follow[g[:-1]]
    for text in texts:
        t = tokens_of(text)
        base = score = 0.0
        for i, w in enumerate(t):
            p = (counts[0][w,] + 1) / (total + distinct + 1)
            base += math.log10(p)
            for n in (1, 2):
                context = tuple(t[i - n : i])
                if i >= n and context in kept[n - 1] and follow[context]:
                    g = (*context, w)
                    p = ((kept[n][g] - LM.DISCOUNT) / follow[context] if g in kept[n] else 0) + max(1 - mass[context], 1e-6) * p
            score += math.log10(p)
        yield len(t), sum(counts[0][w,] > 0 for w in t), base, score, total


def test_query_against_plain_counts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    want = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows if not held[r.doc_id]], [r.text for r in rows]), strict=True))
    got = LM.query(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, base, score, total = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) < 0.002 * n + 0.5
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_a_small_block_splits_frequent_words_and_pairs(spark):
    train = ["the cat the dog the cat", *(f"the cat {w} the the {w}" for w in "abcdefghij"), "", None, "x " * 5000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(train)], "doc_id long, text string")
    texts = [*train, "the zebra the cat q", "unknown words", "x x x y"]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for least in (1, 2):
        want = list(plain(train, texts, least - 1))
        for tokens in (3, 1 << 20):
            model = LM.train(df.select("text"), block_tokens=tokens, min_count=least)
            if tokens == 3:
                assert max(model.levels[2].parts) > 100 and max(model.levels[3].parts) > 100
            for r in LM.score(asked, model).collect():
                n, known, base, score, total = want[r.doc_id]
                assert (r.n_tokens, r.n_known, model.tokens) == (n, known, total)
                assert math.isclose(r.base_score, base, rel_tol=1e-9)
                assert abs(r.score - score) < 0.002 * n + 0.5


def test_counting_reads_nodes_alone(spark, monkeypatch):
    df = spark.createDataFrame([("a b a c",), ("b a b",)], "text string")
    reader = LM.Reader(LM.train(df, block_tokens=3))
    tokens, place = LM._tokens(pa.array(["a b a b", "c a zebra b a"]))
    ids, _ = reader.words(tokens)
    want = [node.tolist() for node, _, _ in reader.nodes(3, ids, place)]
    read, column = [], elias_fano.Blocks.column
    monkeypatch.setattr(elias_fano.Blocks, "column", lambda self, name, *of: read.append(name) or column(self, name, *of))
    assert [node.tolist() for node, _, _ in reader.nodes(3, ids, place, valued=False)] == want
    assert not read and max(want[1]) >= 0


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b a b", 3)], "doc_id long, text string, score int")
    model = LM.train(df.select("text"))
    got = LM.score(df, model).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (2, 5, 5)]
    none = df.where("false")
    assert LM.score(none, LM.train(none.select("text"))).count() == 0


def test_the_model_is_where_spark_resolves_its_folder(spark, tmp_path):
    assert batches.located(spark, str(tmp_path)) == f"file://{tmp_path}" == batches.located(spark, f"file://{tmp_path}")
