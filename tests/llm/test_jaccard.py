import re
from collections import defaultdict

import numpy as np
import pytest

from corpuslab.llm import graph, jaccard


def brute(texts):
    """doc_id -> (size, component) by comparing all pairs that share a shingle."""
    sets = {}
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    holders = defaultdict(set)
    for doc, s in sets.items():
        for x in s:
            holders[x].add(doc)
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for doc, s in sets.items():
        for other in set().union(*[holders[x] for x in s]) if s else ():
            both = len(s & sets[other])
            if other < doc and 100 * both >= 80 * (len(s) + len(sets[other]) - both):
                a, b = sorted((find(doc), find(other)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in texts}


def links(texts):
    """doc_id -> number of different other sets that its set links with."""
    words = {d: (t or "").lower().split() for d, t in texts.items()}
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))) for d, w in words.items()}
    return {d: sum(100 * len(s & o) >= 80 * len(s | o) for o in set(sets.values()) - {s} if o) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert result(jaccard.query(spark, sf_dir)) == brute(texts)


@pytest.mark.parametrize("most", [200])
def test_large_groups_of_near_copies_recur(spark, most):
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for k in range(24):  # copies with one word changed, some of which link only with each other
        words = list(base)
        words[k % 55 + 2] = f"x{k}"
        if k % 7 == 0:
            words[(k * 3) % 50 + 4] = f"y{k}"
            words[(k * 5) % 40 + 9] = f"z{k}"
        texts[k] = " ".join(words)
    texts |= {100: "a b c", 101: "A B c", 102: "", 103: None, 104: "a b c d", 105: " ".join(base[:30])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(jaccard.join(df, small=4, most=most)) == brute(texts)


def test_bucket_counts_bound_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 300, 300, 900, 5000, 5000)]
    sets += [np.union1d(sets[-1][:4500], sets[4]), np.arange(0, 2**20, 256, dtype=np.uint64)]  # one bucket holds all of the last
    for x in sets:
        for y in sets:
            a, b = jaccard.bucket_counts(x)[None], jaccard.bucket_counts(y)[None]
            few = min(a.shape[1], b.shape[1])
            assert jaccard.most_common(jaccard.folded(a, few), jaccard.folded(b, few))[0] >= len(np.intersect1d(x, y))
    a, b = (jaccard.bucket_counts(sets[k])[None] for k in (5, 6))
    assert jaccard.most_common(a, b)[0] < 0.7 * 5000  # unrelated sets are parted however large they are


@pytest.mark.parametrize("most", [200, 2000, jaccard.MOST])
def test_numbers_of_links(spark, most):
    texts = {}
    for k in range(40):  # chains and dense groups of near copies, some of them exact copies
        words = [f"g{k % 3}w{i}" for i in range(70)]
        for j in range(k % 5):
            words[(k * 7 + j * (9 if k % 2 else 1)) % 70] = f"x{k if k % 4 else 0}"
        texts[k] = " ".join(words)
    texts |= {50: texts[7].upper(), 51: "a b c d e f", 52: "", 53: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = links(texts)
    assert max(want.values()) > 5 and len(set(want.values())) > 4
    assert {r.doc_id: r.n_links_measured for r in jaccard.join(df, most=most).collect()} == want


def test_cells_of_pivots_part_a_region_that_hangs_together(spark):
    texts = {}
    for k in range(12):  # texts that share some rare words with the next, so that one region holds them all
        words = [f"t{k}w{i}" for i in range(80)]
        words[60:] = [f"t{(k + 1) % 12}w{i}" for i in range(20)]
        for j in range(5):
            own = list(words)
            own[(j * 17 + k) % 60] = f"x{j}"
            texts[k * 10 + j] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = jaccard.shingle_sets(jaccard.pa.array(texts.values()))
    rows = [("r", k.to_bytes(4, "big"), len(s), 0, s.view("int64").tolist()) for k, s in zip(texts, sets, strict=True)]
    large = spark.createDataFrame([r[:4] for r in rows], "region string, name binary, n long, mask long")
    shingles = spark.createDataFrame([(r[1], r[4]) for r in rows], "name binary, shingles array<long>")
    cells = jaccard._recursed(shingles, large, 80, 1000, 4).collect()
    assert len({r.region for r in cells}) > 4 and all(r.w < 0.9 * sum(map(len, sets)) for r in cells)
    together = {}
    for region in {r.region for r in cells}:
        held = [r for r in cells if r.region == region]
        for x in held:
            for y in held:
                if x.name < y.name and x.mask & y.mask == 0:
                    together[x.name, y.name] = together.get((x.name, y.name), 0) + 1
    assert set(together.values()) == {1}
    names = [k.to_bytes(4, "big") for k in texts]
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(set(x.tolist()) & set(sets[j].tolist()))
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                assert (names[i], names[j]) in together
    for most in (300, 3000):
        assert {r.doc_id: r.n_links_measured for r in jaccard.join(df, most=most, pivots=3).collect()} == links(texts)


def test_edge_rows(spark):
    rows = [(5, "one two three four five six", 1), (5, "one two three four five six", 1), (None, "one two three four five six", 2), (3, "ONE two three four five six", None), (4, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == [(-1, 2, None), (3, 2, 3), (4, 0, 4), (5, 2, 3), (5, 2, 3)]
    assert jaccard.join(df.where("false")).count() == 0
    staged = jaccard.stage(spark, df, "")
    assert sorted(r.doc_id or -1 for r in staged.collect()) == [-1, 3, 4]
    assert staged.columns == df.columns


def test_stage_keeps_what_is_nobodys_near_duplicate(spark):
    copied, alone = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, copied), (5, alone), (5, copied), (5, copied), (6, "p q r s t u"), (6, "p q r s t u"), (7, ""), (7, "")]
    rows += [(None, "a b c d e f"), (None, "g h i j k l"), (None, copied)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for given in (rows, rows[::-1]):
        got = jaccard.stage(spark, spark.createDataFrame(given, df.schema), "").collect()
        want = [(3, copied), (5, alone), (6, "p q r s t u"), (7, ""), (7, ""), *rows[-3:]]
        assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((d or -1, t) for d, t in want)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
