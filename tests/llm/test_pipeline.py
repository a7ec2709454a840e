"""Each stage of the pipeline against a plain version on its own input."""

import os
import re

import corpus_pipeline
from corpuslab.llm import pii
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_packing import check as packed


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "quality_rules":
            assert after.keys() < before.keys()
            assert all(set(t.split("\n")) <= set(before[d].split("\n")) for d, t in after.items())
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", before[d])) >= 10 for d in after)
        elif name == "ngram_jaccard_join":
            assert after == {d: before[d] for d, (_, c) in classes(before).items() if c == d}
        elif name == "decontamination":
            clean = {d: t for d, t in before.items() if not any(100 * len(i & s) >= 80 * len(i) for s in [shingles(t)] for i in items)}
            assert after == clean and len(clean) < len(before)
        elif name == "personal_data":
            assert after.keys() == before.keys()
            assert not any(pii.detect(t) for t in after.values())
            assert all(after[d] == t for d, t in before.items() if not pii.detect(t) and not pii.disguised(t, []))
        else:
            packed(rows, before)
            continue
        before = after


def test_edge_rows_through_all_stages(spark, tmp_path):
    prose = "The first line of this text has enough words to stay, as all of them do here."
    item = "a passage of the benchmark that nobody may train a model on, since it is tested with it"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    far = " ".join(f"w{k}" for k in range(30_000)) + "."
    rows = [(1, prose), (1, prose), (2, prose.upper()), (3, None), (4, ""), (None, f"{prose} Yet another one."), (None, None), (5, f"{prose} {item}"), (6, f"{prose} Mail to joe@example.org about it, please do.\nHome | Shop | Cart"), (7, far)]
    schema = "doc_id long, text string, _row string, _key int, _text int, n_shingles int, spans string, kept boolean"
    df = spark.createDataFrame([(*r, "r", 1, 2, 3, "s", True) for r in rows], schema)
    for given in (df, df.where("false")):
        docs = given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{given is df}-{k}")
            out.write.parquet(path)
            if k < 4:
                assert out.columns == df.columns
            docs = spark.read.parquet(path) if k < 4 else spark.read.parquet(path).orderBy("doc_id", "piece")
            if k == 3 and given is df:
                left = sorted((r.doc_id or 0, r.text) for r in docs.collect())
                assert left == [(0, f"{prose} Yet another one."), (1, prose), (6, f"{prose} Mail to [EMAIL] about it, please do."), (7, far)]
                assert {tuple(r)[2:] for r in docs.collect()} == {("r", 1, 2, 3, "s", True)}
        assert docs.where("doc_id = 7").count() > 1 or given is not df


def test_run_leaves_no_tables_behind(spark, sf_dir):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and new.pop().startswith("pipeline-")
