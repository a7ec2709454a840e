import pytest

from corpuslab.llm import decontaminate as D


@pytest.mark.parametrize("limit", [0, 10_000])
def test_items_inside_documents(spark, limit):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    docs = [
        (1, "x " * 3000 + item.upper().replace(" ", ",\n") + " y" * 3000, "c"),
        (2, item.replace("theta", "other"), "c"),
        (3, item.replace("theta", "other").replace("pi", "another"), "c"),
        (4, None, "c"),
        (5, "", "c"),
        (None, "so it is: two words.", "c"),
        (6, "nothing here", None),
        (1, "two, words", "c"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item), (11, "two words"), (12, ""), (13, None), (10, item)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.n_shared, r.n_shingles) for r in D.contained(docs, items, broadcast_shingles=limit).collect())
    assert got == [(0, 11, 1, 1), (1, 10, 16, 16), (1, 10, 16, 16), (1, 11, 1, 1)]
    some = sorted((r.doc_id or 0, r.n_shared) for r in D.contained(docs, items, percent=65, broadcast_shingles=limit).where("item_id = 10").distinct().collect())
    assert some == [(1, 16), (2, 11)]
    assert D.contained(docs.where("false"), items, broadcast_shingles=limit).count() == 0
    assert D.contained(docs, items.where("false"), broadcast_shingles=limit).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_signatures_lose_nothing(percent):
    for n in range(1, 3000):
        part = D.partition_of(n)
        assert n <= 1 << part and (part == 0 or n > 1 << (part - 1))
        missed = n - -(-percent * n // 100)
        assert min(n, D.signature_length(part, percent)) > missed


def test_stage_rows(spark, tmp_path):
    item = " ".join(f"word{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"x {item} y", 5), (1, "clean", 5), (None, item, 5), (None, None, 5), (2, "", 5), (2, "", 5), (3, "z " * 50_000 + item, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    got = D.stage(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "", r._key) for r in got.collect()) == [(0, "", 5), (1, "clean", 5), (2, "", 5), (2, "", 5)]
    assert D.stage(spark, df.where("false"), str(tmp_path)).count() == 0
