import pytest
from pyspark.sql import functions as F

from corpuslab.operators.extraction_cache import ExtractionCache


def lengths(df):
    return df.select("content", F.length("text").alias("size"))


@pytest.fixture
def docs(spark):
    rows = [(1, "one"), (2, "two two"), (3, "one"), (4, None), (5, ""), (None, "null id")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(run):
    return sorted(((r.doc_id, r.size, r.run) for r in run.rows.collect()), key=str)


def test_each_content_once(spark, docs, tmp_path):
    cache = ExtractionCache(spark, str(tmp_path / "c"), lengths, "v1")
    first = cache.run(docs, "first")
    assert first.extracted == 4 and got(first) == sorted([(1, 3, "first"), (2, 7, "first"), (3, 3, "first"), (4, 0, "first"), (5, 0, "first"), (None, 7, "first")], key=str)
    assert cache.run(docs, "again").extracted == 0
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 1, "changed").otherwise(F.col("text")))
    second = cache.run(changed, "second")
    assert second.extracted == 1 and (1, 7, "second") in got(second) and (3, 3, "first") in got(second)
    newer = ExtractionCache(spark, str(tmp_path / "c"), lambda df: df.select("content", (F.length("text") * 10).alias("size")), "v2")
    assert newer.run(changed, "third").extracted == 5 and cache.run(changed, "fourth").extracted == 0
    assert newer.collect(changed.where("doc_id > 1")) == 2
    assert cache.run(changed.where("doc_id = 1"), "fifth").extracted == 0
    assert newer.collect(changed.where("doc_id = 2"), all_rules=True) == 7
    assert [(r.rules, r.size) for r in newer.table.read().collect()] == [("v2", 70)]
    assert newer.run(docs.where("false"), "empty").rows.count() == 0


def test_a_run_that_dies_has_lost_one_batch(spark, docs, tmp_path):
    calls = []

    def dies(df):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return lengths(df)

    cache = ExtractionCache(spark, str(tmp_path / "c"), dies, "v1")
    many = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    with pytest.raises(KeyboardInterrupt):
        cache.run(many, "first")
    kept = cache.table.read().count()
    assert 0 < kept < 40
    second = cache.run(many, "second")
    assert second.extracted == 40 - kept and second.rows.where("run = 'first'").count() == kept


def test_clashing_names(spark, docs, tmp_path):
    cache = ExtractionCache(spark, str(tmp_path / "c"), lengths, "v1")
    with pytest.raises(ValueError):
        cache.results(docs)
    with pytest.raises(ValueError):
        cache.run(docs.withColumn("size", F.lit(1)), "x")
