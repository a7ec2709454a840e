"""Batches are there as a whole or not at all, whoever dies or comes first."""

import subprocess
import sys
import textwrap

import pytest

from corpuslab.sources.versions import Conflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"), ["k"])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def held(table, version=None):
    return sorted(((r.k, r.v) for r in table.read(version).collect()), key=str)


def test_batches_replace_by_key_and_old_versions_stay(spark, table):
    assert table.manifest()["version"] == 0
    with pytest.raises(ValueError):
        table.read()
    assert table.commit(rows(spark, (1, "a"), (2, "b"), (2, "b2"), (None, "n"))) == 1
    assert table.commit(rows(spark, (2, "c"), (3, "d")), deleted=rows(spark, (1, ""), (9, ""))) == 2
    assert held(table) == [(2, "c"), (3, "d"), (None, "n")]
    assert held(table, 1) == [(1, "a"), (2, "b"), (2, "b2"), (None, "n")]
    assert table.commit(rows(spark, (1, "again")), deleted=rows(spark, (None, ""))) == 3
    assert held(table) == [(1, "again"), (2, "c"), (3, "d")]
    before = held(table)
    assert table.compact() == 4 and held(table) == before and table.compact() is None
    assert table.commit(rows(spark, (2, "later"))) == 5 and held(table) == [(1, "again"), (2, "later"), (3, "d")]
    with pytest.raises(ValueError):
        table.commit(spark.createDataFrame([(1, 2)], "k long, v int"))
    with pytest.raises(ValueError):
        table.commit(spark.createDataFrame([("x",)], "v string"))
    with pytest.raises(ValueError):
        table.read(77)


def test_a_batch_counts_once(spark, table):
    assert table.commit(rows(spark, (1, "a")), "w", 0) == 1
    assert table.commit(rows(spark, (1, "other")), "w", 0) is None
    assert table.commit(rows(spark, (1, "b")), "other", 0) == 2
    assert table.commit(rows(spark).limit(0), "w", 5) == 3
    assert table.commit(rows(spark, (1, "late")), "w", 4) is None
    assert held(table) == [(1, "b")]


def test_half_written_batches_are_not_there(spark, table, monkeypatch):
    table.commit(rows(spark, (1, "a")), "w", 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.commit(rows(spark, (1, "half"), (2, "half")), "w", 1)
    assert held(table) == [(1, "a")] and len(table._children("data")) == 2
    assert table.vacuum() == [] and len(table.vacuum(older_than=0)) == 1
    assert table.commit(rows(spark, (1, "whole"), (2, "whole")), "w", 1) == 2
    assert held(table) == [(1, "whole"), (2, "whole")]


def test_writers_come_one_after_another(spark, table, monkeypatch):
    table.commit(rows(spark, (1, "a")))
    publish, first = table._publish, []

    def late(manifest):
        if not first:
            first.append(VersionedTable(spark, table.path, ["k"]).commit(rows(spark, (2, "theirs")), "them", 0))
        publish(manifest)

    monkeypatch.setattr(table, "_publish", late)
    assert table.commit(rows(spark, (1, "ours"))) == 3 and first == [2]
    assert held(table) == [(1, "ours"), (2, "theirs")]
    monkeypatch.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(Conflict("always")))
    with pytest.raises(Conflict):
        table.commit(rows(spark, (1, "never")))


def test_folders_are_put_together(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], most_folders=3)
    for n in range(6):
        table.commit(rows(spark, (n % 4, f"v{n}")), "w", n)
    assert len(table.manifest()["folders"]) <= 3 and table.manifest()["last"] == {"w": 5}
    assert held(table) == [(0, "v4"), (1, "v5"), (2, "v2"), (3, "v3")]
    table.vacuum(keep=1, older_than=0)
    assert len(table.versions()) == 1 and held(table) == [(0, "v4"), (1, "v5"), (2, "v2"), (3, "v3")]


def test_a_stream_that_restarts(spark, tmp_path, table):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for n in range(2):
        rows(spark, (n, f"run {n}")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v string").parquet(source)
        stream.writeStream.foreachBatch(table.sink("stream")).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    table.sink("stream")(rows(spark, (0, "sent again")), 0)
    assert held(table) == [(0, "run 0"), (1, "run 1")]


def test_a_killed_job_goes_on_behind_its_last_batch(spark, tmp_path):
    work = spark.createDataFrame([(k, f"page {k}", k // 3) for k in range(9)], "k long, v string, batch int")
    work.write.partitionBy("batch").parquet(str(tmp_path / "work"))
    code = f"""
        import os
        from pyspark.sql import SparkSession
        from corpuslab.sources.versions import VersionedTable
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        table = VersionedTable(spark, "{tmp_path}/table", ["k"])
        publish = table._publish
        table._publish = lambda manifest: publish(manifest) if manifest["version"] < 2 else os._exit(9)
        table.commit_each(spark.read.parquet("{tmp_path}/work"), "batch", lambda df: df)
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], timeout=300, capture_output=True, cwd=str(pytest.importorskip("pathlib").Path(__file__).parents[1]))
    assert done.returncode == 9
    table = VersionedTable(spark, f"{tmp_path}/table", ["k"])
    assert table.versions() == [1] and [k for k, _ in held(table)] == [0, 1, 2] and len(table._children("data")) == 2
    read = spark.read.parquet(str(tmp_path / "work"))
    assert table.commit_each(read, "batch", lambda df: df) == 2 and table.commit_each(read, "batch", lambda df: df) == 0
    assert held(table) == [(k, f"page {k}") for k in range(9)]
