import re

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import notes, relations
from corpuslab.plans import access, dispatch
from corpuslab.plans.catalog import QUERIES
from corpuslab.sources import lin

LDF = """LIN_description_file;
LIN_speed = 19.2 kbps;
Nodes {
  Master: head, 5 ms, 0.1 ms;
  Slaves: door , roof;
}
Signals {
  lamp: 2, 0, head, door;
  wind: 16, {1, 2}, door, head, roof;
  lost: 7, 0x1, nobody; // comment
}
Frames {
  one: 0x0A, head, 1 {
    lamp, 0;
  }
  two: 11, door, 2 {
    wind, 0;
    lost, 12;
  }
}
Schedule_tables {
  normal {
    one delay 10 ms;
    two delay 20.5 ms;
  }
}
"""


def test_lin_files(spark):
    files = spark.createDataFrame([("a.ldf", LDF)], "path string, text string")
    nodes, signals, frames = lin.nodes(files), lin.signals(files), lin.frames(files)
    assert [(r.name, r.role, r.time_base) for r in nodes.orderBy("seq").collect()] == [("head", "Master", 5.0), ("door", "Slave", 0.0), ("roof", "Slave", 0.0)]
    assert [(r.name, r.size, r.init_value, r.publisher, r.subscribers, r.frame, r.offset) for r in signals.orderBy("seq").collect()] == [
        ("lamp", 2, "0", "head", ["door"], "one", 0),
        ("wind", 16, "{1, 2}", "door", ["head", "roof"], "two", 0),
        ("lost", 7, "0x1", "nobody", [], "two", 12),
    ]
    assert [(r.name, r.frame_id, r.size) for r in frames.orderBy("seq").collect()] == [("one", 10, 1), ("two", 11, 2)]
    assert [(r.table, r.frame, r.delay_ms) for r in lin.schedules(files).orderBy("seq").collect()] == [("normal", "one", 10.0), ("normal", "two", 20.5)]
    bad = relations.dangling(signals, "publisher", nodes, "name", "publisher", "name")
    assert [r.row for r in bad.collect()] == ["lost"]
    over = relations.overflows(frames.select(F.col("name").alias("f"), F.col("size").alias("bytes")), "f", "bytes", signals, "frame", "offset", "size")
    assert [r.name for r in over.collect()] == ["lost"]
    text = lin.render_signals(signals).first().section + lin.render_frames(frames, signals).first().section
    again = spark.createDataFrame([("a.ldf", text)], "path string, text string")
    assert sorted(map(tuple, lin.signals(again).drop("subscribers").collect())) == sorted(map(tuple, signals.drop("subscribers").collect()))
    assert "two: 0x0B, door, 2 {" in text


def test_notes_and_dispatch(spark):
    kept = notes.remember(spark.createDataFrame([("a", "1"), ("ab", "2")], "key string, content string"), "a", r"\1 new")
    assert sorted(map(tuple, notes.recall(kept).collect())) == [("a", r"\1 new"), ("ab", "2")]
    tasks = spark.createDataFrame([(1, "x", "done", "high"), (2, "y", "odd", "low")], "id long, content string, status string, priority string")
    assert tuple(notes.progress(tasks).first()) == (1, 2)
    assert [r.id for r in notes.invalid(tasks).collect()] == [2]
    docs = spark.createDataFrame([(1, "s", "# First\nhit")], "doc_id long, source string, text string")
    assert dispatch.execute("list", docs).first().title == "First"
    assert dispatch.execute("grep", docs, "HIT").first().n_hits == 1
    with pytest.raises(PermissionError):
        dispatch.execute("delete", docs, docs, "doc_id", most=access.Permission.READ)
    with pytest.raises(KeyError):
        dispatch.execute("none")
    assert dispatch.describe(spark).count() == len(dispatch.OPERATIONS)


def test_access(spark):
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/a/ro/x",)], "p string")
    read = df.where(access.allowed(F.col("p"), ["/a/ro"], ["/a/"]))
    assert [r.p for r in read.collect()] == ["/a", "/a/b", "/a/ro/x"]
    assert [r.p for r in df.where(access.allowed(F.col("p"), ["/a/ro"], ["/a/"], write=True)).collect()] == ["/a", "/a/b"]
    calls = spark.createDataFrame([("edit",), ("look",)], "name string")
    tools = spark.createDataFrame([("edit", 1)], "name string, permission int")
    assert [r.name for r in access.may_run(calls, tools, access.Permission.READ).collect()] == ["look"]


def test_readers_and_sinks(spark, tmp_path):
    from corpuslab.sources import readers

    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "node_modules" / "x.md").write_text("no")
    (tmp_path / "src" / "a.md").write_text("# T\n")
    (tmp_path / "src" / "b.html").write_text("<h1>H</h1>")
    (tmp_path / "src" / "c.csv").write_text("\ufeffp,q\n1,x|y\n" + "2,z\n" * 100)
    (tmp_path / "src" / "d.py").write_text('def f():\n    """A docstring of words."""\n    return 1  # short\n')
    got = {r.path[-4:]: r.text for r in readers.read_documents(spark, str(tmp_path / "src")).collect()}
    assert got["a.md"] == "# T\n" and got["html"] == "# H"
    assert got[".csv"].split("\n")[:3] == ["| p | q |", "|---|---|", "| 1 | x\\|y |"] and got[".csv"].endswith("(100 of 101 rows)")
    assert got["d.py"].startswith("```python\ndef f()") and got["d.py"].endswith("```\n\n- A docstring of words.")
    assert [(r.lang, r.n_lines) for r in readers.project(spark, str(tmp_path / "src"), newest=5).collect()] == [("python", 3)]
    skills = str(tmp_path / "skills")
    readers.write_skills(spark.createDataFrame([("a", "one"), ("b", "two")], "name string, text string"), skills)
    readers.write_skills(spark.createDataFrame([("b", "new")], "name string, text string"), skills)
    assert sorted((r.doc, r.value) for r in spark.read.text(skills).collect()) == [("a", "one"), ("b", "new")]
    (tmp_path / "cov" / "d1").mkdir(parents=True)
    (tmp_path / "cov" / "d2").mkdir()
    (tmp_path / "cov" / "d1" / "coverage.json").write_text('{"total_pages": 9, "processed_ranges": [[1, 3], [5, 6]]}')
    (tmp_path / "cov" / "d2" / "coverage.json").write_text("{bad")
    assert sorted((r.doc, r.total, r.lo, r.hi) for r in readers.read_coverage(spark, str(tmp_path / "cov")).collect()) == [("d1", 9, 1, 3), ("d1", 9, 5, 6)]


def test_more_text_functions(spark):
    from pyspark.sql import functions as F

    from corpuslab.functions import text as T

    df = spark.createDataFrame([("a\n  b\n    c", "x/y.TS"), ("\ta\n b", "x.zig"), ("none", "Makefile"), (None, None)], "t string, p string")
    assert [tuple(r) for r in df.select(T.indent(F.col("t")), T.language(F.col("p"))).collect()] == [("  ", "typescript"), ("\t", "zig"), ("", ""), ("", None)]
    one = spark.createDataFrame([("/* block of text */ x = 1 // a longer line comment\n# no",)], "t string")
    assert one.select(T.comments(F.col("t"))).first()[0] == ["block of text", "a longer line comment"]
    assert [tuple(one.select(T.edit(F.col("t"), a, b).alias("e")).first().e)[1] for a, b in (("x", "x"), ("zz", "y"), ("o", "0"), ("block", "B"))] == ["same", "missing", "several", None]


def test_lin_save_builds_its_files_once(spark, sf_dir):
    plan = QUERIES["lin_save"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_lin_files_written_whole_are_as_saved_by_relations(spark):
    odd = LDF.replace("{1, 2}", r"{$1, \2}").replace("lost, 12;", "lost, 12;\n    lamp, 1;").replace("};", "} ;").replace("two delay", "one delay 5 ms;\n    two delay")
    texts = {
        "plain": LDF, "odd": odd, "returns": LDF.replace("\n", "\r\n"), "old mac": LDF.replace("\n", "\r"), "twice": LDF + LDF,
        "no frames": re.sub(r"(?s)Frames.*?^}\n", "", LDF, flags=re.M), "no master": LDF.replace("Master", "Nobody"), "no entries": "Signals {\n}\n", "empty": "",
        "comments": "/* Nodes {\n} */ x Nodes {\n}\n" + LDF.replace("door, 2 {", "door, 2 { // two\n"), "blanks": LDF.replace("head, roof;", "\u00a0head ,, roof\u2003;"),
        "tables": LDF.replace("  normal {", "  b {\n  }\n  a {\n    two delay 1.5 ms;\n  }\n  normal {\n    two delay 7 ms;\n  }\n  normal {"),
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    doubled = relations.running_offset(lin.signals(files).withColumn("size", F.col("size") * 2), "path", ["seq"], "size").withColumn("offset", F.col("offset").cast("int"))
    saved = lin.save(files, Nodes=lin.render_nodes(lin.nodes(files)), Signals=lin.render_signals(doubled), Frames=lin.render_frames(lin.frames(files), doubled), Schedule_tables=lin.render_schedules(lin.schedules(files)))
    read = lin.read(files).withColumn("size", F.transform("size", lambda x: x * 2))
    got = dict(lin.write(read.withColumn("offset", lin.packed(F.col("size")))).collect())
    assert got == dict(saved.collect())
    assert "wind: 32, {1, 2}, door, head, roof;" in got["plain"] and "    lost, 36;" in got["plain"] and "// comment" not in got["plain"]
    assert got["empty"] == "" and r"{$1, \2}" in got["odd"] and "door, 2 {\n    lamp, 0;\n    wind, 4;" in got["odd"] and "wind: 32, {1, 2}, door, head, roof;" in got["blanks"]


def test_all_subscribers_of_a_signal_are_read(spark):
    names = [f"n{k}" for k in range(1200)]
    files = spark.createDataFrame([("a", "Signals {\n  s: 1, 0, p, " + ", ".join(names) + ";\n}\n")], "path string, text string")
    assert lin.signals(files).first().subscribers == names
