"""Lines of pieces that were cut anywhere: as a table, as a stream, and after a restart."""

import json
import random

import pytest

from corpuslab.streaming import reframe

TEXTS = {
    1: 'data: {"event": "message", "answer": "héllo 東京 😀"}\r\n\ndata: bad\n: comment\ndata: {"event": "message_end"}\ndata: {"event": "message", "answer": "late"}\n',
    2: 'data: {"event": "message", "answer": ""}\ndata: [DONE] \ndata: {"event": "message", "answer": "x"}',
    3: "no line feed",
    4: "",
    5: "\n\n\n",
    6: 'data: {"event": "ping"}\ndata: {"event": "message"}\n',
}


def cut(rng, most):
    rows = []
    for stream, text in TEXTS.items():
        raw, pieces = text.encode(), []
        while raw:
            n = rng.randint(0, most)
            pieces.append(raw[:n])
            raw = raw[n:]
        pieces = pieces or [b""]
        rows += [(stream, k, bytearray(p), k == len(pieces) - 1) for k, p in enumerate(pieces)]
    rng.shuffle(rows)
    return rows


def wanted():
    return sorted((s, n, line.removesuffix("\r")) for s, t in TEXTS.items() for n, line in enumerate(t.removesuffix("\n").split("\n") if t else []))


SCHEMA = "stream long, seq long, data binary, last boolean"


@pytest.mark.parametrize("most", [1, 5, 400])
def test_table_of_lines(spark, most):
    rows = cut(random.Random(most), most)
    df = spark.createDataFrame(rows + rows[:9], SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in reframe.lines(df).collect()) == wanted()


def test_stream_equals_table_also_after_a_restart(spark, tmp_path):
    rows = cut(random.Random(7), 9)
    source, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[max(0, k - 3) : k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if (k // 40) % 3 == 2 or k + 40 >= len(rows):  # several files, then a start from the checkpoint
            stream = reframe.line_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == wanted()


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, 0, bytearray(b"a\xff\xe6"), False), (1, 1, bytearray(b"b\nc\xe6"), False), (1, 2, None, True)], SCHEMA)
    assert [r.line for r in reframe.lines(df).orderBy("n").collect()] == ["a��b", "c�"]
    assert reframe.lines(df.where("seq = 0")).count() == 0 and reframe.lines(df.where("false")).count() == 0


def test_chunks(spark):
    found = reframe.until_done(reframe.transcode(reframe.lines(spark.createDataFrame(cut(random.Random(1), 4), SCHEMA))))
    got = {}
    for r in found.orderBy("stream", "n", "part").collect():
        body = r.out.removeprefix("data: ")
        choice = json.loads(body)["choices"][0] if body != "[DONE]" else None
        got.setdefault(r.stream, []).append((choice["delta"].get("content"), choice["finish_reason"]) if choice else "[DONE]")
    assert got == {1: [("héllo 東京 😀", None), (None, "stop"), "[DONE]"], 2: [("", None), "[DONE]"], 6: [("", None)]}
