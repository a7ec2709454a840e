from pyspark.sql import functions as F

from corpuslab.streaming import progress


def test_stream_ends_in_the_same_states(spark, tmp_path):
    rows = []
    for job in range(6):
        for k in range(12):
            kind = "init" if (job + k) % 7 == 3 else "chunk" if k % 3 else None
            rows.append((job, kind, k * 10 + job, k, 10 + job, 50 * job, k * 9, f"t{k}"))
    schema = "job long, kind string, order long, ch_i long, ch_n long, tk_n long, tk_cum long, title string"
    events = spark.createDataFrame(rows, schema)
    for part in range(3):  # files in the order of the events
        events.where(F.floor(F.col("order") / 40) == part).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = {}

    def keep(df, _):
        states.update({r.job: tuple(r) for r in df.collect()})

    run = progress.stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = progress.fold(progress.events_of(events, F.col("job"), F.col("kind"), [F.col("order")], **{c: F.col(c) for c in ("ch_i", "ch_n", "tk_n", "tk_cum", "title")}))
    assert states == {r.job: tuple(r) for r in want.collect()}
