"""Cases and outbox appear together or not at all, whatever is run twice or stops between."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import case_sink as S

KIND = "event_id long, case_id long, gun long, code string, t long, status string"


def split(batch):
    cases = batch.groupBy("case_id", "gun").agg(F.max(F.struct("t", "code")).alias("m")).select("case_id", "gun", F.col("m.code").alias("code"), F.col("m.t").alias("updated_at"))
    return {"cases": cases, "outbox": batch.select("event_id", "case_id", "status", F.col("t").alias("created_at"))}


BATCHES = [
    [(1, 10, 1, "a", 100, "pending"), (2, 10, 1, "b", 200, "sent")],
    [(2, 10, 1, "c", 150, "pending"), (3, 11, 1, "d", 400, "sent")],  # event 2 is known, case 10 is replaced
    [],
    [(4, 12, 2, "e", 500, "pending")],
]
CASES = {(10, "c"), (11, "d"), (12, "e")}
OUTBOX = {(1, "pending", 100), (2, "sent", 200), (3, "sent", 400), (4, "pending", 500)}


def held(sink):
    return {(r["case_id"], r["code"]) for r in sink.read("cases").collect()}, {(r["event_id"], r["status"], r["created_at"]) for r in sink.read("outbox").collect()}


def frames(spark):
    return [spark.createDataFrame(b, KIND) for b in BATCHES]


def test_batches_run_twice(spark, tmp_path):
    sink = S.BatchSink(spark, str(tmp_path), S.CASES)
    assert held(sink) == (set(), set())
    for i, b in enumerate(frames(spark)):
        sink.write(b, i, split)
        sink.write(b.where("false"), i, split)  # what a batch that is committed gives again does not matter
    assert held(sink) == (CASES, OUTBOX)


@pytest.mark.parametrize("table", ["cases", "outbox", "commit"])
def test_a_batch_that_stops_between_its_tables(spark, tmp_path, monkeypatch, table):
    sink = S.BatchSink(spark, str(tmp_path), S.CASES)
    batches = frames(spark)
    sink.write(batches[0], 0, split)
    before = held(sink)

    def broken(batch):
        made = split(batch)
        if table in made:
            made[table] = made[table].withColumn("case_id", F.raise_error(F.lit("stopped")).cast("long"))
        return made

    if table == "commit":
        monkeypatch.setattr(sink, "_commit", lambda name: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        sink.write(batches[1], 1, broken)
    monkeypatch.undo()
    assert held(sink) == before
    for i, b in enumerate(batches):
        sink.write(b, i, split)
    assert held(sink) == (CASES, OUTBOX)


def test_retention_and_compaction(spark, tmp_path, monkeypatch):
    sink = S.BatchSink(spark, str(tmp_path), S.CASES)
    for i, b in enumerate(frames(spark)[:3]):
        sink.write(b, i, split)
    gone = {"outbox": S.past_retention(now=500, span=200)}
    monkeypatch.setattr(sink, "_commit", lambda name: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        sink.compacted(gone)
    monkeypatch.undo()
    assert len(held(sink)[1]) == 3
    sink.compacted(gone)
    assert sink.committed() == (2, [])
    assert held(sink) == ({(10, "c"), (11, "d")}, {(1, "pending", 100), (3, "sent", 400)})
    for i, b in enumerate(frames(spark)):
        sink.write(b, i, split)
    assert sink.committed() == (2, [3])
    assert held(sink) == (CASES, OUTBOX - {(2, "sent", 200)})


def test_stream(spark, tmp_path):
    for i, b in enumerate(BATCHES):
        if b:
            spark.createDataFrame(b, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = S.BatchSink(spark, f"{tmp_path}/out", S.CASES)
    q = sink.sink(stream, split, f"{tmp_path}/state", availableNow=True)
    q.awaitTermination()
    assert held(sink) == (CASES, OUTBOX)
