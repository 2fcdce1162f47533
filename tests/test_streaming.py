"""Streams give what the batch operators give."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.operators import alarms as A
from gaugeworks.sources import readers
from gaugeworks.streaming import alarms as S

HOUR = 3_600_000


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("gun_id"), F.col("ts").alias("time"), F.col("event_type").alias("code"), "value")


def _run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_triggers_equal_batch(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = _events(spark, sf_dir)
    src = str(tmp_path / "in")
    third = F.ntile(3).over(Window.orderBy("time"))
    parts = e.withColumn("part", third)
    for i in (1, 2, 3):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(src)
    # a row far ahead moves the watermark past all others
    last = spark.createDataFrame([("none", "view", 0.0)], "gun_id string, code string, value double").withColumn("time", F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
    last.select("gun_id", "time", "code", "value").coalesce(1).write.mode("append").parquet(src)
    rule = S.Rule(("error", "signup"), 12 * HOUR, 7 * 24 * HOUR)
    stream = readers.stream_of(spark, src, "gun_id string, time timestamp_ntz, code string, value double")
    _run(S.triggers(stream, rule, "1 hour"), tmp_path, "trig")
    got = {tuple(r) for r in spark.sql("select gun_id, code, at, repeat from trig").collect()}
    rows = e.select(F.col("gun_id").alias("gun"), F.unix_millis(F.col("time").cast("timestamp")).alias("t"), "code")
    want = A.triggers(rows, rule.codes, rule.wait, rule.repeat).select("gun", "code", "t", "repeat")
    assert got == {tuple(r) for r in want.collect()} and len(got) > 50


def test_complete_windows(spark, sf_dir, tmp_path):
    e = _events(spark, sf_dir)
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    stream = readers.stream_of(spark, src, "gun_id string, time timestamp_ntz, code string, value double").withColumn("time", F.col("time").cast("timestamp"))
    _run(S.complete_windows(stream, "6 hours", "1 hour", ["value"]), tmp_path, "win")
    got = spark.sql("select * from win")
    end = e.agg(F.max("time")).first()[0]
    batch = e.withColumn("time", F.col("time").cast("timestamp")).groupBy("gun_id", F.window("time", "6 hours")).agg(F.count("*").alias("n"))
    whole = batch.where(F.col("window.end").cast("timestamp_ntz") <= F.lit(end).cast("timestamp_ntz") - F.expr("interval 1 hour"))
    assert got.count() == whole.count()
    assert got.agg(F.sum("n")).first()[0] == whole.agg(F.sum("n")).first()[0]


def test_rule_steps():
    rule = S.Rule(("a", "b"), 10, 100)
    accepted, out, before = {}, [], None
    for at, code in [(0, "a"), (1, "a"), (2, "x"), (5, "a"), (12, "x"), (13, "a"), (14, "b")]:
        out.append(rule.step(before, code, at, accepted))
        before = code
    assert out == [(True, False), (False, False), (False, False), (False, False), (False, False), (True, True), (True, False)]


def test_gated_windows_equal_batch(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    step = 6 * HOUR
    e = _events(spark, sf_dir).withColumn("t", F.unix_millis(F.col("time").cast("timestamp")))
    w = e.groupBy("gun_id", ((F.floor(F.col("t") / step) + 1) * step).alias("at")).agg(F.avg("value").alias("score"), F.avg((F.col("code") == "view").cast("double")).alias("idle"))
    w = w.withColumn("w_end", F.timestamp_millis("at")).drop("at")
    src = str(tmp_path / "in")
    early = F.col("w_end") < F.expr("timestamp'2024-01-15'")
    w.where(early).coalesce(1).write.parquet(src)
    w.where(~early).coalesce(1).write.mode("append").parquet(src)
    spark.range(1).select(F.lit("none").alias("gun_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("idle"), F.expr("timestamp'2030-01-01'").alias("w_end")).coalesce(1).write.mode("append").parquet(src)
    gate = S.Gate(threshold=40, step=step, idle_least=3, hold=24 * HOUR, k=2)
    stream = readers.stream_of(spark, src, "gun_id string, score double, idle double, w_end timestamp")
    _run(S.gated_windows(stream, gate, "1 hour"), tmp_path, "gated")
    got = {tuple(r) for r in spark.sql("select gun_id, at, held, alarm, active, onset from gated").collect()}
    rows = w.select(F.col("gun_id").alias("gun"), F.unix_millis("w_end").alias("w_end"), "score", "idle").withColumn("rest", F.col("idle") > 0.5)
    rows = A.restart_hold(rows, "rest", 3, 24 * HOUR, step)
    alarm, _ = A.alarm_gate(F.col("idle"), F.lit(False), F.col("held"), F.col("score") >= 40)
    rows = A.early_warning(rows.withColumn("alarm", alarm), F.col("alarm"), 2, step)
    assert got == {tuple(r) for r in rows.select("gun", "w_end", "held", "alarm", "active", "onset").collect()} and len(got) > 100


def test_state_of_a_model(spark, sf_dir, tmp_path):
    """The same model goes on from its state, another begins anew."""
    assert S.state_folder("f", "m1", ("E012",)) != S.state_folder("f", "m2", ("E012",)) and S.state_folder("f", "m1", 3) == S.state_folder("f", "m1", 3)
    src = str(tmp_path / "in")
    _events(spark, sf_dir).coalesce(1).write.parquet(src)
    given = []
    for model in ("m1", "m1", "m2"):
        stream = readers.stream_of(spark, src, "gun_id string, time timestamp_ntz, code string, value double").withColumn("time", F.col("time").cast("timestamp"))
        q = S.session_windows(stream, "6 hours", "1 hour", "value").writeStream.format("noop").option("checkpointLocation", S.state_folder(str(tmp_path / "state"), model)).trigger(availableNow=True).start()
        q.awaitTermination()
        given.append(sum(p["numInputRows"] for p in q.recentProgress))
    assert given[0] == given[2] > 0 and given[1] == 0
