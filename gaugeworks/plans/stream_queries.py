"""Queries on streams with state of their own: they run in two parts, stopped and started again between them.

Input is the table ``events`` at a row for each gun and millisecond, written as files in two parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.staging import scratch
from gaugeworks.plans.registry import query, readings, rounded
from gaugeworks.sources import case_sink, readers
from gaugeworks.streaming import alarms as S
from gaugeworks.streaming import ordered as O

HOUR = 3_600_000
DAY = 24 * HOUR
CODES = ("error", "signup")

_EM = "em AS (SELECT CAST(gun AS VARCHAR) AS gun_id, t // 1000 AS ms, max(code) AS code, max(value) AS value FROM ev GROUP BY 1, 2)"
_PASSED = f"(SELECT max(ms) - {HOUR} FROM em)"
#: What the first part's watermark has passed.
_CUT = f"(SELECT max(ms) - {HOUR} FROM em WHERE ms < (SELECT (min(ms) + max(ms)) // 2 FROM em))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).groupBy(F.col("gun").cast("string").alias("gun_id"), F.expr("t div 1000").alias("at"))
    return rows.agg(F.max("code").alias("code"), F.max("value").alias("value"))


def _parts(rows: DataFrame, by: str = "at") -> list[DataFrame]:
    """Rows before and from the middle of ``by``'s range."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        return [rows]
    middle = (low + high) // 2
    return [rows.where(F.col(by) < middle), rows.where(F.col(by) >= middle)]


class _Replay:
    """Parts of a table given to a stream one after the other; its state and results in the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        self.inputs, self.out, self.checkpoint = (scratch(spark, f"{name}-{x}") for x in ("in", "out", "state"))
        self.schema = None

    def give(self, part: DataFrame, build: Callable[[DataFrame], DataFrame]) -> None:
        """Appends a part to the input and lets the stream run until it has read it."""
        part.write.mode("append").parquet(self.inputs)
        made = build(readers.stream_of(self.spark, self.inputs, part.schema, files=100_000))
        self.schema = made.schema
        with O.rocksdb(self.spark):
            q = made.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            q.awaitTermination()

    def results(self) -> DataFrame:
        """What the stream gave; ``at`` is called ms, since SQL has a word of that name."""
        return rounded(self.spark.read.schema(self.schema).parquet(self.out)).withColumnRenamed("at", "ms")


def _timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("time", F.timestamp_millis("at"))


_FOLD = f"""WITH RECURSIVE {_EM}, o AS (SELECT gun_id, ms, code FROM (SELECT *, lag(code) OVER (PARTITION BY gun_id ORDER BY ms) AS before FROM em) WHERE code IN ('error', 'signup') AND (before IS NULL OR before <> code)),
n AS (SELECT *, row_number() OVER (PARTITION BY gun_id, code ORDER BY ms) AS rn FROM o),
f AS (SELECT gun_id, code, ms, rn, ms AS last, true AS kept FROM n WHERE rn = 1
 UNION ALL SELECT n.gun_id, n.code, n.ms, n.rn, CASE WHEN n.ms - f.last >= {{wait}} THEN n.ms ELSE f.last END, n.ms - f.last >= {{wait}} FROM f JOIN n ON n.gun_id = f.gun_id AND n.code = f.code AND n.rn = f.rn + 1)
SELECT * FROM (SELECT gun_id, code, ms, coalesce(ms - lag(ms) OVER (PARTITION BY gun_id, code ORDER BY ms) < {7 * DAY}, false) AS repeat FROM f WHERE kept) WHERE ms <= {_PASSED}"""


@query(_FOLD.format(wait=12 * HOUR))
def stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10-R13 with state that a restart finds again."""
    replay, rule = _Replay(spark, "triggers"), S.Rule(CODES, 12 * HOUR, 7 * DAY)
    for part in _parts(_events(spark, sf_dir)):
        replay.give(part, lambda s: S.triggers(_timed(s), rule, "1 hour"))
    return replay.results()


@query(_FOLD.format(wait=f"CASE WHEN n.ms <= {_CUT} THEN {12 * HOUR} ELSE {60 * HOUR} END"))
def stream_model_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped, its state read, and started under another rule that keeps codes, cooldowns and waiting rows."""
    first, *rest = _parts(_events(spark, sf_dir))
    old, new = S.Rule(CODES, 12 * HOUR, 7 * DAY), S.Rule(CODES, 60 * HOUR, 7 * DAY)
    before, after = _Replay(spark, "old-rule"), _Replay(spark, "new-rule")
    before.give(first, lambda s: S.triggers(_timed(s), old, "1 hour"))
    state = O.begin(O.snapshot(spark, before.checkpoint, S.TriggerProcessor(old)), S.TriggerProcessor(new), same_model=False)
    for part in rest:
        after.give(part, lambda s: S.triggers(_timed(s), new, "1 hour", initial=state))
    return before.results().unionByName(after.results()) if rest else before.results()


_W = 6 * HOUR
_GATE = f"""WITH {_EM}, w AS (SELECT gun_id, (ms // {_W} + 1) * {_W} AS ms, avg(value) AS score, avg(CASE WHEN code = 'view' THEN 1.0 ELSE 0.0 END) AS idle_share FROM em GROUP BY 1, 2),
a AS (SELECT *, idle_share > 0.5 AS idle, max(CASE WHEN idle_share <= 0.5 THEN ms END) OVER (PARTITION BY gun_id ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la, min(ms) OVER (PARTITION BY gun_id) AS f, {{era}} AS era FROM w),
b AS (SELECT *, CASE WHEN NOT idle AND coalesce((ms - la) / {_W} - 1, (ms - f) / {_W}) >= 3 THEN ms END AS begins FROM a),
h AS (SELECT *, coalesce(ms - max(begins) OVER (PARTITION BY gun_id ORDER BY ms ROWS UNBOUNDED PRECEDING) < {DAY}, false) AS held FROM b),
z AS (SELECT *, score >= CASE WHEN era = 0 THEN 40 ELSE 30 END AND NOT idle AND NOT held AS alarm FROM h),
r AS (SELECT *, sum(CASE WHEN alarm AND coalesce(la2, false) AND d = {_W} AND e = era THEN 0 ELSE 1 END) OVER (PARTITION BY gun_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS run FROM
 (SELECT *, lag(alarm) OVER g AS la2, ms - lag(ms) OVER g AS d, lag(era) OVER g AS e FROM z WINDOW g AS (PARTITION BY gun_id ORDER BY ms))),
p AS (SELECT *, CASE WHEN alarm THEN row_number() OVER (PARTITION BY gun_id, run ORDER BY ms) ELSE 0 END AS place FROM r)
SELECT gun_id, ms, round(score, 6) AS score, held, alarm, place >= 2 AS active, place = 2 AS onset FROM p WHERE ms <= (SELECT max(ms) - {HOUR} FROM w)"""
_W_CUT = f"(SELECT max(ms) - {HOUR} FROM w WHERE ms < (SELECT (min(ms) + max(ms)) // 2 FROM w))"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _events(spark, sf_dir).groupBy("gun_id", F.expr(f"(at div {_W} + 1) * {_W}").alias("at"))
    return w.agg(F.avg("value").alias("score"), F.avg((F.col("code") == "view").cast("double")).alias("idle"))


def _gated(stream: DataFrame, gate: S.Gate, initial: DataFrame | None = None) -> DataFrame:
    return S.gated_windows(_timed(stream).withColumnRenamed("time", "w_end"), gate, "1 hour", initial)


@query(_GATE.format(era="0"))
def stream_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7, R9, R15 with state that a restart finds again."""
    replay, gate = _Replay(spark, "gates"), S.Gate(40, _W, 3, DAY, 2)
    for part in _parts(_windows(spark, sf_dir)):
        replay.give(part, lambda s: _gated(s, gate))
    return replay.results()


@query(_GATE.format(era=f"CASE WHEN ms <= {_W_CUT} THEN 0 ELSE 1 END"))
def stream_gates_model_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new threshold keeps the restart's hold and begins runs of alarms anew."""
    first, *rest = _parts(_windows(spark, sf_dir))
    old, new = S.Gate(40, _W, 3, DAY, 2), S.Gate(30, _W, 3, DAY, 2)
    before, after = _Replay(spark, "old-gate"), _Replay(spark, "new-gate")
    before.give(first, lambda s: _gated(s, old))
    state = O.begin(O.snapshot(spark, before.checkpoint, S.GateProcessor(old)), S.GateProcessor(new), same_model=False)
    for part in rest:
        after.give(part, lambda s: _gated(s, new, state))
    return before.results().unionByName(after.results()) if rest else before.results()


_SPAN, _ROWS = 10 * DAY, 12


@query(f"""WITH {_EM}, i AS (SELECT *, code <> 'error' AS normal, min(ms) OVER (PARTITION BY gun_id) + {_SPAN} AS cap, count(*) FILTER (WHERE code <> 'error') OVER (PARTITION BY gun_id ORDER BY ms) AS n FROM em),
e AS (SELECT gun_id, any_value(cap) AS cap, min(CASE WHEN normal AND n = {_ROWS} THEN ms END) AS reach FROM i GROUP BY 1),
s AS (SELECT i.gun_id, quantile_cont(value, 0.9) AS q, avg(value) AS m, stddev_pop(value) AS d FROM i JOIN e USING (gun_id) WHERE normal AND ms <= reach GROUP BY 1)
SELECT gun_id, ms, round(value, 6) AS score, round(CASE WHEN reach < e.cap AND ms >= reach THEN greatest(60.0, q) ELSE 60.0 END, 6) AS threshold,
 round(CASE WHEN reach < e.cap AND ms >= reach THEN (value - m) / greatest(d, 1e-6) ELSE value END, 6) AS z,
 CASE WHEN reach < e.cap AND ms >= reach THEN 'gun' WHEN NOT coalesce(reach < e.cap, false) AND ms >= e.cap THEN 'global' ELSE 'warming_up' END AS source
FROM i JOIN e USING (gun_id) LEFT JOIN s USING (gun_id) WHERE ms <= {_PASSED}""")
def stream_warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds frozen at the twelfth normal row or after ten days."""
    replay, rule = _Replay(spark, "warm-up"), O.WarmUp(_SPAN, _ROWS, 60.0, 0.9)
    for part in _parts(_events(spark, sf_dir)):
        replay.give(part, lambda s: O.warm_up(_timed(s).select("gun_id", "time", F.col("value").alias("score"), (F.col("code") != "error").alias("normal")), rule, "1 hour"))
    return replay.results()


@query(f"WITH {_EM} SELECT gun_id, ms, round(value, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY gun_id ORDER BY ms DESC) AS n FROM em WHERE ms <= {_PASSED}) WHERE n <= 10")
def stream_trace_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten rows of each gun, read from the stream's state."""
    replay = _Replay(spark, "ring")
    for part in _parts(_events(spark, sf_dir)):
        replay.give(part, lambda s: O.traced(_timed(s).select("gun_id", "time", F.col("value").alias("score")), 10, "1 hour"))
    return rounded(O.last_traces(spark, replay.checkpoint, 10)).withColumnRenamed("at", "ms")


_LIMIT = 3 * DAY
#: Chunks are a gun's days; some arrive two or seven days late, some together with a later one.
_CHUNK = "CASE WHEN day % 5 = 0 THEN 10 * (day + 7) + 1 WHEN day % 5 = 3 THEN 10 * (day + 2) + 1 WHEN day % 7 = 6 THEN 10 * (day + 5) ELSE 10 * day END"


@query(f"""WITH {_EM}, k AS (SELECT *, {_CHUNK} AS chunk FROM (SELECT *, ms // {DAY} AS day FROM em)), c AS (SELECT gun_id, chunk, min(ms) AS f, max(ms) AS l FROM k GROUP BY 1, 2),
n AS (SELECT *, max(CASE WHEN l - f <= {_LIMIT} THEN l END) OVER (PARTITION BY gun_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM c),
j AS (SELECT *, CASE WHEN l - f > {_LIMIT} THEN 'span' WHEN l < newest - {_LIMIT} THEN 'clock went back' END AS reason FROM n),
r AS (SELECT k.gun_id, k.chunk, ms, value, code, coalesce(ms < newest - {_LIMIT}, false) AS late FROM k JOIN j USING (gun_id, chunk) WHERE reason IS NULL),
o AS (SELECT gun_id, ms, last_value(CASE WHEN code <> 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY gun_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS value, max(ms) OVER (PARTITION BY gun_id) AS top FROM r WHERE NOT late)
SELECT gun_id, 'refused' AS tag, chunk, NULL::BIGINT AS ms, NULL::DOUBLE AS value, reason FROM j WHERE reason IS NOT NULL
UNION ALL SELECT gun_id, 'late', chunk, ms, round(value, 6), NULL FROM r WHERE late UNION ALL SELECT gun_id, 'row', NULL, ms, round(value, 6), NULL FROM o WHERE ms < top - {_LIMIT}""")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks refused whole, rows that leave the buffer with the carried value, rows too late for it."""
    replay = _Replay(spark, "chunks")
    rows = _events(spark, sf_dir).withColumn("day", F.expr(f"at div {DAY}")).withColumn("chunk", F.expr(_CHUNK)).drop("day")
    for part in _parts(rows, "chunk"):
        replay.give(part, lambda s: O.chunked(s.withColumn("rest", F.col("code") == "view"), _LIMIT))
    return replay.results()


@query(f"""WITH c AS (SELECT gun * 1000 + t // {DAY * 1000} % 1000 AS id, arg_max(code, (t, event_id)) AS value FROM ev GROUP BY 1),
o AS (SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'sent' ELSE 'pending' END AS value, t FROM ev WHERE code = 'error')
SELECT 'case' AS kind, id, value FROM c UNION ALL SELECT 'delivery', id, value FROM o WHERE value = 'pending' OR t >= (SELECT max(t) FROM ev) - {10 * DAY * 1000}""")
def stream_case_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and outbox of a stream, written together, each batch given twice; deliveries kept for ten days."""
    rows = readings(spark, sf_dir)
    inputs, checkpoint = scratch(spark, "cases-in"), scratch(spark, "cases-state")
    sink = case_sink.BatchSink(spark, scratch(spark, "cases"), case_sink.CASES)

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        case = F.expr(f"gun * 1000 + t div {DAY * 1000} % 1000")
        last = batch.groupBy(case.alias("case_id"), "gun").agg(F.max(F.struct("t", "event_id", "code")).alias("_last"))
        outbox = batch.where("code = 'error'").select("event_id", case.alias("case_id"), F.when(F.expr("k % 2 = 0"), "sent").otherwise("pending").alias("status"), F.col("t").alias("created_at"))
        return {"cases": last.select("case_id", "gun", F.col("_last.code").alias("code"), F.col("_last.t").alias("updated_at")), "outbox": outbox}

    def twice(batch: DataFrame, i: int) -> None:
        sink.write(batch, i, split)
        sink.write(batch, i, split)

    for part in _parts(rows, "t"):
        part.write.mode("append").parquet(inputs)
        stream = readers.stream_of(spark, inputs, part.schema, files=100_000)
        q = stream.writeStream.foreachBatch(twice).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    now = rows.agg(F.max("t")).first()[0]
    if now is not None:
        sink.compacted({"outbox": case_sink.past_retention(now, 10 * DAY * 1000)})
    cases = sink.read("cases").select(F.lit("case").alias("kind"), F.col("case_id").alias("id"), F.col("code").alias("value"))
    return cases.unionByName(sink.read("outbox").select(F.lit("delivery").alias("kind"), F.col("event_id").alias("id"), F.col("status").alias("value")))
