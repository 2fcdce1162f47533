"""Streams with state that is read back and carried on: models change, warm-up, trace rings, chunks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import alarms as A
from gaugeworks.operators import prep as P
from gaugeworks.sources import readers
from gaugeworks.streaming import alarms as S
from gaugeworks.streaming import ordered as O

HOUR = 3_600_000
DAY = 24 * HOUR
KIND = "gun_id string, at long, code string, value double"


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("user_id").cast("string").alias("gun_id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) div 1000").alias("at"), F.col("event_type").alias("code"), "value")
    return sorted((r for r in rows.dropDuplicates(["gun_id", "at"]).collect()), key=lambda r: (r["at"], r["gun_id"]))


def stream(spark, rows, path):
    """Rows as files of a folder, one for each list."""
    for part in rows:
        spark.createDataFrame([tuple(r) for r in part], KIND).coalesce(1).write.mode("append").parquet(path)
    return readers.stream_of(spark, path, KIND).withColumn("time", F.timestamp_millis("at"))


def done(df, path, name):
    with O.rocksdb(df.sparkSession):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    return df.sparkSession.table(name).collect(), f"{path}/{name}"


def halves(events):
    cut = len(events) // 2
    end = ("none", 1_900_000_000_000, "view", 0.0)
    return [events[:cut]], [events[cut:], [end]], events[cut - 1]["at"] - HOUR


def test_triggers_go_on_under_another_rule(spark, events, tmp_path):
    """The second rule begins with the first one's codes and cooldowns, and judges what still waited."""
    first, second, cut = halves(events)
    old, new = S.Rule(("error", "signup"), 12 * HOUR, 7 * DAY), S.Rule(("error", "signup"), 60 * HOUR, 7 * DAY)
    a, checkpoint = done(S.triggers(stream(spark, first, f"{tmp_path}/a"), old, "1 hour"), tmp_path, "trig_old")
    state = O.snapshot(spark, checkpoint, S.TriggerProcessor(old))
    assert {r["part"] for r in state.select("part").distinct().collect()} == {"taken", "waiting", "before", "accepted"}
    b, _ = done(S.triggers(stream(spark, second, f"{tmp_path}/b"), new, "1 hour", initial=O.begin(state, S.TriggerProcessor(new), False)), tmp_path, "trig_new")
    want, before, accepted = [], {}, {}
    for r in events:
        g = r["gun_id"]
        fires, repeat = (old if r["at"] <= cut else new).step(before.get(g), r["code"], r["at"], accepted.setdefault(g, {}))
        before[g] = r["code"]
        if fires:
            want.append((g, r["code"], r["at"], repeat))
    assert sorted(map(tuple, a + b)) == sorted(want) and a and b


def test_gates_drop_their_runs_under_another_model(spark, events, tmp_path):
    step = 6 * HOUR
    windows = {}
    for r in events:
        windows.setdefault((r["gun_id"], (r["at"] // step + 1) * step), []).append(r)
    rows = sorted(((g, at, "", sum(r["value"] for r in w) / len(w)) for (g, at), w in windows.items()), key=lambda r: (r[1], r[0]))
    cut = len(rows) // 2
    end = [("none", 1_900_000_000_000, "", 0.0)]
    gates = S.Gate(40.0, step, 3, DAY, 2), S.Gate(30.0, step, 3, DAY, 2)

    def shaped(df):
        return df.select("gun_id", F.col("time").alias("w_end"), F.col("value").alias("score"), F.lit(0.0).alias("idle"))

    def run(parts, gate, name, initial=None):
        return done(S.gated_windows(shaped(stream(spark, parts, f"{tmp_path}/{name}-in")), gate, "1 hour", initial), tmp_path, name)

    a, checkpoint = run([rows[:cut]], gates[0], "gate_old")
    state = O.snapshot(spark, checkpoint, S.GateProcessor(gates[0])).cache()
    for same in (True, False):
        gate = gates[0] if same else gates[1]
        b, _ = run([rows[cut:], end], gate, f"gate_{same}", O.begin(state, S.GateProcessor(gate), same))
        judged, want = {}, []
        for g, at, _, score in rows:
            later = at > rows[cut - 1][1] - HOUR
            held = judged.setdefault(g, {})
            if later and not same and not held.get("_new"):
                held.pop("run", None), held.pop("last", None)
                held["_new"] = True
            r = (gate if later else gates[0]).next(held, at, score, 0.0)
            want.append((g, at, score, r["held"], r["alarm"], r["active"], r["onset"]))
        assert sorted(map(tuple, a + b)) == sorted(want)


@pytest.mark.parametrize(("span", "rows"), [(10 * DAY, 5), (3 * DAY, 8), (60 * DAY, 400)])
def test_warm_up(spark, events, tmp_path, span, rows):
    """Thresholds freeze at the N-th normal row or at the cap, whichever file a row came in."""
    rule = O.WarmUp(span, rows, 60.0, 0.9)
    cut = len(events) // 3
    parts = [events[:cut], events[cut : 2 * cut], [*events[2 * cut :], ("none", 1_900_000_000_000, "view", 0.0)]]
    df = stream(spark, parts, f"{tmp_path}/in").select("gun_id", "time", F.col("value").alias("score"), (F.col("code") != "error").alias("normal"))
    got, checkpoint = done(O.warm_up(df, rule, "1 hour"), tmp_path, f"warm_{rows}")
    guns, want = {}, {}
    for r in events:
        guns.setdefault(r["gun_id"], []).append(r)
    for g, own in guns.items():
        normal = [r["at"] for r in own if r["code"] != "error"]
        cap = own[0]["at"] + span
        reach = normal[rows - 1] if len(normal) >= rows else cap
        ends, enough = min(reach, cap), reach < cap
        scores = pd.Series([r["value"] for r in own if r["code"] != "error" and r["at"] <= ends][:rows])
        for r in own:
            is_own = enough and r["at"] >= ends
            z = (r["value"] - scores.mean()) / max(scores.std(ddof=0), 1e-6) if is_own else r["value"]
            want[g, r["at"]] = (max(60.0, scores.quantile(0.9)) if is_own else 60.0, z, is_own)
    assert len(got) == len(want)
    for r in got:
        threshold, z, is_own = want[r["gun_id"], r["at"]]
        assert abs(r["threshold"] - threshold) < 1e-9 and abs(r["z"] - z) < 1e-6 and (r["source"] == "gun") == is_own
    state = O.snapshot(spark, checkpoint, O.WarmUpProcessor(rule))
    kept = O.begin(state, O.WarmUpProcessor(rule), False)
    assert {r["part"] for r in kept.select("part").distinct().collect()} <= {"taken", "waiting"}
    frozen = {r["gun_id"] for r in state.where("part = 'frozen' and name = 'gun'").collect()}
    assert state.where("part = 'scores'").where(F.col("gun_id").isin(*frozen)).isEmpty()


def test_trace_ring(spark, events, tmp_path):
    cut = len(events) // 2
    parts = [events[:cut], [*events[cut:], ("none", 1_900_000_000_000, "view", 0.0)]]
    df = stream(spark, parts, f"{tmp_path}/in").select("gun_id", "time", F.col("value").alias("score"))
    got, checkpoint = done(O.traced(df, 7, "1 hour"), tmp_path, "ring")
    assert len(got) == len(events)
    rows = spark.createDataFrame([tuple(r) for r in events], KIND)
    want = A.last_windows(rows, 7, "gun_id", "at").select("gun_id", "at", "value")
    assert sorted(map(tuple, O.last_traces(spark, checkpoint, 7).collect())) == sorted(map(tuple, want.collect()))


CHUNKS = [
    # (gun, chunk, at, value, rest)
    ("g", 1, 100, 1.0, 0), ("g", 1, 105, 2.0, 0),
    ("g", 2, 106, 9.0, 1), ("g", 2, 130, 9.0, 0),  # spans too much
    ("g", 3, 112, 5.0, 1), ("g", 3, 114, 3.0, 0),
    ("g", 4, 90, 7.0, 0),  # too old
    ("g", 5, 102, 8.0, 0), ("g", 5, 110, 6.0, 1),  # accepted, one row too old for the buffer
    ("g", 6, 140, 4.0, 1),
    ("h", 1, 500, 1.0, 1), ("h", 7, 520, 1.0, 0),
]


@pytest.mark.parametrize("files", [1, 3, 7])
def test_chunks(spark, tmp_path, files):
    """The same rows and refusals whatever the batches; a row at rest takes the last working row before it."""
    kind = "gun_id string, chunk long, at long, value double, rest int"
    numbers = sorted({c[1] for c in CHUNKS})
    for i in range(files):
        own = numbers[i * len(numbers) // files : (i + 1) * len(numbers) // files]
        spark.createDataFrame([c for c in CHUNKS if c[1] in own], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, _ = done(O.chunked(readers.stream_of(spark, f"{tmp_path}/in", kind), 10), tmp_path, f"chunks{files}")
    refused = {(r["gun_id"], r["chunk"], r["reason"]) for r in got if r["tag"] == "refused"}
    batch = P.refused_chunks(spark.createDataFrame(CHUNKS, kind), 10, key="gun_id", time="at")
    assert refused == {tuple(r) for r in batch.collect()} == {("g", 2, "span"), ("g", 4, "clock went back")}
    rows = {(r["gun_id"], r["at"]): r["value"] for r in got if r["tag"] == "row"}
    assert rows == {("g", 100): 1.0, ("g", 105): 2.0, ("g", 110): 2.0, ("g", 112): 2.0, ("g", 114): 3.0, ("h", 500): None}
    assert [(r["at"], r["value"]) for r in got if r["tag"] == "late"] == [(102, 8.0)]
