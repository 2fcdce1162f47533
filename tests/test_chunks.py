"""Work of a key split by spans of time gives what the whole key gives."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import alarms as A
from gaugeworks.operators import features as W
from gaugeworks.operators import intervals as I
from gaugeworks.operators import prep as P


@pytest.fixture
def rows(spark):
    """One key with two thirds of the rows, long stretches of one state, blanks over whole chunks, a null key."""
    made = [("hot" if i % 3 else "cold", i * 7 + (500 if i > 150 else 0), "ab"[(i // 9) % 2] if i % 13 else None, float(i) if i % 5 == 0 and not 60 < i < 120 else None) for i in range(300)]
    made += [(None, 5, "a", None), (None, 900, "a", 1.0), (None, 2000, "b", None)]
    return spark.createDataFrame(made, "gun string, t long, state string, v double")


def same(a, b):
    x, y = (sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in (a, b))
    assert x == y and x


@pytest.mark.parametrize("chunk", [1, 50, 333, 10_000])
def test_equal(rows, chunk):
    same(I.with_segments(rows, 20, chunk=chunk), I.with_segments(rows, 20))
    for limit in (None, 20):
        same(I.runs(rows, "state", limit=limit, chunk=chunk), I.runs(rows, "state", limit=limit))
    left, right = rows.select("gun", "t", "v").where("t % 2 = 0"), rows.where("t % 3 = 0").select("gun", "t", F.col("state").alias("was"))
    same(I.asof_before(left, right, ["was"], chunk=chunk), I.asof_before(left, right, ["was"]))
    same(P.carry(rows, F.col("state") == "b", ["v"], chunk=chunk), P.carry(rows, F.col("state") == "b", ["v"]))


def test_empty(rows):
    none = rows.where("false")
    assert I.runs(none, "state", chunk=5).count() == I.with_segments(none, 5, chunk=5).count() == P.carry(none, F.lit(False), ["v"], chunk=5).count() == 0


@pytest.mark.parametrize("chunk", [50, 333, 10_000])
def test_alarms_equal(rows, chunk):
    for per_code in (True, False):
        for wait in (1, 40, 400):
            given = ["a", "b"], wait, 300, "gun", "t", "state", per_code
            same(A.triggers(rows, *given, chunk=chunk), A.triggers(rows, *given))
    windows = rows.withColumn("idle", F.expr("state <=> 'b'")).withColumn("alarm", F.expr("t % 3 <> 0"))
    same(A.restart_hold(windows, "idle", 3, 60, 7, slot="t", chunk=chunk), A.restart_hold(windows, "idle", 3, 60, 7, slot="t"))
    same(A.alarm_runs(windows, "alarm", 21, 20, chunk=chunk), A.alarm_runs(windows, "alarm", 21, 20))
    met = F.expr("t % 5 <> 0")
    same(A.early_warning(rows, met, 2, 7, slot="t", chunk=chunk), A.early_warning(rows, met, 2, 7, slot="t"))


@pytest.mark.parametrize("chunk", [13, 50, 333, 10_000])
def test_frames_equal(rows, chunk):
    timed = rows.withColumn("v", F.coalesce("v", F.lit(2.0)))
    same(W.rolling(timed, 60, "v", chunk=chunk), W.rolling(timed, 60, "v"))
    same(W.fused(timed, "v", 60, chunk=chunk), W.fused(timed, "v", 60))
    a, b = (df.withColumns({c: F.round(c, 9) for c in ("v_m0", "v_m1", "v_m2", "v_drift", "v_spread")}) for df in (W.lookback(timed, "v", [10, 60, 300], chunk=chunk), W.lookback(timed, "v", [10, 60, 300])))
    same(a, b)


@pytest.mark.parametrize("chunk", [50, 333])
def test_lookups_equal(rows, chunk):
    same(I.gap_list(rows, 7, ["state", "v"], chunk=chunk), I.gap_list(rows, 7, ["state", "v"]))
    same(I.merge_near(rows, 13, chunk=chunk), I.merge_near(rows, 13))
    same(I.since_and_until(rows, F.col("v").isNotNull(), chunk=chunk), I.since_and_until(rows, F.col("v").isNotNull()))
    same(I.nearest(rows, F.col("v").isNotNull(), 40, chunk=chunk), I.nearest(rows, F.col("v").isNotNull(), 40))


def test_no_key_is_gathered(rows):
    """The split rule has no list of a key's times in its plan, and its accepted rows are those of a fold in Python."""
    times = [("k", t) for t in (0, 3, 5, 9, 10, 14, 15, 16, 29, 30, 31, 47)]
    df = rows.sparkSession.createDataFrame(times, "gun string, t long")
    got = A.cooldown(df, 5, chunk=4)
    assert "collect_" not in got._jdf.queryExecution().toString()
    assert sorted(r["t"] for r in got.collect()) == [0, 5, 10, 15, 29, 47]
