"""Hand-built cases of alarm logic, preparation and the model loop."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import alarms as A
from gaugeworks.operators import cases as C
from gaugeworks.operators import components, intervals, prep, retrieval, scoring
from gaugeworks.operators import features as W
from gaugeworks.operators import loop as L
from gaugeworks.operators import stats as S


def _flags(spark, flags):
    return spark.createDataFrame([("g", i * 60, "x" if f else "0") for i, f in enumerate(flags)], "gun string, t long, code string")


@pytest.mark.parametrize(("wait", "want"), [(1800, [1]), (60, [1, 4, 7]), (240, [1, 7])])
def test_shared_rule(spark, wait, want):
    df = _flags(spark, [0, 1, 1, 0, 1, 0, 0, 1])
    got = A.triggers(df, ["x"], wait, 0, per_code=False)
    assert sorted(r["t"] // 60 for r in got.collect()) == want


def _codes(spark, codes):
    return spark.createDataFrame([("g", i * 60, str(c)) for i, c in enumerate(codes)], "gun string, t long, code string")


@pytest.mark.parametrize(("wait", "per_code", "want"), [(1800, False, [1]), (1800, True, [1, 3]), (60, True, [1, 3, 6, 8])])
def test_rule_codes(spark, wait, per_code, want):
    got = A.triggers(_codes(spark, [0, 2, 2, 4, 4, 0, 2, 0, 4]), ["2", "4"], wait, 0, per_code=per_code)
    assert sorted(r["t"] // 60 for r in got.collect()) == want


def _duty(spark, duty):
    return spark.createDataFrame([("g", i * 60, d == 0) for i, d in duty], "gun string, w_end long, idle boolean")


@pytest.mark.parametrize(
    ("duty", "want"),
    [
        (list(enumerate([1] * 5 + [0] * 30 + [1] * 40)), list(range(35, 65))),
        (list(enumerate([1] * 5 + [0] * 29 + [1] * 40)), []),
        ([(i, 1) for i in range(5)] + [(i + 40, 1) for i in range(5, 45)], list(range(45, 75))),
        (list(enumerate([1] * 2 + [0] * 30 + [1] * 5 + [0] + [1] * 5)), list(range(32, 43))),
    ],
)
def test_restart_hold(spark, duty, want):
    held = A.restart_hold(_duty(spark, duty), "idle", 30, 1800, 60)
    assert sorted(r["w_end"] // 60 for r in held.where("held").collect()) == want


def test_early_warning_gap_breaks_run(spark):
    rows = spark.createDataFrame([("g", t, v) for t, v in [(60, 1.0), (120, 1.0), (240, 1.0), (300, 1.0), (360, 1.0), (420, None)]], "gun string, w_end long, s double")
    got = A.early_warning(rows, F.col("s") >= 1, 3, 60).orderBy("w_end").collect()
    assert [r["onset"] for r in got] == [False, False, False, False, True, False]


def test_gap_fill_leaves_long_gaps_whole(spark):
    rows = spark.createDataFrame([("g", t) for t in (0, 1, 4, 20, 21)], "gun string, t long")
    got = prep.fill_gaps(rows, 1, 5).orderBy("t").collect()
    assert [(r["t"], r["segment_id"]) for r in got] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (20, 1), (21, 1)]


def test_carry_fills_head_backward(spark):
    rows = spark.createDataFrame([("g", 0, 5.0, True), ("g", 1, 6.0, False), ("g", 2, 7.0, True), ("g", 3, 8.0, False)], "gun string, t long, v double, blank boolean")
    got = prep.carry(rows, F.col("blank"), ["v"]).orderBy("t").collect()
    assert [r["v"] for r in got] == [6.0, 6.0, 6.0, 8.0]


def test_last_arrival(spark):
    rows = spark.createDataFrame([("g", 1, 0, "a"), ("g", 1, 2, "c"), ("g", 1, 1, "b")], "gun string, t long, arrival int, v string")
    assert [r["v"] for r in prep.last_arrival(rows, "arrival").collect()] == ["c"]


def test_operating_clock(spark):
    points = spark.createDataFrame([("g", t) for t in (0, 10, 15, 30)], "gun string, t long")
    off = spark.createDataFrame([("g", 12, 20)], "gun string, start_t long, end_t long")
    got = intervals.operating_clock(points, off).orderBy("t").collect()
    assert [r["operating"] for r in got] == [0, 10, 12, 22]


def test_circular_mean_over_midnight(spark):
    rows = spark.createDataFrame([(1430,), (10,)], "m int")
    m = rows.agg(intervals.circular_mean(F.col("m"), 1440).alias("m")).first()["m"]
    assert min(m, 1440 - m) < 1e-6


def test_empty_tables(spark):
    ev = spark.createDataFrame([], "gun long, t long, code string, value double, k int, event_id long")
    assert A.triggers(ev, ["x"], 1, 1).count() == 0
    assert intervals.runs(ev, "code").count() == 0
    assert intervals.with_sessions(ev, 5).count() == 0
    assert W.tumbling(ev, 10, ["value"]).count() == 0
    assert S.auroc(ev.withColumn("y", F.lit(1)), "value", "y").first()["auroc"] is None
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_auroc_ties(spark):
    rows = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1), (0.0, 0), (None, 1)], "s double, y int")
    assert S.auroc(rows, "s", "y").first()["auroc"] == 0.875


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_forest_finds_outlier(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(500)] + [(999, 100.0, 100.0)], "id int, a double, b double")
    forest = scoring.fit_forest(rows, ["a", "b"], trees=50)
    top = scoring.with_score(rows, forest, ["a", "b"]).orderBy(F.desc("score")).first()
    assert top["id"] == 999
    c = scoring.ablation(rows.where("id = 999"), forest, ["a", "b"], [4.0, 3.0]).first()["contributions"]
    assert {x["feature"] for x in c} == {"a", "b"} and all(x["contribution"] > 0 for x in c)


def test_forest_sample_is_even(spark):
    """With far more rows than a sample has, trees still cut where the largest values of the first column lie."""
    rows = spark.range(6000).selectExpr("id", "cast(id as double) as a", "cast(id % 7 as double) as b")
    forest = scoring.fit_forest(rows, ["a", "b"], trees=100)
    cuts = forest.threshold[forest.feature == 0]
    assert (cuts > 5400).mean() > 0.03 and (cuts < 600).mean() > 0.03


def test_boosted_trees(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 5)) for i in range(200)], "a double, b double, y int")
    model = scoring.boosted(rows, ["a", "b"], "y", iterations=3, depth=2)
    assert model.transform(rows).where("prediction = y").count() == 200


def test_loop_timeline():
    weeks = [2, 2, 11, 17, 7, 1, 4, 3, 12, 3, 1]
    ended, n = [], 1
    for w in weeks:
        n += w
        ended.append(n)
    reg = L.replay(ended, L.Schedule(), lambda a, b, seen, n: False)
    assert [d for _, d in reg.log] == [
        ["wait_first:3"], ["wait_first:5"], ["first:v001"], ["train:v002"], ["keep:v001|v002", "train:v003"], ["defer:1"],
        ["keep:v001|v003", "train:v004"], ["defer:3"], ["keep:v001|v004", "train:v005"], ["defer:3"], ["defer:4"],
    ]
    assert list(reg.trained.values()) == [16, 33, 40, 45, 60]


@pytest.mark.parametrize(("gain", "noise", "margin", "fa", "want"), [(0.01, 0.01, 1.0, 1.0, False), (0.011, 0.01, 1.0, 1.2, True), (0.02, 0.0, 0.0, 1.21, True), (0.02, 0.0, 0.0, 30.0, False)])
def test_judge(spark, gain, noise, margin, fa, want):
    a = spark.createDataFrame([(0.5, 3, 1.0)], "auroc double, hits int, fa double")
    b = spark.createDataFrame([(0.5 + gain, 3, fa, True, 3, 5)], "auroc double, hits int, fa double, ew boolean, better int, common int")
    assert S.judged(a, b, noise, margin).first()["promote"] is want


def test_half_is_no_majority(spark):
    a = spark.createDataFrame([(0.5, 3, 1.0)], "auroc double, hits int, fa double")
    b = spark.createDataFrame([(0.6, 3, 1.0, True, 2, 4)], "auroc double, hits int, fa double, ew boolean, better int, common int")
    assert S.judged(a, b, 0.0, gates=(1, 2, 3)).first()["promote"] is False


def test_budget_skips_but_goes_on(spark):
    rows = spark.createDataFrame([("q", 1, 10, False), ("q", 2, 95, False), ("q", 3, 20, False), ("q", 4, 500, True), ("q", 5, 1, False)], "query_id string, rank int, size int, required boolean")
    assert sorted(r["rank"] for r in retrieval.within_budget(rows, 100).collect()) == [1, 3, 4]


def test_fused_ranks(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 1, 3)], "query_id string, doc_id int, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, doc_id int, rank int")
    got = retrieval.fused_ranks([a, b], 8).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [2, 1, 3] and math.isclose(got[0]["score"], 1 / 61 + 1 / 62, abs_tol=1e-8)


def test_waveform_identity_and_coverage(spark):
    rows = [(e, "c1", i, float(i)) for e in (1, 2) for i in range(6)] + [(3, "c1", i, float(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "event_id int, channel string, offset int, value double")
    got = {r["past_id"]: r["score"] for r in retrieval.waveform_scores(df.where("event_id = 1"), df).collect()}
    assert got == {2: 1.0}


def test_checks_merge(spark):
    row = spark.sql("select map('a', 'ok', 'b', 'bad') as r, map('b', 'ok') as d").select(C.merged_checks(F.col("r"), F.col("d")).alias("m"), C.tallies(F.col("r"), ["ok", "bad"]).alias("t")).first()
    assert row["m"] == {"a": "ok", "b": "ok"} and tuple(row["t"]) == (1, 1)
