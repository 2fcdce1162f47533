"""Operators without a registered query, on a few rows."""

import os

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text, vectors
from gaugeworks.operators import cases as C
from gaugeworks.operators import experiments as X
from gaugeworks.operators import features as W
from gaugeworks.operators import prep as P
from gaugeworks.operators import retrieval as R
from gaugeworks.operators import scoring, stats
from gaugeworks.operators.staging import finished, staged


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_times(spark):
    r = one(spark, P.sample_time(F.lit(None).cast("int"), F.lit(5), F.lit(9), F.lit(2)).alias("a"), P.sample_time(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(9), F.lit(2)).alias("b"))
    assert (r["a"], r["b"]) == (5, 7)
    r = one(spark, P.clock_slots(F.lit(0).cast("long"), F.lit(4).cast("long"), 1).alias("a"), P.clock_slots(F.lit(0).cast("long"), F.lit(2).cast("long"), 1).alias("b"))
    assert r["a"] == [0, 1, 2, 3] and r["b"] is None
    df = spark.createDataFrame([("e", 3), ("e", 5)], "event_id string, s int")
    assert sorted(r["offset"] for r in P.offsets(df, "s").collect()) == [-2, 0]


def test_rows_and_names(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (1, 0, 0.0), (0, 1, 0.0), (0, 0, 0.9)], "label int, error_active int, non_welding double")
    assert P.normal_rows(df).count() == 2 and P.normal_rows(df, rest="non_welding").count() == 0 and P.clean_windows(df).count() == 2
    wide = spark.createDataFrame([(1, 2, 3)], "c19_mean int, c19_std int, c1 int")
    assert P.without_prefix(wide, "c19_").columns == ["c1"]
    a, b = P.feature_parts(F.lit("weld_duty_mean"))
    assert tuple(one(spark, a, b)) == ("weld_duty", "mean")
    r = one(spark, P.program_key((F.lit(123.4), -2), (F.lit(1.26), 1)).alias("k"), P.unscale(F.lit(2.0), F.lit(3.0), F.lit(1.0), 2).alias("u"), P.terminal_class(F.lit("E016")).alias("t"), P.switched(F.lit(0.0), F.lit(1.0)).alias("s"))
    assert r["k"] == "100.0|1.3" and r["u"] == 8.0 and r["t"] == "E02" and r["s"] is True


def test_cards(spark):
    item = "array<struct<card_id:string,n:int>>"
    df = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3)], ["b"])], f"items {item}, rejected array<string>")
    r = df.select(C.without_rejected(F.col("items"), F.col("rejected")).alias("w"), C.distinct_in_order(F.col("items"), "card_id").alias("d")).first()
    assert [x["n"] for x in r["w"]] == [1, 3] and [x["n"] for x in r["d"]] == [1, 2]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "card_id string, position int")
    assert [tuple(r) for r in C.cards(rows, spark.createDataFrame([("b",)], "card_id string")).collect()] == [("a", 2)]
    a, b = spark.createDataFrame([(1,), (2,)], "f int"), spark.createDataFrame([(2,), (3,)], "f int")
    assert [r["f"] for r in C.disjoint(a, b, key="f").collect()] == [2]
    out = spark.createDataFrame([("p", "pending"), ("p", "done"), ("q", "done")], "pattern_key string, status string")
    assert {r["pattern_key"]: r["pending"] for r in C.pending_patterns(out).collect()} == {"p": True, "q": False}
    failed = spark.createDataFrame([("p", "failed"), (None, "pending"), ("q", None)], "pattern_key string, status string")
    assert {r["pattern_key"]: r["pending"] for r in C.pending_patterns(failed).collect()} == {"p": True, "q": False}
    r = one(spark, C.group_key(F.lit("x"), F.lit("k"), F.lit("E1")).alias("a"), C.group_key(F.lit(None), F.lit("early_warning"), F.lit("E1")).alias("b"), C.group_key(F.lit(None), F.lit("k"), F.lit("E1")).alias("c"))
    assert tuple(r) == ("episode:x", "early_warning", "E1")


def test_claims(spark):
    box = spark.createDataFrame([(1, "pending", 0, 5), (2, "pending", 1, 3), (3, "done", 1, 1), (4, "pending", 0, 50), (5, None, 0, 1)], "event_id int, status string, attempts int, next_attempt_at long")
    got = C.claimed(box, 10, 70, 1).collect()
    assert [tuple(r) for r in got] == [(2, "pending", 2, 70)]
    answers = spark.createDataFrame([(1, 0, "done", 0), (2, 0, "done", 0), (3, 1, "failed", 9), (9, 0, "done", 0)], "event_id int, attempts int, status string, next_attempt_at int")
    done = {r["event_id"]: (r["status"], r["next_attempt_at"]) for r in C.finished(box, answers).collect()}
    assert done == {1: ("done", 0), 2: ("pending", 3), 3: ("done", 1), 4: ("pending", 50), 5: (None, 1)}


def test_findings(spark):
    kind = "array<struct<feature:string,contribution:double,share:double>>"
    parts = [("c1_mean", 0.5, 0.5), ("hour_sin_mean", 0.3, 0.3), ("c2_std", 0.1, 0.1), ("c3_mean", 0.01, 0.01), ("c4_std", 0.2, 0.2)]
    dev = {"c1_mean": -1.0, "hour_sin_mean": 2.0, "c2_std": 1.0, "c3_mean": 5.0, "c4_std": -3.0}
    df = spark.createDataFrame([(parts, dev)], f"c {kind}, d map<string,double>")
    got = df.select(scoring.findings(F.col("c"), F.col("d")).alias("f"), scoring.top_contributors(F.col("c")).alias("t")).first()
    assert [(x["feature"], x["direction"]) for x in got["f"]] == [("c1_mean", "low"), ("c2_std", "unstable")]
    assert [x["feature"] for x in got["t"]] == ["c1_mean", "c2_std", "c3_mean"]
    rows = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    assert rows.select(scoring.deviations(["a", "b"], [1.0, 1.0]).alias("m")).first()["m"] == {"a": 0.0, "b": 3.0}
    assert scoring.threshold_of(rows, "a", F.lit(True), 0.5).first()["threshold"] == 2.0
    assert scoring.share_below(rows, rows, "a", 10).where("cdf between 0 and 1").count() == 2
    assert one(spark, scoring.combined([F.lit(1.0), F.lit(3.0)], [3, 1]).alias("m"), scoring.combined([F.lit(1.0), F.lit(3.0)], kind="max").alias("x")) == (1.5, 3.0)


def test_scores_of_cards(spark):
    cards = spark.createDataFrame([("c", 1, ["x", "y"]), ("c", 2, ["q"]), ("c", 9, ["z"])], "case_id string, place int, labels array<string>")
    gold = spark.createDataFrame([("c", "x"), ("c", "z"), ("d", "x")], "case_id string, label string")
    assert {r["case_id"]: (r["precision"], r["recall"]) for r in X.card_scores(cards, gold).collect()} == {"c": (0.5, 0.5), "d": (None, 0.0)}
    df = spark.createDataFrame([("g", 5, True), ("g", 9, True), ("h", 3, True), ("h", 1, False)], "gun string, ttf int, o boolean")
    r = X.onset_quantiles(df, F.col("o"), q=(0.5,)).first()
    assert r["keys"] == 2 and r["quantiles"] == [6.0]
    p = spark.createDataFrame([("g", 1.0, float(i)) for i in range(9)], "gun string, r double, p double")
    assert X.beats_placebos(p, "r", "p").first()["better"] == 0


def test_comparisons(spark):
    df = spark.createDataFrame([(i, 2.0, 1.0) for i in range(20)], "gun int, a double, b double")
    r = stats.paired_difference(df, "a", "b", 50).first()
    assert r["low"] == r["high"] == 1.0
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert [r["file"] for r in stats.shadow_files(f, f.where("file = 'a'"), f.where("file = 'b'")).collect()] == ["c"]
    best = stats.best_within(spark.createDataFrame([(1, 0.5, 3.0), (2, 0.9, 30.0), (3, 0.7, 5.0)], "q int, v double, c double"), "v", "c", 24.0, ["q"]).first()
    assert best["q"] == 3


def test_vectors_and_tables(spark):
    r = one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("a"), vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("b"))
    assert r["a"] == 1.0 and r["b"] is None
    t = spark.createDataFrame([("d", 1, "h", 10.0), ("d", 2, "h", 20.0), ("d", 3, "h", 50.0), ("d", 5, "h", 50.0)], "doc_id string, page int, headers string, left_edge double")
    assert [r["continues"] for r in R.continued(t).orderBy("page").collect()] == [False, True, False, False]
    assert one(spark, text.canonical_json(b=F.lit(1), a=F.lit("x")).alias("j"))["j"] == '{"a":"x","b":1}'
    r = one(spark, text.shortest_line(F.lit("long needle line\nneedle\nx"), F.lit("needle")).alias("s"), text.holds(F.lit("a\n b"), F.lit("a b")).alias("h"))
    assert tuple(r) == ("needle", True)


def test_vector_search_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)] + [(99, None)], "vec_id long, embedding array<double>")
    a = R.vector_top_k(rows, rows.where("vec_id < 5"), 3)
    b = R.vector_top_k(rows, rows.where("vec_id < 5"), 3, block=2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 15
    assert R.vector_top_k(rows, rows.where("false"), 3).count() == 0


def test_warm_up_by_rows(spark):
    df = spark.createDataFrame([("g", i * 10, 1.0) for i in range(10)] + [("h", i * 100, 1.0) for i in range(3)], "gun string, t long, v double")
    got = {r["gun"]: (r["ends_at"], r["source"]) for r in X.warm_up_end(df, F.col("v") > 0, 150, 5).collect()}
    assert got == {"g": (40, "gun"), "h": (150, "global")}


@pytest.mark.parametrize("q", [None, 0.5])
def test_day_index_and_sample(spark, q):
    df = spark.createDataFrame([("g", float(i)) for i in range(10)], "gun string, ttf double")
    assert df.select(W.day_index(F.col("ttf"), day=5).alias("d")).distinct().count() == 2
    assert W.hashed_sample(df, 4, ["gun", "ttf"]).count() == 4


def test_keyword_search_in_blocks(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 9))) for i in range(30)] + [(99, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(q, f"w{t}") for q in range(5) for t in (q, q + 1)] + [(9, "none")], "query_id long, term string")
    want = R.top_k(R.bm25(docs, terms, F.col("text")), 4)
    for block in (2048, 2):
        got = R.keyword_top_k(docs, terms, F.col("text"), 4, block=block)
        assert sorted(map(tuple, got.select("query_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "doc_id", "score", "rank").collect()))
    assert R.keyword_top_k(docs, terms.where("false"), F.col("text"), 4).count() == 0


def test_finished_tables_are_deleted(spark):
    kept, gone = staged(spark.range(5), "kept"), staged(spark.range(5).repartition(2), "gone")
    paths = [df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for df in (kept, gone)]
    finished(spark, gone)
    assert [os.path.exists(p) for p in paths] == [True, False] and kept.count() == 5
    finished(spark)
    with pytest.raises(ValueError):
        finished(spark, spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
