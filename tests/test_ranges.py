"""Ranks, quantiles and AUROC whose ranges are many, under adaptive execution; resamples and the model loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.text import draw
from gaugeworks.operators import loop as L
from gaugeworks.operators import stats as S

N = 2_000_000


@pytest.fixture()
def many_ranges(spark):
    """Adaptive execution with many small partitions, some of which it merges."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def scores(spark, n=N):
    return spark.range(n).select("id", (F.pmod(F.col("id") * 7919 + 13, F.lit(n)) / n).alias("s"), (draw(F.col("id")) < 0.3 + F.pmod(F.col("id") * 7919 + 13, F.lit(n)) / n / 5).cast("int").alias("y"))


def exact_auroc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_auroc_of_many_distinct_scores(spark, many_ranges):
    df = scores(spark)
    rows = df.select("s", "y").toPandas()
    s, y = rows["s"].to_numpy(), rows["y"].to_numpy()
    got = S.auroc(df, "s", "y").first()
    assert got["n_pos"] + got["n_neg"] == N and got["n_pos"] == y.sum()
    assert math.isclose(got["auroc"], exact_auroc(s, y), abs_tol=1e-9)


def test_ranks_of_many_distinct_scores(spark, many_ranges):
    out = S.ranked(scores(spark), "s")
    wrong = out.where(F.abs(F.col("rank") - (F.round(F.col("s") * N) + 1)) > 1e-6)
    assert wrong.count() == 0 and out.count() == N


def test_keys_are_split_and_kept_apart(spark, many_ranges):
    """A hot key, a small one and a null one; values that tie."""
    key = F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 10 == 1, "small").otherwise("hot")
    df = scores(spark, 200_000).withColumn("k", key).withColumn("v", F.floor(F.col("s") * 50_000))
    rows = df.select("k", "v").toPandas()
    got = {r["k"]: r for r in S.quantiles(df, "v", [0.0, 0.31, 0.5, 1.0], ["k"]).collect()}
    for k in ("hot", "small", None):
        v = rows["v"][rows["k"].isna()] if k is None else rows["v"][rows["k"] == k]
        assert got[k]["n"] == len(v) and np.allclose(got[k]["quantiles"], np.quantile(v, [0.0, 0.31, 0.5, 1.0]))
    ranks = S.ranked(df, "v", ["k"]).groupBy("k").agg(F.sum(F.col("rank") * F.col("n")).alias("sum"), F.max("all").alias("all")).collect()
    assert all(r["sum"] == r["all"] * (r["all"] + 1) / 2 for r in ranks) and len(ranks) == 3


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in S.quantiles(df, "v", [0.5], ["k"]).collect()] == [("a", 1, [2.0])]
    assert [tuple(r) for r in S.quantiles(df.where("false"), "v", [0.5]).collect()] == [(0, [None])]
    assert S.ranked(df.where("false"), "v").count() == 0


def test_weights_are_of_a_poisson_variable(spark):
    """Mean and variance 1, so intervals are not too narrow."""
    rows = spark.range(3000).select(F.col("id").alias("gun"), F.lit(1.0).alias("v"))
    u = rows.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(40)))).select(draw(F.lit(0), F.col("gun"), F.col("resample")).alias("u"))
    w = sum((F.col("u") >= p).cast("int") for p in S.POISSON)
    got = u.agg(F.avg(w).alias("mean"), F.var_samp(w).alias("var"), F.max(w).alias("top")).first()
    assert abs(got["mean"] - 1) < 0.01 and abs(got["var"] - 1) < 0.02 and got["top"] > 4


def test_interval_is_as_wide_as_theory(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "gun long, v double")
    got = S.interval(S.resampled(df, "v", 2000)).first()
    assert abs((got["high"] - got["low"]) / (2 * 1.96 * v.std() / 20) - 1) < 0.06


def test_what_if_judges_by_files_after_training(spark):
    """Twenty files, one a tick. v001 after 4 files, v002 after 8; the challenger is better in files 9 to 12 only."""
    files = spark.createDataFrame([(i, 1.0, 2.0 if 8 <= i < 12 else 0.0) for i in range(20)], "day int, a double, b double")
    one = L.what_if(files, "day", {"a": "a", "b": "b"}, [L.Schedule(first=4, new=4, shadow=4)], 1)[0]
    done = {tick + 1: actions for tick, actions in one.log}
    assert done[4] == ["first:v001"] and done[8] == ["train:v002"]
    assert done[12] == ["swap:v001|v002", "train:v003"]  # four of four, though only 4 of 20 in all
    assert done[16] == ["keep:v002|v003", "train:v004"] and done[20][0] == "keep:v002|v004"
    half = L.what_if(files.where("day < 14"), "day", {"a": "a", "b": "b"}, [L.Schedule(first=4, new=6, shadow=4)], 1)[0]
    assert (13, ["keep:v001|v002"]) == half.log[13]  # files 11 to 14: two of four are no majority
