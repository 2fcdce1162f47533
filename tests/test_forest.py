"""Isolation trees grown in executors: samples, trees and scores against a version in NumPy on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import scoring as S


def by_numpy(df, columns, trees, sample, seed):
    """The same forest from all rows: every row's number for every tree, and the smallest of them."""
    kinds = [c for c, _ in sorted(df.dtypes)]
    rows = df.select(F.xxhash64(F.lit(seed), *kinds).alias("h"), *columns).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    x = np.array([[r[c] or 0.0 for c in columns] for r in rows], float)
    out = []
    for t in range(trees):
        number = S.draws(h, 0, t, seed)
        first = np.lexsort((*x.T[::-1], number >> np.uint64(1)))[:sample]
        out.append(S.grown(x[first], seed, t, max(1, int(np.ceil(np.log2(max(min(sample, len(x)), 2)))))))
    return out


@pytest.mark.parametrize(("n", "sample"), [(50, 256), (3000, 64)])
def test_equals_numpy(spark, n, sample):
    df = spark.range(n).selectExpr("id", "cast(id * 37 % 1009 as double) as a", "if(id % 11 = 0, null, sin(id)) as b").repartition(5)
    got = S.fit_forest(df, ["a", "b"], trees=20, sample=sample, seed=3)
    for t, nodes in enumerate(by_numpy(df, ["a", "b"], 20, sample, 3)):
        k = len(nodes)
        assert got.feature[t, :k].tolist() == [r[0] for r in nodes]
        assert np.allclose(got.threshold[t, :k], [r[1] for r in nodes]) and np.allclose(got.depth[t, :k], [r[4] for r in nodes])
        assert got.left[t, :k].tolist() == [r[2] for r in nodes] and got.right[t, :k].tolist() == [r[3] for r in nodes]
    again = S.fit_forest(df.repartition(2), ["a", "b"], trees=20, sample=sample, seed=3)
    assert (again.threshold == got.threshold).all()


def test_scores_walk_the_trees(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 20 as double) as a", "cast(id % 7 as double) as b")
    forest = S.fit_forest(df, ["a", "b"], trees=30, sample=64)
    x = np.array([[3.0, 2.0], [19.0, 6.0], [-5.0, 50.0]])
    want = []
    for row in x:
        depths = []
        for t in range(30):
            at = 0
            while forest.feature[t, at] >= 0:
                at = forest.left[t, at] if row[forest.feature[t, at]] < forest.threshold[t, at] else forest.right[t, at]
            depths.append(forest.depth[t, at])
        want.append(2 ** (-np.mean(depths) / forest.expected))
    assert np.allclose(forest.score(x), want)


def test_copies_are_sampled_by_their_share():
    """A row that is a third of a batch is about a third of a sample, and samples of trees differ."""
    hashes = np.concatenate([np.full(300, 77, np.uint64), S._mixed(np.arange(1, 601, dtype=np.uint64))])
    shares = []
    for t in range(60):
        number = S.draws(hashes, 5, t, 0)
        assert len(np.unique(number)) == 900
        shares.append((np.argsort(number)[:90] < 300).mean())
    assert abs(np.mean(shares) - 1 / 3) < 0.03 and np.std(shares) > 0.01


def test_bounds(spark):
    df = spark.range(10).selectExpr("id", "cast(id as double) as a")
    with pytest.raises(ValueError, match="nodes"):
        S.fit_forest(df, ["a"], trees=5000, sample=256)
    none = S.fit_forest(df.where("false"), ["a"], trees=3)
    assert none.score(np.array([[1.0]])).shape == (1,)
    same = S.fit_forest(df.selectExpr("1 as id", "2.0D as a"), ["a"], trees=3)
    assert (same.feature == -1).all()
