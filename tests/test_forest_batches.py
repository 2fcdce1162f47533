"""What a forest's batches share is made once: nodes in order, and a batch's order of hashes."""

import numpy as np

from gaugeworks.operators import scoring as S


def test_a_batch_is_sorted_once_for_all_trees(spark):
    hashes = S._mixed(np.arange(500, dtype=np.uint64) // np.uint64(3))
    own = S.salted(hashes, 7)
    for tree in range(5):
        assert (S.numbers(own, tree, 2) == S.draws(hashes, 7, tree, 2)).all()
    assert len(np.unique(S.numbers(own, 0, 2))) == 500


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    df = spark.range(700).selectExpr("id", "cast(id % 20 as double) as a", "cast(id * 31 % 97 as double) as b")
    forest = S.fit_forest(df, ["a", "b"], trees=19, sample=64)
    x = np.array([[i % 23, i % 101] for i in range(500)], float)
    x[3] = [np.nan, np.inf]
    want = forest.score(x)
    assert forest._walks is forest._walks
    monkeypatch.setattr(S, "ROWS", 7)
    monkeypatch.setattr(S, "TREES", 5)
    again = S.IsolationForest(forest.feature, forest.threshold, forest.left, forest.right, forest.depth, forest.expected, forest.steps)
    assert (again.score(x) == want).all() and len(forest.score(x[:0])) == 0
