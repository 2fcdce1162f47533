"""Sums of depths that are looked up equal those that are walked, bit by bit, and few rows are walked."""

import numpy as np
import pytest

from gaugeworks.operators import scoring as S
from gaugeworks.operators import steps as T


def forest(x, trees=40, seed=0):
    rng = np.random.default_rng(seed)
    grown = [S.grown(x[rng.choice(len(x), 64)], seed, t, 6) for t in range(trees)]
    width = max(map(len, grown))
    a = np.array([g + [(-1, 0.0, 0, 0, 0.0)] * (width - len(g)) for g in grown], float)
    ints = [a[:, :, i].astype(np.int64) for i in (0, 2, 3)]
    return S.IsolationForest(ints[0], a[:, :, 1], ints[1], ints[2], a[:, :, 4], S._average_depth(64), 6)


def rows(n=3000, seed=1):
    """One feature of many values and two of few, with missing values."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 5, n), rng.random(n) * 1000, rng.integers(0, 3, n)]).astype(float)
    x[::97, 1], x[5::101, 0], x[7, 2] = np.nan, np.nan, np.inf
    return x


def walked(f, x, reference):
    x = np.nan_to_num(x)
    return f.depths(x), np.column_stack([f.depths(T._put(x, j, r)) for j, r in enumerate(np.nan_to_num(reference))])


@pytest.mark.parametrize(("often", "most_bytes", "most_keys", "table"), [(16, 1 << 27, 1 << 20, 1 << 20), (1, 1 << 27, 1 << 20, 1), (3, 20_000, 1 << 20, 1000), (2, 1 << 27, 4, 1000), (10**9, 1 << 27, 1 << 20, 1000)])
def test_equals_walks(monkeypatch, often, most_bytes, most_keys, table):
    for name, value in (("OFTEN", often), ("MOST_BYTES", most_bytes), ("MOST_KEYS", most_keys), ("TABLE", table)):
        monkeypatch.setattr(T, name, value)
    x = rows()
    f = forest(np.nan_to_num(x, posinf=9.0))
    for reference in (np.array([2.0, 400.0, 1.0]), np.array([np.nan, -5.0, 7.5])):
        total, alone = walked(f, x, reference)
        steps = T.Steps(f, x[:500])
        for low in (*range(0, 3000, 250), 0, 3000):
            got = steps.without(x[low : low + 250], reference)
            assert (got[0] == total[low : low + 250]).all() and (got[1] == alone[low : low + 250]).all()


@pytest.mark.parametrize("features", [1, 2, 14])
def test_equals_walks_of_few_and_many_features(features):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40 if features > 2 else 4, (800, features)).astype(float)
    f = forest(x + rng.random(x.shape), trees=200)
    reference = np.median(x, axis=0)
    total, alone = walked(f, x, reference)
    steps = T.Steps(f, x)
    assert steps._usable == (features < 14)
    got = steps.without(x, reference)
    assert (got[0] == total).all() and (got[1] == alone).all()


def test_few_rows_are_walked(monkeypatch):
    x = rows(20_000)
    f, seen = forest(np.nan_to_num(x, posinf=9.0)), []
    depths = S.IsolationForest.depths
    monkeypatch.setattr(S.IsolationForest, "depths", lambda self, y: seen.append(len(y)) or depths(self, y))
    steps = T.Steps(f, x[:1000])
    for low in range(0, len(x), 1000):
        steps.without(x[low : low + 1000], np.array([2.0, 400.0, 1.0]))
    assert sum(seen) < 400


def test_a_forest_of_leaves_and_a_tree_without_depth():
    one = np.zeros((3, 1))
    f = S.IsolationForest(np.full((3, 1), -1), one, one.astype(int), one.astype(int), one, 1.0, 1)
    total, alone = T.Steps(f, np.ones((40, 2))).without(np.ones((40, 2)), np.zeros(2))
    assert (total == 0).all() and (alone == 0).all()


def test_ablation_equals_walks_by_hand(spark):
    df = spark.range(2000).selectExpr("id", "cast(id * 37 % 1009 as double) as a", "if(id % 11 = 0, null, cast(id % 4 as double)) as b")
    f = S.fit_forest(df, ["a", "b"], trees=25, sample=64)
    got = {r["id"]: r["contributions"] for r in S.ablation(df, f, ["a", "b"], [500.0, 1.0], most=1).collect()}
    ids = np.array(sorted(got))
    x = np.column_stack([ids * 37 % 1009, np.where(ids % 11 == 0, 0, ids % 4)]).astype(float)
    base = f.score(x)
    drops = np.column_stack([base - f.score(T._put(x, 0, 500.0)), base - f.score(T._put(x, 1, 1.0))])
    first = np.argmax(drops, axis=1)
    positive = np.maximum(drops, 0)
    for i in ids:
        (c,) = got[i]
        assert c["feature"] == "ab"[first[i]] and c["contribution"] == drops[i, first[i]]
        assert np.isclose(c["share"], positive[i, first[i]] / max(positive[i].sum(), 1e-12))


def test_low_numbers_are_those_of_all_numbers():
    own = S.salted(S._mixed(np.arange(700, dtype=np.uint64) // np.uint64(2)), 9)
    for bar in (np.uint64(2**64 - 2**12), np.uint64(2**60 + 5), np.uint64(2**33), np.uint64(0)):
        got = {t: (p.tolist(), n.tolist()) for t, p, n in S.low_numbers(own, 12, 4, bar) if len(p)}
        want = {t: (np.flatnonzero(n <= bar).tolist(), n[n <= bar].tolist()) for t in range(12) for n in [S.numbers(own, t, 4)] if (n <= bar).any()}
        assert got == want
    assert not list(S.low_numbers(own[:0], 3, 4, np.uint64(5)))


def test_steps_are_kept_from_task_to_task():
    x = rows(300)
    f, other = forest(np.nan_to_num(x, posinf=9.0)), forest(np.nan_to_num(x, posinf=9.0), seed=2)
    assert f.token != other.token
    first = T.steps_of(f.token, f, x)
    assert T.steps_of(f.token, f, x) is first and T.steps_of(other.token, other, x) is not first and len(T._HELD) == 1


def test_digests_of_medians_do_not_grow_with_partitions(spark):
    sc = spark.sparkContext
    df = spark.range(0, 5001, 1, 300).selectExpr("cast(id as double) as a", "if(id % 2 = 0, null, id) as b")
    sc.setJobGroup("medians", "")
    try:
        got = S.medians(df, ["a", "b"])
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert abs(got[0] - 2500) <= 1 and abs(got[1] - 2500) <= 2
    track = sc.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("medians") for s in track.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 4 * sc.defaultParallelism
    assert S.medians(df.where("false"), ["a"]) == [None]
