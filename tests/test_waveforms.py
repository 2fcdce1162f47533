"""Bounds and pruning of waveform likeness against every pair."""

import numpy as np
import pytest

from gaugeworks.operators import retrieval, waveforms

CHANNELS, LENGTH = ["a", "b", "on"], 23


def made(seed, n):
    """Events of a few shapes, with gaps, missing channels, zeros and equal copies."""
    rng = np.random.default_rng(seed)
    shapes = rng.normal(size=(6, 3, LENGTH)).cumsum(axis=2)
    x = shapes[rng.integers(0, 6, n)] + rng.normal(scale=0.2, size=(n, 3, LENGTH))
    x[:, 2] = x[:, 2] > 0
    x[rng.random((n, 3, LENGTH)) < 0.3] = np.nan
    x[rng.random((n, 3)) < 0.2] = np.nan
    x[1] = x[0]
    x[2] = 0.0
    return np.arange(100, 100 + n), x


def rows_of(ids, x):
    return [(int(i), c, o, float(v)) for i, e in zip(ids, x, strict=True) for c, own in zip(CHANNELS, e, strict=True) for o, v in enumerate(own) if not np.isnan(v)]


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_prune(seed):
    e = waveforms.events_of(*made(seed, 400))
    binary = np.array([False, False, True])
    compared = []
    for i in range(40):
        s, channels = waveforms.scores(e, i, e, np.arange(400), binary, 3)
        bound = waveforms.bounds(e, i, e, binary, 3)
        assert (bound >= np.where(channels > 0, s, -1) - 1e-12).all() and ((channels == 0) | (bound >= 0)).all()
        want = sorted((-round(float(v), 6), int(p), int(c)) for v, p, c in zip(s, e.ids, channels, strict=True) if c and p != e.ids[i])[:5]
        found, n = waveforms.best(e, i, e, 5, binary, 3, 6)
        assert found == [(-v, p, c) for v, p, c in want]
        compared.append(n)
    assert np.mean(compared) < 250


def test_equals_every_pair(spark, monkeypatch):
    """The k best of the table of all pairs, over several blocks and ranges."""
    monkeypatch.setattr(waveforms, "BLOCK", 7)
    monkeypatch.setattr(waveforms, "SPAN", 19)
    ids, x = made(9, 60)
    df = spark.createDataFrame(rows_of(ids, x), "event_id long, channel string, offset int, value double")
    some = df.where("event_id % 3 = 0")
    want = {}
    for r in retrieval.waveform_scores(some, df, ["on"]).collect():
        want.setdefault(r["event_id"], []).append((-round(r["score"], 6), r["past_id"], r["channels"]))
    got = {}
    for r in waveforms.waveform_top_k(some, df, 4, CHANNELS, LENGTH, ["on"]).orderBy("event_id", "rank").collect():
        got.setdefault(r["event_id"], []).append((-r["score"], r["past_id"], r["channels"]))
    assert got == {i: sorted(w)[:4] for i, w in want.items()} and len(got) > 10


def test_empty_and_odd(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0), (1, "z", 0, 1.0), (2, "a", None, 1.0), (None, "a", 1, 2.0)], "event_id long, channel string, offset int, value double")
    assert waveforms.waveform_top_k(df, df, 3, CHANNELS, LENGTH).collect() == []
    assert waveforms.waveform_top_k(df.where("false"), df, 3, CHANNELS, LENGTH).collect() == []
