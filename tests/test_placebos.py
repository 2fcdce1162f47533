"""Placebo anchors: sets by hand, the regression against gradient descent, planted shifts, odd rows."""

import numpy as np
import pytest

from gaugeworks.operators import placebos as B

DAY = 86400
SCHEMA = "gun string, t long, x double, y double, c double"
SPANS = {"target": (600, 3600), "control": (DAY, 3 * DAY), "day": DAY}


def readings(spark, guns, days=6, step=300, shift=0.0):
    rows = []
    for g in range(guns):
        rng = np.random.default_rng(g)
        end = days * DAY - step
        for t in range(0, days * DAY, step):
            moved = shift if 600 < end - t <= 3600 else 0.0
            rows.append((f"g{g}", t, float(rng.normal() + moved), float(rng.normal()), 1.0))
    return spark.createDataFrame(rows, SCHEMA)


def sets_of(windows, placebos=25):
    return B.matched_windows(windows, B.anchors(windows, DAY // 2, 2 * DAY, 40), **SPANS, tolerance=1.5, least_pos=8, least_neg=20, placebos=placebos, folds=5)


def brute(windows, moments):
    """(gun, anchor): slots of either label, in plain loops."""
    out = {}
    for g, anchor, at in moments:
        own = [(s, c) for k, s, c in windows if k == g]
        pos = [(s, c) for s, c in own if at - 3600 <= s < at - 600]
        if len(pos) < 8:
            continue
        angle = np.angle(np.mean([np.exp(2j * np.pi * (s % DAY) / DAY) for s, _ in pos])) * 12 / np.pi % 24
        away = lambda s: abs((s % DAY) / 3600 - angle)
        neg = [s for s, c in own if at - 3 * DAY <= s < at - DAY and c in {c for _, c in pos} and min(away(s), 24 - away(s)) <= 1.5 + 1e-9]
        if len(neg) >= 20:
            out[g, anchor] = ([s for s, _ in pos], neg)
    return out


def test_sets_against_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{g}", int(t), float(rng.normal()), 0.0, float(rng.integers(0, 2))) for g in range(2) for t in range(0, 6 * DAY, 300) if rng.random() < 0.9]
    w = B.slots(spark.createDataFrame(rows, SCHEMA), ["x"], 300, "c")
    moments = B.anchors(w, DAY // 2, 2 * DAY, 40)
    found = {}
    for r in B.matched_windows(w, moments, **SPANS, least_pos=8, least_neg=20, placebos=15).collect():
        found.setdefault((r["gun"], r["anchor"]), {}).setdefault(r["label"], []).append((r["slot"], r["fold"]))
    expected = brute([(r["gun"], r["slot"], r["setpoint"]) for r in w.collect()], [tuple(r) for r in moments.collect()])
    numbered = {}
    for g in ("g0", "g1"):
        later = sorted(a for k, a in expected if k == g and a)[:15]
        for n, a in enumerate(([0] if (g, 0) in expected else []) + later, 0 if (g, 0) in expected else 1):
            numbered[g, n] = expected[g, a]
    assert set(found) == set(numbered) and len(found) > 10
    for k, (pos, neg) in numbered.items():
        for label, slots in ((1, sorted(pos)), (0, sorted(neg))):
            assert sorted(found[k][label]) == [(s, i * 5 // len(slots)) for i, s in enumerate(slots)]


def test_regression_against_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0.5).astype(float)
    w = np.zeros(4)
    z = np.column_stack((x, np.ones(200)))
    for _ in range(20000):
        w -= 0.01 * (0.1 * z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([1, 1, 1, 0.0]) * w)
    assert np.allclose(B.fitted(x, y, 0.1), w, atol=1e-6)


@pytest.mark.parametrize("y", [[0, 0, 0, 0], [1, 1, 1, 1]])
def test_one_label_has_no_area(y):
    assert np.isnan(B.told_apart(np.ones((4, 1)), np.array(y, float), np.array([0, 1, 2, 3]), 0.1))


def test_constant_columns_tell_nothing():
    assert B.told_apart(np.ones((20, 2)), np.repeat([0.0, 1.0], 10), np.tile(np.repeat(np.arange(5), 2), 2), 0.1) == 0.5


def test_planted_shift_is_seen_and_noise_is_not(spark):
    w = B.slots(readings(spark, 4), ["x", "y"], 300)
    sets = sets_of(w)
    calm = {r["gun"]: r for r in B.against_placebos(B.anchored_auroc(w, sets, ["x", "y"]), 20).collect()}
    moved = B.planted(w, sets, ["x"], 2.0)
    loud = {r["gun"]: r for r in B.against_placebos(B.anchored_auroc(moved, sets, ["x", "y"]), 20).collect()}
    assert len(calm) == len(loud) == 4
    assert all(r["n_placebo"] == 25 and r["p"] == pytest.approx(1 / 26) and r["auroc"] > r["null_q95"] for r in loud.values())
    assert np.mean([r["p"] for r in calm.values()]) > 0.1 and all(calm[g]["auroc"] < loud[g]["auroc"] for g in calm)
    cosine = {r["anchor"]: r["cosine"] for r in B.agreement(B.effects(moved, sets, ["x", "y"])).collect()}
    assert cosine[0] > 0.8 and max(v for a, v in cosine.items() if a) < cosine[0]


def test_a_shift_in_the_readings_is_seen(spark):
    w = B.slots(readings(spark, 2, shift=3.0), ["x", "y"], 300)
    assert all(r["p"] == pytest.approx(1 / 26) for r in B.against_placebos(B.anchored_auroc(w, sets_of(w), ["x", "y"]), 20).collect())


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 5, 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0, 1.0), ("a", 10, None, None, None), ("a", 10, None, None, None)], SCHEMA)
    for rows in (df, df.limit(0)):
        w = B.slots(rows, ["x"], 300)
        assert w.count() == min(1, rows.count())
        sets = sets_of(w)
        assert sets.count() == 0 and B.against_placebos(B.anchored_auroc(w, sets, ["x"])).count() == 0 and B.agreement(B.effects(w, sets, ["x"])).count() == 0
