"""Whether an event announces itself: windows before it against matched ones, and against placebo anchors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import draw
from gaugeworks.operators.intervals import interval_join
from gaugeworks.operators.staging import staged


def slots(df: DataFrame, columns: Sequence[str], width: int, setpoint: str | None = None, digits: int = 1, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, slot, columns, setpoint): means over windows of ``width``, so that a span of time holds a bounded number.

    Rows without a key or time are left out. A setpoint is its window's mean, rounded; without one all are equal.
    """
    point = F.round(F.avg(setpoint), digits) if setpoint else F.lit(0.0)
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, (F.floor(F.col(time) / width) * width).alias("slot"))
    return rows.agg(*[F.avg(c).alias(c) for c in columns], point.alias("setpoint"))


def anchors(windows: DataFrame, low: int, high: int, tries: int, key: str = "gun", seed: int = 0) -> DataFrame:
    """(key, anchor, at): the key's end as anchor 0, and ``tries`` placebos drawn ``low`` to ``high`` before it."""
    ends = windows.groupBy(key).agg(F.max("slot").alias("_end")).withColumn("anchor", F.explode(F.sequence(F.lit(0), F.lit(tries))))
    back = F.when(F.col("anchor") == 0, 0).otherwise(F.lit(low) + F.floor(draw(F.lit(seed), F.col(key), F.col("anchor")) * (high - low)))
    return ends.select(key, "anchor", (F.col("_end") - back).alias("at"))


def _clock(slot: Column, day: int) -> Column:
    return F.pmod(slot, F.lit(day)) * (24.0 / day)


def matched_windows(
    windows: DataFrame, moments: DataFrame, target: tuple[int, int], control: tuple[int, int], day: int, tolerance: float | None = 1.5,
    least_pos: int = 20, least_neg: int = 50, placebos: int = 100, folds: int = 5, key: str = "gun",
) -> DataFrame:
    """(key, anchor, slot, label, fold): the windows before each anchor and their controls, in blocks of time.

    Label 1: windows from ``target[1]`` up to more than ``target[0]`` before the anchor. Label 0: those as far
    back as ``control`` says, with a setpoint that some window of label 1 has and, unless ``tolerance`` is
    null, at most so many hours from their mean time of day. Anchors with too few of either are left out,
    as are placebos beyond the first ``placebos``; those that stay are numbered from 1, the true anchor is 0.
    A label's windows are cut into ``folds`` runs in time order, so that neighbours are not on both sides.
    """
    reach = lambda span, label: moments.select(key, "anchor", F.lit(label).alias("label"), (F.col("at") - span[1]).alias("start_t"), (F.col("at") - span[0]).alias("end_t"))
    spans = reach(target, 1).unionByName(reach(control, 0))
    rows = staged(interval_join(windows.select(key, "slot", "setpoint"), spans, max(target[1] - target[0], control[1] - control[0]), key, "slot").drop("start_t", "end_t"), "anchored")
    angle = _clock(F.col("slot"), day) * (2 * np.pi / 24)
    pos = F.col("label") == 1
    centre = F.pmod(F.atan2(F.round(F.avg(F.when(pos, F.sin(angle))), 9), F.round(F.avg(F.when(pos, F.cos(angle))), 9)) * (24 / (2 * np.pi)), F.lit(24.0))
    # a target has at most its length over the width of windows
    about = rows.groupBy(key, "anchor").agg(F.round(centre, 6).alias("_centre"), F.collect_set(F.when(pos, F.col("setpoint"))).alias("_points"))
    j = rows.join(about, [key, "anchor"])
    off = F.abs(_clock(F.col("slot"), day) - F.col("_centre"))
    near = F.lit(True) if tolerance is None else F.round(F.least(off, 24 - off), 5) <= tolerance
    rows = j.where(pos | (F.array_contains("_points", F.col("setpoint")) & near)).select(key, "anchor", "slot", "label")
    size = rows.groupBy(key, "anchor").agg(F.count_if(pos).alias("_pos"), F.count_if(~pos).alias("_neg")).where((F.col("_pos") >= least_pos) & (F.col("_neg") >= least_neg))
    true = F.col("anchor") == 0
    number = F.when(true, 0).otherwise(F.sum(F.when(true, 0).otherwise(1)).over(Window.partitionBy(key).orderBy("anchor"))).cast("long")
    size = size.withColumn("_number", number).where(F.col("_number") <= placebos)
    rows = rows.join(size, [key, "anchor"])
    place = F.row_number().over(Window.partitionBy(key, "anchor", "label").orderBy("slot")) - 1
    fold = F.floor(place * folds / F.when(pos, F.col("_pos")).otherwise(F.col("_neg")))
    return rows.select(key, F.col("_number").alias("anchor"), "slot", "label", fold.alias("fold"))


def fitted(x: np.ndarray, y: np.ndarray, c: float, rounds: int = 50) -> np.ndarray:
    """Weights, intercept last, of a logistic regression that minimises |w|² / 2 + c * loss, by damped Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    ridge = np.append(np.ones(x.shape[1] - 1), 0.0)
    sign = 2 * y - 1
    loss = lambda w: c * np.logaddexp(0, -sign * (x @ w)).sum() + (ridge * w * w).sum() / 2
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = c * x.T @ (p - y) + ridge * w
        bend = c * (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-10 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > now:
            scale /= 2
        after = loss(w - scale * step)
        if after > now:
            break
        w, gain, now = w - scale * step, now - after, after
        if gain < 1e-12 * max(1.0, now):
            break
    return w


def told_apart(x: np.ndarray, y: np.ndarray, fold: np.ndarray, c: float) -> float:
    """AUROC of scores out of fold, ties at half; NaN without both labels."""
    score = np.zeros(len(y))
    for f in np.unique(fold):
        at = fold == f
        if at.all() or len(np.unique(y[~at])) < 2:
            continue
        mean, sd = x[~at].mean(axis=0), x[~at].std(axis=0)
        z = (x - mean) / np.where(sd > 0, sd, 1.0)
        w = fitted(z[~at], y[~at], c)
        score[at] = 1 / (1 + np.exp(-np.clip(z[at] @ w[:-1] + w[-1], -500, 500)))
    score = np.round(score, 12)
    _, of, times = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[of]
    pos = y.sum()
    neg = len(y) - pos
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else float("nan")


def anchored_auroc(windows: DataFrame, sets: DataFrame, columns: Sequence[str], c: float = 0.1, key: str = "gun") -> DataFrame:
    """(key, anchor, n_pos, n_neg, auroc): how well a regression on ``columns`` tells each anchor's windows apart.

    One task fits one anchor, whose windows are bounded by the spans over the slots' width. Missing values
    count as 0, so carry them before. ``windows`` are those of ``slots``.
    """
    kind = dict(windows.dtypes)[key]
    names = list(columns)
    features = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, n in enumerate(names)]
    rows = sets.join(windows.select(key, "slot", *features), [key, "slot"]).withColumnRenamed(key, "_key")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("label", "ascending"), ("slot", "ascending")])
        x = np.column_stack([t[f"_x{i}"].to_numpy() for i in range(len(names))])
        y = t["label"].to_numpy().astype(float)
        found = told_apart(x, y, t["fold"].to_numpy(), c)
        return pa.table({"_key": t["_key"].slice(0, 1), "anchor": t["anchor"].slice(0, 1), "n_pos": pa.array([int(y.sum())]), "n_neg": pa.array([int(len(y) - y.sum())]), "auroc": pa.array([found])})

    return rows.groupBy("_key", "anchor").applyInArrow(fit, f"_key {kind}, anchor long, n_pos long, n_neg long, auroc double").withColumnRenamed("_key", key)


def against_placebos(scores: DataFrame, least: int = 20, key: str = "gun") -> DataFrame:
    """(key, auroc, p, null_median, null_q95, n_pos, n_neg, n_placebo) of keys with enough placebos.

    p is the share, the true anchor counted among them, of placebos that are told apart as well or better.
    A key has as many rows as it has anchors.
    """
    true = F.col("anchor") == 0
    own = lambda c: F.max(F.when(true, F.col(c)))
    null = F.when(~true, F.col("auroc"))
    rows = scores.withColumn("_real", own("auroc").over(Window.partitionBy(key)))
    out = rows.groupBy(key).agg(
        own("auroc").alias("auroc"), ((1 + F.count_if(~true & (F.col("auroc") >= F.col("_real")))) / (1 + F.count(null))).alias("p"),
        F.percentile(null, F.lit(0.5)).alias("null_median"), F.percentile(null, F.lit(0.95)).alias("null_q95"),
        own("n_pos").alias("n_pos"), own("n_neg").alias("n_neg"), F.count(null).alias("n_placebo"),
    )
    return out.where(F.col("auroc").isNotNull() & (F.col("n_placebo") >= least))


def effects(windows: DataFrame, sets: DataFrame, columns: Sequence[str], key: str = "gun") -> DataFrame:
    """(key, anchor, feature, effect): the difference of the labels' means in deviations of the controls."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("v")) for n in columns]))
    rows = sets.join(windows, [key, "slot"]).select(key, "anchor", "label", pairs.alias("_p")).select(key, "anchor", "label", "_p.*")
    of = lambda label: F.when(F.col("label") == label, F.col("v"))
    effect = (F.avg(of(1)) - F.avg(of(0))) / (F.stddev_pop(of(0)) + 1e-6)
    return rows.groupBy(key, "anchor", "feature").agg(effect.alias("effect"))


def agreement(found: DataFrame, key: str = "gun") -> DataFrame:
    """(anchor, keys, cosine): the mean cosine of two keys' effects at the true anchor (0) and at each placebo.

    The sum over all pairs of unit vectors is the squared length of their sum, so no pair is made.
    """
    size = found.groupBy(key, "anchor").agg(F.sqrt(F.sum(F.col("effect") * F.col("effect"))).alias("_size"))
    unit = found.join(size, [key, "anchor"]).withColumn("_u", F.col("effect") / (F.col("_size") + 1e-9))
    per = unit.groupBy("anchor", "feature").agg(F.sum("_u").alias("_s"), F.sum(F.col("_u") * F.col("_u")).alias("_q"))
    total = per.groupBy("anchor").agg(F.sum(F.col("_s") * F.col("_s") - F.col("_q")).alias("_c"))
    n = found.groupBy("anchor").agg(F.count_distinct(key).alias("keys"))
    return n.join(total, "anchor").select("anchor", "keys", F.try_divide("_c", F.col("keys") * (F.col("keys") - 1)).alias("cosine"))


def planted(windows: DataFrame, sets: DataFrame, columns: Sequence[str], shift: float, key: str = "gun") -> DataFrame:
    """``windows`` with ``shift`` deviations of the controls added in the true anchor's target: what the test should see."""
    true = sets.where(F.col("anchor") == 0).join(windows, [key, "slot"])
    sd = true.where(F.col("label") == 0).groupBy(key).agg(*[F.stddev_pop(n).alias(f"_sd_{n}") for n in columns])
    hit = true.where(F.col("label") == 1).select(key, "slot", F.lit(True).alias("_hit"))
    rows = windows.join(hit, [key, "slot"], "left").join(sd, key, "left")
    moved = {n: F.when(F.col("_hit") & F.col(f"_sd_{n}").isNotNull(), F.col(n) + shift * F.col(f"_sd_{n}")).otherwise(F.col(n)) for n in columns}
    return rows.withColumns(moved).select(*windows.columns)
