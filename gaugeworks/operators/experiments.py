"""Offline analyses of scores, events and horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import draw
from gaugeworks.operators.intervals import interval_join, ordered, since_and_until
from gaugeworks.operators.stats import auroc, cumulative, quantiles, same_keys


def masked(column: str, mask: Column, how: str = "median", least: int = 1) -> Column:
    """Aggregate of a column over rows of a mask; null with fewer than ``least`` of them (A10)."""
    x = F.when(mask, F.col(column))
    value = {"median": F.percentile(x, F.lit(0.5)), "mean": F.avg(x), "sum": F.sum(x), "max": F.max(x)}[how]
    return F.when(F.count(x) >= least, value)


def minute_profile(df: DataFrame, width: int, welding: Column, pressing: Column, column: str, key: str = "gun", time: str = "t") -> DataFrame:
    """Per slot: rows, rows of either state, and medians of ``column`` over them, from three rows on (A10)."""
    slot = F.floor(F.col(time) / width).alias("slot")
    return df.groupBy(key, slot).agg(
        F.count("*").alias("n"),
        F.count_if(welding).alias("n_weld"),
        F.count_if(pressing).alias("n_press"),
        masked(column, welding, "median", 3).alias("weld_median"),
        masked(column, pressing, "mean").alias("press_mean"),
        F.avg(pressing.cast("double")).alias("press_share"),
    )


def joined_minutes(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either side, missing values null, in no case made up."""
    return a.join(b, list(keys), "full_outer")


def episode_statistics(runs: DataFrame, code: str = "code", key: str = "gun") -> DataFrame:
    """Per code: episodes, keys, median and longest duration, share of all episodes."""
    out = runs.groupBy(code).agg(F.count("*").alias("episodes"), F.count_distinct(key).alias("keys"), F.percentile("duration", F.lit(0.5)).alias("median_duration"), F.max("duration").alias("longest"))
    return out.withColumn("share", F.col("episodes") / F.sum("episodes").over(Window.partitionBy(F.lit(1))))


def gap_starts(df: DataFrame, step: int, span: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, bin, starts): gaps that begin in each span of time before a key's end."""
    w = ordered(key, time)
    rows = df.withColumn("_gap", F.lead(time).over(w) - F.col(time) > step).withColumn("_end", F.max(time).over(Window.partitionBy(key)))
    return rows.groupBy(key, F.floor((F.col("_end") - F.col(time)) / span).alias("bin")).agg(F.count_if("_gap").alias("starts"), F.count("*").alias("n"))


def pair_agreement(df: DataFrame, a: str, b: str, keys: Sequence[str], within: float = 0.1) -> DataFrame:
    """(keys, r, ratio, agree): correlation, median ratio, share of rows within a tenth of each other."""
    ratio = F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    out = df.groupBy(*keys).agg(F.corr(a, b).alias("r"), F.avg((F.abs(ratio - 1) <= within).cast("double")).alias("agree"))
    median = quantiles(df.withColumn("_ratio", ratio), "_ratio", [0.5], keys).select(*keys, F.col("quantiles")[0].alias("ratio"))
    return same_keys(out, median, keys, "left")


def cap_cycle(df: DataFrame, column: str, key: str = "gun", time: str = "t", dress: tuple[float, float] = (0.05, 0.6), change: float = -1.0) -> DataFrame:
    """Adds step and kind of each row: cap_change (a drop), dressing (a small rise), or other."""
    step = F.col(column) - F.lag(column).over(ordered(key, time))
    rows = df.withColumn("step", step)
    kind = F.when(F.col("step") <= change, "cap_change").when(F.col("step").between(*dress), "dressing").when(F.col("step").isNotNull(), "other")
    return rows.withColumn("kind", kind)


def on_shares(df: DataFrame, signals: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, signal, on_share): the share of rows in which a signal is on."""
    long = df.select(*keys, *[F.col(s).cast("double").alias(s) for s in signals]).unpivot(list(keys), list(signals), "signal", "x")
    return long.groupBy(*keys, "signal").agg(F.avg((F.col("x") > 0).cast("double")).alias("on_share"))


def warm_up_end(df: DataFrame, normal: Column, span: int, rows: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, ends_at, source): when a key's own statistics freeze.

    That is at its ``rows``-th normal row, or ``span`` after its first row if that comes sooner; source is
    ``gun`` once there are enough rows by then, else ``global``.
    """
    w = ordered(key, time)
    counted = df.withColumn("_n", F.sum(normal.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_is", normal)
    reach = F.min(F.when((F.col("_n") >= rows) & F.col("_is"), F.col(time)))
    cap = F.min(time) + span
    out = counted.groupBy(key).agg(F.least(reach, cap).alias("ends_at"), F.when(reach < cap, "gun").otherwise("global").alias("source"))
    return out


def regime_threshold(df: DataFrame, ends: DataFrame, own: Column, common: Column, key: str = "gun", start: str = "w_start") -> DataFrame:
    """Adds threshold: a key's own for windows that begin at or after its warm-up's end."""
    j = df.join(ends, key, "left")
    return j.withColumn("threshold", F.when(F.coalesce(F.col(start) >= F.col("ends_at"), F.lit(False)), own).otherwise(common)).drop("ends_at")


def event_window(windows: DataFrame, events: DataFrame, key: str = "gun", time: str = "t", end: str = "w_end", event: str = "event_id") -> DataFrame:
    """(event_id, w_end): the first window that ends at or after an event, else the key's last."""
    from gaugeworks.operators.intervals import asof_before

    # looking ahead is looking back on a clock that runs the other way
    flipped = windows.select(key, (-F.col(end)).alias(time), F.col(end).alias("_end"))
    e = events.select(key, event, (-F.col(time) + 1).alias(time))
    found = asof_before(e, flipped, ["_end"], key, time)
    last = windows.groupBy(key).agg(F.max(end).alias("_last"))
    return found.join(last, key, "left").select(event, F.coalesce("_end", "_last").alias(end))


def alarm_rates(df: DataFrame, alarm: str, label: str, keys: Sequence[str]) -> DataFrame:
    """(keys, normal_alarm_rate, recall): alarms among normal windows and among those before failure."""
    a = F.col(alarm).cast("double")
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(label) == 0, a)).alias("normal_alarm_rate"), F.avg(F.when(F.col(label) == 1, a)).alias("recall"))


def rule_baseline(triggers: DataFrame, horizon: int, key: str = "gun") -> DataFrame:
    """(keys, hits, median_lead, false_triggers) of triggers with their time to the end, ttf."""
    near = F.col("ttf") <= horizon
    per = triggers.groupBy(key).agg(F.max(F.when(near, F.col("ttf"))).alias("lead"), F.count_if(~near).alias("wrong"))
    return per.agg(F.count("*").alias("keys"), F.count("lead").alias("hits"), F.percentile("lead", F.lit(0.5)).alias("median_lead"), F.sum("wrong").alias("false_triggers"))


def policy_grid(df: DataFrame, alarm: str, sustain: Sequence[int], hold: Sequence[int], key: str = "gun", slot: str = "slot") -> DataFrame:
    """(sustain, hold, alarms): runs of alarms at least ``sustain`` slots long, each silencing ``hold`` slots.

    One pass finds the runs; the grid is applied to runs, not to rows.
    """
    on = df.where(F.col(alarm))
    island = F.col(slot) - F.row_number().over(Window.partitionBy(key).orderBy(slot))
    runs = on.withColumn("_i", island).groupBy(key, "_i").agg(F.min(slot).alias("first"), F.count("*").alias("length"))
    grid = runs.withColumn("sustain", F.explode(F.array(*map(F.lit, sustain)))).where("length >= sustain").withColumn("hold", F.explode(F.array(*map(F.lit, hold))))
    before = F.lag(F.col("first") + F.col("length")).over(Window.partitionBy(key, "sustain", "hold").orderBy("first"))
    return grid.withColumn("_free", before.isNull() | (F.col("first") - before >= F.col("hold"))).groupBy("sustain", "hold").agg(F.count_if("_free").alias("alarms"), F.count("*").alias("runs"))


def findings_sweep(df: DataFrame, shares: Sequence[float], deviations: Sequence[float], key: str = "event_id") -> DataFrame:
    """(share_least, deviation_least, median, zero_share): how many findings pass each pair of thresholds."""
    grid = df.withColumn("share_least", F.explode(F.array(*map(F.lit, shares)))).withColumn("deviation_least", F.explode(F.array(*map(F.lit, deviations))))
    passes = (F.col("share") >= F.col("share_least")) & (F.abs("deviation") >= F.col("deviation_least"))
    per = grid.groupBy("share_least", "deviation_least", key).agg(F.count_if(passes).alias("n"))
    return per.groupBy("share_least", "deviation_least").agg(F.percentile("n", F.lit(0.5)).alias("median"), F.avg((F.col("n") == 0).cast("double")).alias("zero_share"))


def permuted(df: DataFrame, value: str, flag: str, key: str, times: int, seed: int = 0) -> DataFrame:
    """(difference, p): flagged less other keys' mean, and how often shuffled flags do as well.

    A shuffle orders the keys by their draws: in each, as many keys are flagged as truly are. Rows are one
    for each key; a shuffle's keys are counted range by range.
    """
    truly = df.agg(F.count_if(F.col(flag)).alias("_m"))
    rows = df.crossJoin(F.broadcast(truly)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(times))))  # one row
    rows = rows.withColumn("_order", F.struct(draw(F.lit(seed), F.col("_i"), F.col(key)).alias("u"), F.col(key).alias("key"))).withColumn("_one", F.lit(1))
    rows = cumulative(rows, "_order", "_one", "_before", ["_i"])
    rows = rows.withColumn("_c", F.when(F.col("_i") == 0, F.col(flag)).otherwise(F.col("_before") < F.col("_m")))
    per = rows.groupBy("_i").agg((F.avg(F.when(F.col("_c"), F.col(value))) - F.avg(F.when(~F.col("_c"), F.col(value)))).alias("d"))
    true = F.max(F.when(F.col("_i") == 0, F.abs("d"))).over(Window.partitionBy(F.lit(1)))
    marked = per.withColumn("_t", true)
    return marked.agg(F.max(F.when(F.col("_i") == 0, F.col("d"))).alias("difference"), ((1 + F.count_if((F.col("_i") > 0) & (F.abs("d") >= F.col("_t")))) / (1 + times)).alias("p"))


def two_sample(df: DataFrame, columns: Sequence[str], label: str, fold: str, folds: int) -> DataFrame:
    """(n_pos, n_neg, auroc) of a logistic regression's scores out of fold: whether two samples can be told apart."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = None
    for f in range(folds):
        steps = [VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z"), LogisticRegression(featuresCol="_z", labelCol=label, regParam=0.01)]
        scored = Pipeline(stages=steps).fit(df.where(F.col(fold) != f)).transform(df.where(F.col(fold) == f))
        part = scored.select(label, F.round(vector_to_array("probability")[1], 9).alias("_s"))
        out = part if out is None else out.unionByName(part)
    return auroc(out, "_s", label)


def detectable(df: DataFrame, score: str, label: str, shifts: Sequence[float]) -> DataFrame:
    """(shift, auroc): what a shift of so many deviations in the positives would be seen as."""
    sd = df.agg(F.stddev_samp(score).alias("_sd"))
    grid = df.crossJoin(F.broadcast(sd)).withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))  # one row
    moved = grid.withColumn("_s", F.col(score) + F.when(F.col(label) == 1, F.col("shift") * F.col("_sd")).otherwise(0.0))
    return auroc(moved, "_s", label, ["shift"]).select("shift", "auroc")


def type_thresholds(df: DataFrame, score: str, kind: str, q: float = 0.99, least: int = 10, key: str = "gun") -> DataFrame:
    """Adds margin: the score less the greater of its type's quantile and the key's own for the type."""
    common = quantiles(df, score, [q], [kind]).select(kind, F.col("quantiles")[0].alias("_all"))
    own = quantiles(df, score, [q], [key, kind]).select(key, kind, F.col("quantiles")[0].alias("_own"), F.col("n").alias("_n")).where(F.col("_n") >= least)
    j = same_keys(same_keys(df, common, [kind]), own, [key, kind], "left")
    return j.withColumn("margin", F.col(score) - F.greatest("_all", F.coalesce("_own", "_all"))).drop("_all", "_own", "_n")


def pseudo_events(events: DataFrame, real: DataFrame, low: int, high: int, apart: int, key: str = "gun", time: str = "t", seed: int = 0) -> DataFrame:
    """Events moved ``low`` to ``high`` earlier by a draw, kept if more than ``apart`` from every real one."""
    shift = F.lit(low) + F.floor(draw(F.lit(seed), F.col(key), F.col(time)) * (high - low))
    moved = events.withColumn("shifted", F.col(time) - shift)
    both = moved.select(key, F.col("shifted").alias(time), F.col(time).alias("_of"), F.lit(False).alias("_real")).unionByName(real.select(key, time, F.lit(None).cast("long").alias("_of"), F.lit(True).alias("_real")))
    near = since_and_until(both, F.col("_real"), key, time)
    free = ~F.coalesce(F.col("since") <= apart, F.lit(False)) & ~F.coalesce(F.col("until") <= apart, F.lit(False))
    return near.where(~F.col("_real") & free).select(key, time, F.col("_of").alias("original"))


def separation(df: DataFrame, score: str, flag: Column, before: int, far: int, quiet: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(n_pos, n_neg, auroc): rows at most ``before`` ahead of an event against rows more than ``far`` ahead,
    none of them within ``quiet`` after one (X8)."""
    rows = since_and_until(df, flag, key, time)
    calm = F.coalesce(F.col("since") > quiet, F.lit(True))
    label = F.when(calm & (F.col("until") <= before), 1).when(calm & F.coalesce(F.col("until") > far, F.lit(True)), 0)
    return auroc(rows.withColumn("_y", label), score, "_y")


def watch_rule(alerts: DataFrame, failures: DataFrame, low: int, high: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(alerts, precision, failures, recall): alerts followed by a failure in (low, high]."""
    rows = alerts.select(key, time, F.lit(0).alias("_f")).unionByName(failures.select(key, time, F.lit(1).alias("_f")))
    w = Window.partitionBy(key).orderBy(time)
    ahead = w.rangeBetween(low + 1, high)
    behind = w.rangeBetween(-high, -(low + 1))
    r = rows.withColumn("_hit", F.coalesce(F.max(F.when(F.col("_f") == 1, 1)).over(ahead), F.lit(0))).withColumn("_seen", F.coalesce(F.max(F.when(F.col("_f") == 0, 1)).over(behind), F.lit(0)))
    return r.agg(
        F.count_if(F.col("_f") == 0).alias("alerts"),
        F.avg(F.when(F.col("_f") == 0, F.col("_hit"))).alias("precision"),
        F.count_if(F.col("_f") == 1).alias("failures"),
        F.avg(F.when(F.col("_f") == 1, F.col("_seen"))).alias("recall"),
    )


def after_event_features(df: DataFrame, events: DataFrame, column: str, span: int, least: int, width: int, key: str = "gun", time: str = "t", event: str = "event_id") -> DataFrame:
    """(event_id, n, mean): over (e, e + span], with at least so many rows."""
    spans = events.select(key, event, (F.col(time) + 1).alias("start_t"), (F.col(time) + span + 1).alias("end_t"))
    found = interval_join(df.select(key, time, column), spans, width, key, time)
    return found.groupBy(event).agg(F.count(column).alias("n"), F.avg(column).alias("mean")).where(F.col("n") >= least)


def beats_placebos(df: DataFrame, real: str, placebo: str, least: int = 8, key: str = "gun") -> DataFrame:
    """(keys, better, expected): keys whose real value exceeds every one of their placebos (X11)."""
    per = df.groupBy(key).agg(F.max(real).alias("_r"), F.max(placebo).alias("_p"), F.count(placebo).alias("_k")).where(F.col("_k") >= least)
    return per.agg(F.count("*").alias("keys"), F.count_if(F.col("_r") > F.col("_p")).alias("better"), F.sum(1 / (F.col("_k") + 1)).alias("expected"))


def horizon_table(df: DataFrame, score: str, threshold: float, edges: Sequence[int], shifts: Sequence[int], ttf: str = "ttf") -> DataFrame:
    """(shift, bin, n, mean_score, alarm_rate): by time to the end, and the same for shifted ends as placebos."""
    from gaugeworks.operators.prep import horizon_bin

    grid = df.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("bin", horizon_bin(F.col(ttf) - F.col("shift"), edges))
    return grid.where("bin is not null").groupBy("shift", "bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg((F.col(score) >= threshold).cast("double")).alias("alarm_rate"))


def block_missing(df: DataFrame, flag: Column, length: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, block, missing_rate): of blocks of ``length`` rows, counted back from the key's end."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))
    rows = df.withColumn("block", F.floor((n - 1) / length))
    return rows.groupBy(key, "block").agg(F.avg(flag.cast("double")).alias("missing_rate"), F.count("*").alias("n")).where(F.col("n") == length).drop("n")


def last_of_kinds(df: DataFrame, kinds: Sequence[str], at: Column, key: str = "gun", time: str = "t", code: str = "code") -> DataFrame:
    """Rows where ``at`` holds, with the time since the last row of each kind strictly before."""
    w = ordered(key, time).rowsBetween(Window.unboundedPreceding, -1)
    lags = {f"since_{k}": F.col(time) - F.max(F.when(F.col(code) == k, F.col(time))).over(w) for k in kinds}
    return df.withColumn("_at", at).withColumns(lags).where("_at").drop("_at")


def forecast_origins(df: DataFrame, context: int, horizon: int, per_stratum: int, stratum: str, seed: int = 0, segment: str = "segment_id", key: str = "gun", time: str = "t") -> DataFrame:
    """Rows with ``context`` rows before and ``horizon`` after in their segment, some of each stratum by draw.

    Key and time tell rows apart.
    """
    w = Window.partitionBy(key, segment)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(time))).withColumn("_n", F.count("*").over(w))
    fit = rows.where((F.col("_i") >= context) & (F.col("_n") - F.col("_i") >= horizon))
    fit = fit.withColumn("_order", F.struct(draw(F.lit(seed), F.col(key), F.col(time)).alias("u"), F.col(key).alias("k"), F.col(time).alias("t"))).withColumn("_one", F.lit(1))
    return cumulative(fit, "_order", "_one", "_p", [stratum]).where(F.col("_p") < per_stratum).drop("_i", "_n", "_p", "_order", "_one")


def moment_of(ticks: DataFrame, rows: DataFrame, value: str, before: int, after: int, width: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, tick, at, value): the row of greatest value from ``before`` to ``after`` of each tick, the earliest of equals."""
    spans = ticks.select(key, F.col(time).alias("tick"), (F.col(time) - before).alias("start_t"), (F.col(time) + after + 1).alias("end_t"))
    found = interval_join(rows.select(key, time, value), spans, width, key, time)
    best = F.max(F.struct(F.col(value), (-F.col(time)).alias("_neg")))
    return found.groupBy(key, "tick").agg(best.alias("_b")).select(key, "tick", (-F.col("_b._neg")).alias("at"), F.col(f"_b.{value}").alias(value))


def unusual_rate(df: DataFrame, value: str, band: str, normal: Column, q: float = 0.95, least: int = 60, key: str = "gun") -> DataFrame:
    """(band, n, unusual): rows over their key's own quantile of normal rows, keys with enough of those."""
    x = F.when(normal, F.col(value))
    own = df.groupBy(key).agg(F.percentile(x, F.lit(q)).alias("_q"), F.count(x).alias("_n")).where(F.col("_n") >= least)
    return df.join(own, key).groupBy(band).agg(F.count("*").alias("n"), F.avg((F.col(value) > F.col("_q")).cast("double")).alias("unusual"))


def pooled_runs(df: DataFrame, value: str, run: str, key: str = "gun") -> DataFrame:
    """(mean, keys): each key's mean over runs, then the mean over keys."""
    own = df.groupBy(key, run).agg(F.avg(value).alias("_v")).groupBy(key).agg(F.avg("_v").alias("_m"))
    return own.agg(F.avg("_m").alias("mean"), F.count("*").alias("keys"))


def classified_events(df: DataFrame, codes: Sequence[str], wait: int, horizon: int, key: str = "gun", time: str = "t") -> DataFrame:
    """Onsets of codes after a cooldown, each a hit (within ``horizon`` of its key's end) or false."""
    from gaugeworks.operators.alarms import triggers

    end = df.groupBy(key).agg(F.max(time).alias("_end"))
    fired = triggers(df, codes, wait, 0, key, time).join(end, key)
    return fired.withColumn("outcome", F.when(F.col("_end") - F.col(time) <= horizon, "hit").otherwise("false")).drop("_end", "repeat")


def crossover_odds(zones: DataFrame, exposures: dict[str, Column], stratum: str = "gun", day: str = "day") -> DataFrame:
    """(exposure, odds_ratio, n_strata): a failure's own zone against the same hours of days before."""
    from gaugeworks.operators.stats import matched_odds

    out = None
    for name, flag in exposures.items():
        rows = zones.select(stratum, (F.col(day) == 0).cast("int").alias("case"), flag.cast("int").alias("exposed"))
        part = matched_odds(rows, stratum, "case", "exposed").withColumn("exposure", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def surprise(df: DataFrame, error: str, calm: Column, key: str = "gun") -> DataFrame:
    """Adds surprise: a forecast's error as a robust z of the key's calm rows; null without spread."""
    q = F.col("quantiles")
    base = quantiles(df.where(calm), error, [0.25, 0.5, 0.75], [key]).select(key, q[1].alias("_m"), ((q[2] - q[0]) / 1.349).alias("_s"))
    return same_keys(df, base, [key], "left").withColumn("surprise", F.try_divide(F.col(error) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def short_event_windows(windows: DataFrame, events: DataFrame, width: int, key: str = "gun", start: str = "w_start", time: str = "t") -> DataFrame:
    """Adds short_event: some event begins in [start, start + width); windows lie on the grid of ``width``."""
    hit = events.select(key, (F.floor(F.col(time) / width) * width).alias(start)).distinct().withColumn("short_event", F.lit(True))
    return windows.join(hit, [key, start], "left").withColumn("short_event", F.coalesce("short_event", F.lit(False)))


def onset_quantiles(df: DataFrame, onset: Column, ttf: str = "ttf", q: Sequence[float] = (0.1, 0.5, 0.9), key: str = "gun") -> DataFrame:
    """(keys, quantiles): of each key's first onset, how long before its end it was."""
    first = df.where(onset).groupBy(key).agg(F.max(ttf).alias("_t"))
    return first.agg(F.count("*").alias("keys"), F.percentile("_t", F.array(*map(F.lit, q))).alias("quantiles"))


def after_power_on(df: DataFrame, column: str, on: Column, span: int, controls: int, day: int, width: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, at, shift, n, mean): ``column`` in [on, on + span) and at the same time of the days before."""
    starts = df.where(on).select(key, F.col(time).alias("at"))
    spans = starts.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(controls))))
    spans = spans.select(key, "at", "shift", (F.col("at") - F.col("shift") * day).alias("start_t"), (F.col("at") - F.col("shift") * day + span).alias("end_t"))
    found = interval_join(df.select(key, time, column), spans, width, key, time)
    return found.groupBy(key, "at", "shift").agg(F.count(column).alias("n"), F.avg(column).alias("mean"))


def phase_z(df: DataFrame, column: str, before: Column, fault: Column, key: str = "gun") -> DataFrame:
    """(key, z): the mean in the fault phase as a z-score of the phase before it."""
    a, b = F.when(before, F.col(column)), F.when(fault, F.col(column))
    return df.groupBy(key).agg(F.try_divide(F.avg(b) - F.avg(a), F.stddev_samp(a)).alias("z"))


def card_scores(cards: DataFrame, gold: DataFrame, key: str = "case_id", label: str = "label", most: int = 5) -> DataFrame:
    """(key, precision, recall) of a case's first cards; a card is relevant if any of its labels is gold.

    ``cards`` has an array ``labels`` and a place; recall is the share of gold labels that they cover.
    """
    top = cards.where(F.col("place") <= most).select(key, "place", F.explode_outer("labels").alias(label))
    hit = top.join(gold.select(key, label).distinct().withColumn("_g", F.lit(True)), [key, label], "left")
    per = hit.groupBy(key).agg(F.count_distinct(F.when(F.col("_g"), F.col("place"))).alias("_r"), F.count_distinct("place").alias("_n"), F.count_distinct(F.when(F.col("_g"), F.col(label))).alias("_c"))
    size = gold.groupBy(key).agg(F.count_distinct(label).alias("_all"))
    j = size.join(per, key, "left").fillna(0, ["_r", "_n", "_c"])
    return j.select(key, F.try_divide("_r", "_n").alias("precision"), F.try_divide("_c", "_all").alias("recall"))
