"""Statistics, detection metrics and comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import draw
from gaugeworks.operators.intervals import ordered
from gaugeworks.operators.staging import staged


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal keys, null with null; without keys ``b`` has one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row
    other = b.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return a.join(other, on, how).drop(*[f"_of_{k}" for k in keys])


def cumulative(df: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows of a key with smaller ``order``, which is distinct in it.

    Rows are dealt out in ranges of (keys, order), so a key of any size is split. The ranges are numbered
    in a table that is written once: what is read twice later has the same numbers. Each range's total is
    added to those after it; of these totals there are as many as keys and ranges together. ``total``
    names a further column for the sum over the whole key.
    """
    part = df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id())
    rows = staged(part, "ranges")
    ends = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_range_sum"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_range", F.coalesce(F.sum("_range_sum").over(before), F.lit(0)).alias("_ranges_before"), F.sum("_range_sum").over(of_key).alias("_range_all"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_range_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = same_keys(rows, ends, [*keys, "_range"]).withColumn(name, F.col("_ranges_before") + F.col("_range_in"))
    if total:
        out = out.withColumn(total, F.col("_range_all"))
    return out.drop("_range", "_range_in", "_ranges_before", "_range_all")


def ranked(df: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score, n, rank, all): distinct scores with their average rank, and the key's rows.

    Ranks come from counts of distinct values, which are added up range by range: a value's rows are
    never gathered, and no single task sorts a key.
    """
    n = df.groupBy(*keys, score).agg(F.count("*").alias("n"))
    before = cumulative(n, score, "n", "_below", keys, "all")
    return before.withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2).drop("_below")


def quantiles(df: DataFrame, column: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, quantiles): exact quantiles of each key's values, linear between neighbours.

    n counts the values other than null; a key without any has no row. Without keys there is one row, of
    n 0 and null quantiles if there is no value. The values are counted and
    their counts added up range by range, so a key's values are in no task together.
    """
    n = df.select(*keys, F.col(column).cast("double").alias("_x")).where("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    rows = cumulative(n, "_x", "_n", "_below", keys, "n")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col("_x")))

    ends, values = [], []
    for i, q in enumerate(shares):
        place = F.lit(float(q)) * (F.col("n") - 1)
        ends += [at(F.floor(place)).alias(f"_low{i}"), at(F.ceil(place)).alias(f"_high{i}")]
        values.append(F.col(f"_low{i}") + (place - F.floor(place)) * (F.col(f"_high{i}") - F.col(f"_low{i}")))
    found = rows.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *ends)
    return found.select(*keys, "n", F.array(*values).alias("quantiles"))


def auroc(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), least_pos: int = 1, least_neg: int = 1) -> DataFrame:
    """(keys, n_pos, n_neg, auroc): exact, ties at half; null with fewer rows of a class than asked."""
    n = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    n = cumulative(n, score, "neg", "below", keys)
    out = n.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("_wins"))
    fair = (F.col("n_pos") >= least_pos) & (F.col("n_neg") >= least_neg)
    return out.withColumn("auroc", F.when(fair, F.try_divide("_wins", F.col("n_pos") * F.col("n_neg")))).drop("_wins")


def rank_share(df: DataFrame, score: str, key: str) -> DataFrame:
    """Adds rank_share: rows below plus half the ties, over all rows of the key."""
    n = ranked(df, score, [key]).select(key, score, ((F.col("rank") - 0.5) / F.col("all")).alias("rank_share"))
    return same_keys(df, n, [key, score])


def bh_adjusted(df: DataFrame, p: str = "p", test: str = "test") -> DataFrame:
    """Adds q: Benjamini and Hochberg's adjusted p (W14). One row a test: tests are few."""
    up = Window.orderBy(F.col(p), test)
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    raw = df.withColumn("_raw", F.col(p) * m / F.row_number().over(up))
    down = Window.orderBy(F.desc(p), F.desc(test)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_raw")


def holm_adjusted(df: DataFrame, p: str = "p", test: str = "test") -> DataFrame:
    """Adds p_holm: Holm's step-down adjusted p."""
    up = Window.orderBy(F.col(p), test)
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    raw = df.withColumn("_raw", F.col(p) * (m - F.row_number().over(up) + 1))
    return raw.withColumn("p_holm", F.least(F.max("_raw").over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_raw")


def matched_odds(df: DataFrame, stratum: str, case: str, exposed: str) -> DataFrame:
    """(odds_ratio, n_strata): Mantel and Haenszel's over strata of one case and its controls."""
    cell = lambda c, e: F.count_if((F.col(case) == c) & (F.col(exposed) == e))
    s = df.groupBy(stratum).agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"), F.count("*").alias("n"))
    ratio = F.try_divide(F.sum(F.col("a") * F.col("d") / F.col("n")), F.sum(F.col("b") * F.col("c") / F.col("n")))
    return s.agg(ratio.alias("odds_ratio"), F.count("*").alias("n_strata"))


def robust(df: DataFrame, column: str, keys: Sequence[str], reference: Column | None = None, least: int = 1, floor: float = 0.1) -> DataFrame:
    """(keys, location, scale): median and 1.4826 MAD; where that is 0, ``floor`` times the deviation."""
    rows = df.where(reference) if reference is not None else df
    rows = rows.select(*keys, F.col(column).cast("double").alias("_v"))
    centre = same_keys(quantiles(rows, "_v", [0.5], keys), rows.groupBy(*keys).agg(F.stddev_samp("_v").alias("_sd")), keys).select(*keys, F.col("quantiles")[0].alias("location"), "_sd", F.col("n").alias("_n"))
    away = same_keys(rows, centre.select(*keys, "location"), keys).withColumn("_away", F.abs(F.col("_v") - F.col("location")))
    spread = quantiles(away, "_away", [0.5], keys).select(*keys, F.col("quantiles")[0].alias("_mad"))
    scale = F.greatest(F.lit(1.4826) * F.col("_mad"), floor * F.col("_sd"))
    return same_keys(centre, spread, keys).select(*keys, "location", F.when(F.col("_n") >= least, scale).alias("scale"))


def iqr_scale(column: str) -> Column:
    """Aggregate: the interquartile range over 1.349, for keys of few values; ``quantiles`` is for many."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    return (q[1] - q[0]) / 1.349


def key_threshold(df: DataFrame, score: str, calibration: Column, overall: float = 0.9, q: float = 0.99, least: int = 10, key: str = "gun") -> DataFrame:
    """(key, threshold): the greater of the quantile ``overall`` of all scores and the key's own ``q``, if it has ``least`` rows (A5)."""
    common = quantiles(df, score, [overall]).select(F.col("quantiles")[0].alias("_common"))
    own = quantiles(df.where(calibration), score, [q], [key]).select(key, F.col("quantiles")[0].alias("_own"), F.col("n").alias("_n"))
    rows = same_keys(df.select(key).distinct(), own, [key], "left").crossJoin(F.broadcast(common))  # one row
    return rows.select(key, F.when(F.col("_n") >= least, F.greatest("_common", "_own")).otherwise(F.col("_common")).alias("threshold"))


def warm_up_stats(df: DataFrame, column: str, span: int, least: int, floor: float, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, n, mean, std): over each key's first ``span``, ddof 0 and floored; null under ``least`` rows (A4)."""
    rows = df.withColumn("_early", F.col(time) < F.min(time).over(Window.partitionBy(key)) + span)
    x = F.when(F.col("_early"), F.col(column))
    s = rows.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std"))
    enough = F.col("n") >= least
    return s.select(key, "n", F.when(enough, F.col("_mean")).alias("mean"), F.when(enough, F.greatest("_std", F.lit(floor))).alias("std"))


def pivot_with_total(df: DataFrame, row: str, column: str, values: Sequence[str], value: str, total: str = "all") -> DataFrame:
    """Means of ``value`` by row and column, and a last row over all rows."""
    cells = [F.avg(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values]
    grouped = df.rollup(row).agg(F.grouping(row).alias("_all"), *cells)
    return grouped.withColumn(row, F.when(F.col("_all") == 1, total).otherwise(F.col(row))).drop("_all")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and column, 0 where there is none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def column_statistics(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row for each key and column: n, zero_share, distinct, mean, std, min, p01, p50, p99, max."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "column", "x")
    by = [*keys, "column"]
    n = long.groupBy(*by, "x").agg(F.count("*").alias("_n"))  # values are counted first: few rows reach the rest
    x, w = F.col("x"), F.when(F.col("x").isNotNull(), F.col("_n")).otherwise(0)
    sums = n.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(F.when(x == 0, F.col("_n")).otherwise(0)).alias("_zeros"), F.count("x").alias("distinct"), (F.sum(x * F.col("_n")) / F.sum(w)).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))
    away = same_keys(n, sums.select(*by, F.col("mean").alias("_mean")), by).groupBy(*by).agg(F.sum((x - F.col("_mean")) ** 2 * F.col("_n")).alias("_squares"))
    out = same_keys(same_keys(sums, away, by), quantiles(long, "x", [0.01, 0.5, 0.99], by).drop("n"), by, "left")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1)))
    p = [F.col("quantiles")[i].alias(f"p{q}") for i, q in enumerate(("01", "50", "99"))]
    return out.select(*by, "n", F.try_divide("_zeros", "n").alias("zero_share"), "distinct", "mean", std.alias("std"), "low", *p, "high")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of columns: one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    long = row.unpivot([], row.columns, "_pair", "r")
    return long.select(F.split("_pair", "~")[0].alias("a"), F.split("_pair", "~")[1].alias("b"), "r")


def smallest_mode(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(keys, mode): the most frequent value, the smallest of equals."""
    n = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    top = n.groupBy(*keys).agg(F.max("_n").alias("_top"))
    return n.join(top, list(keys)).where(F.col("_n") == F.col("_top")).groupBy(*keys).agg(F.min(column).alias("mode"))


def effect_size(df: DataFrame, column: str, flag: Column) -> DataFrame:
    """(effect): the difference of means over the pooled deviation, ddof 1."""
    a, b = F.when(~flag, F.col(column)), F.when(flag, F.col(column))
    return df.agg(F.try_divide(F.avg(b) - F.avg(a), F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)).alias("effect"))


def median_of_medians(df: DataFrame, column: str, group: str, key: str = "gun") -> DataFrame:
    """(group, value): the median over keys of each key's median, so that every key counts once."""
    own = quantiles(df, column, [0.5], [group, key]).select(group, F.col("quantiles")[0].alias("_m"))
    return quantiles(own, "_m", [0.5], [group]).select(group, F.col("quantiles")[0].alias("value"))


def repeat_period(df: DataFrame, code: str, longest: int, slack: float = 0.05, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, period, match): the smallest period of a code sequence within ``slack`` of its best match."""
    w = ordered(key, time)
    lags = F.array(*[F.struct(F.lit(p).alias("period"), (F.col(code) == F.lag(code, p).over(w)).alias("same")) for p in range(1, longest + 1)])
    rows = df.select(key, lags.alias("_lags")).select(key, F.explode("_lags").alias("_l")).where("_l.same is not null")
    m = rows.groupBy(key, F.col("_l.period").alias("period")).agg(F.avg(F.col("_l.same").cast("double")).alias("match"))
    best = m.groupBy(key).agg(F.max("match").alias("_best"))
    return m.join(best, key).where(F.col("match") >= F.col("_best") - slack).groupBy(key).agg(F.min_by("match", "period").alias("match"), F.min("period").alias("period"))


def physical_identity(df: DataFrame, parts: Sequence[tuple[str, int]], member: str) -> DataFrame:
    """(identity, members): keys of rounded constants that several members share."""
    from gaugeworks.operators.prep import program_key

    keyed = df.select(member, program_key(*[(F.col(c), n) for c, n in parts]).alias("identity")).distinct()
    return keyed.groupBy("identity").agg(F.count("*").alias("members"), F.min(member).alias("first_member")).where("members >= 2")


def rank_sum(df: DataFrame, column: str, flag: str, keys: Sequence[str]) -> DataFrame:
    """(keys, u, z): Mann and Whitney's U of flagged against other rows, and its normal score."""
    a = auroc(df, column, flag, keys)
    n, m = F.col("n_pos"), F.col("n_neg")
    return a.select(*keys, (F.col("auroc") * n * m).alias("u"), F.try_divide((F.col("auroc") - 0.5) * n * m, F.sqrt(n * m * (n + m + 1) / 12.0)).alias("z"))


def rank_correlation(df: DataFrame, a: str, b: str, key: str = "gun") -> DataFrame:
    """(key, rho): Spearman's, with average ranks."""
    for column, rank in ((a, "_ra"), (b, "_rb")):
        df = same_keys(df, ranked(df, column, [key]).select(key, column, F.col("rank").alias(rank)), [key, column])
    return df.groupBy(key).agg(F.corr("_ra", "_rb").alias("rho"))


#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...; beyond the last they are below 1e-9.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(12)]


def resampled(df: DataFrame, value: str, times: int, key: str = "gun", seed: int = 0) -> DataFrame:
    """(resample, mean): each key's weight is a Poisson variable of mean 1, so every resample is a map and a sum.

    Drawing with replacement tends to it. Weights are drawn by ``draw``: repeatable for a seed.
    """
    grid = df.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("_u", draw(F.lit(seed), F.col(key), F.col("resample")))
    weight = reduce(Column.__add__, [(F.col("_u") >= p).cast("int") for p in POISSON])
    return grid.withColumn("_w", weight).groupBy("resample").agg(F.try_divide(F.sum(F.col(value) * F.col("_w")), F.sum("_w")).alias("mean"))


def interval(resamples: DataFrame, value: str = "mean") -> DataFrame:
    """(low, high): the percentiles 2.5 and 97.5."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return resamples.agg(q.alias("_q")).select(F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def stratified_folds(df: DataFrame, member: str, stratum: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: distinct members of a stratum dealt out in the order of their draws."""
    rows = df.withColumn("_order", F.struct(draw(F.lit(seed), F.col(member)).alias("u"), F.col(member).alias("m"))).withColumn("_one", F.lit(1))
    return cumulative(rows, "_order", "_one", "_before", [stratum]).withColumn("fold", F.col("_before") % k).drop("_order", "_one", "_before")


def joined_folds(df: DataFrame, member: str, group: str, fold: str = "fold") -> DataFrame:
    """Moves all members of a group to the fold of its first member."""
    first = df.groupBy(group).agg(F.min_by(fold, member).alias("_first"))
    return same_keys(df, first, [group]).withColumn(fold, F.col("_first")).drop("_first")


def forecast_errors(df: DataFrame, actual: str, forecast: str, keys: Sequence[str]) -> DataFrame:
    """(keys, mae, mape, marre, mse); MAPE over actual values other than 0."""
    error = F.abs(F.col(actual) - F.col(forecast))
    return df.groupBy(*keys).agg(
        F.avg(error).alias("mae"),
        F.avg(F.when(F.col(actual) != 0, error / F.abs(actual))).alias("mape"),
        F.try_divide(F.avg(error), F.max(actual) - F.min(actual)).alias("marre"),
        F.avg(error * error).alias("mse"),
    )


def micro_average(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, precision, recall) of summed tp, fp, fn; null where there is nothing to divide by."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return df.groupBy(*keys).agg(F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))


def claim_scores(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, precision, recall, f1) of claims, each guarded by 1e-8."""
    tp, fp, fn, e = F.sum("tp"), F.sum("fp"), F.sum("fn"), 1e-8
    p, r = tp / (tp + fp + e), tp / (tp + fn + e)
    return df.groupBy(*keys).agg(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + e)).alias("f1"))


def best_within(df: DataFrame, value: str, cost: str, budget: float, pick: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The row of greatest ``value`` whose ``cost`` is within the budget, for each key."""
    chosen = F.max_by(F.struct(*pick, value, cost), F.struct(F.col(value), *[F.col(p) for p in pick]))
    return df.where(F.col(cost) <= budget).groupBy(*keys).agg(chosen.alias("_c")).select(*keys, "_c.*")


def judged(a: DataFrame, b: DataFrame, noise: float, margin: float = 0.0, ratio: float = 1.2, most: float = 24.0, gates: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Checks of a challenger ``b`` against a champion ``a`` (one row each), and the decision.

    Columns auroc, hits, fa (false alarms a day), ew, and on ``b`` better and common: files on which it
    is at least as good, of those both have. Checks: gain over margin * noise; a majority; warnings and
    no fewer hits; false alarms at most ``ratio`` times; and at most ``most``. ``gates`` must all hold.
    """
    j = a.select(*[F.col(c).alias(f"a_{c}") for c in ("auroc", "hits", "fa")]).crossJoin(b)  # one row each
    checks = [
        F.col("auroc") - F.col("a_auroc") > margin * noise + 1e-12,
        F.col("better") * 2 > F.col("common"),
        F.col("ew") & (F.col("hits") >= F.col("a_hits")),
        F.col("fa") <= ratio * F.col("a_fa") + 1e-12,
        F.col("fa") <= most,
    ]
    out = j.select(*[F.coalesce(c, F.lit(False)).alias(f"check{i}") for i, c in enumerate(checks, 1)])
    all_gates = F.lit(True)
    for g in gates:
        all_gates = all_gates & F.col(f"check{g}")
    return out.withColumn("promote", all_gates)


def verdicts(windows: DataFrame, spans: DataFrame, width: int, key: str = "gun", start: str = "w_start") -> DataFrame:
    """Adds confirmed and false_alarm: whether a window lies in a span of that outcome.

    Spans (key, start_t, end_t, outcome) are floored to whole windows and half-open.
    """
    floored = spans.select(key, (F.floor(F.col("start_t") / width) * width).alias("_s"), (F.floor(F.col("end_t") / width) * width).alias("_e"), "outcome")
    covered = floored.where(F.col("_e") > F.col("_s")).select(key, "outcome", F.explode(F.sequence(F.col("_s"), F.col("_e") - width, F.lit(width).cast("long"))).alias(start))
    hit = covered.groupBy(key, start).agg(F.bool_or(F.col("outcome") == "confirmed").alias("confirmed"), F.bool_or(F.col("outcome") == "false_alarm").alias("false_alarm"))
    out = windows.join(hit, [key, start], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("confirmed", "false_alarm")})


def paired_difference(df: DataFrame, a: str, b: str, times: int, key: str = "gun", seed: int = 0) -> DataFrame:
    """(low, high) of the mean of a - b over resamples that both share."""
    own = df.groupBy(key).agg((F.avg(a) - F.avg(b)).alias("_d"))
    return interval(resampled(own, "_d", times, key, seed))


def shadow_files(files: DataFrame, *trained: DataFrame, file: str = "file") -> DataFrame:
    """Files that none of the models was trained on."""
    for t in trained:
        files = files.join(t.select(file), file, "left_anti")
    return files
