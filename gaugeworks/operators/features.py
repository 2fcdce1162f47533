"""Windows and trailing frames over readings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import draw
from gaugeworks.operators.intervals import ordered


def tumbling(df: DataFrame, width: int, columns: Sequence[str], key: str = "gun", time: str = "t", segment: str | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """Clock-aligned windows: n, and mean and std (ddof 1, 0 for one row) of each column."""
    keys = [key, *([segment] if segment else [])]
    start = (F.floor(F.col(time) / width) * width).alias("w_start")
    stats = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    return df.groupBy(*keys, start).agg(F.count("*").alias("n"), *stats, *more)


def enough(windows: DataFrame, rows: int) -> DataFrame:
    """Windows of at least max(2, rows // 2) rows (A2)."""
    return windows.where(F.col("n") >= max(2, rows // 2))


def trailing(key: str, time: str, span: int) -> Window:
    """The frame (t - span, t] of a key (W1); it runs across segments."""
    return Window.partitionBy(key).orderBy(time).rangeBetween(-(span - 1), 0)


def _over(df: DataFrame, made: Callable[[Callable[[int], Window]], dict[str, Column]], column: str, longest: int, key: str, time: str, chunk: int | None) -> DataFrame:
    """Adds what ``made(frame)`` gives; frame(span) is the trailing frame.

    With ``chunk`` a key's rows are dealt out by spans of so much time, each with a halo: the rows that lie
    less than ``longest`` before it, of which only time and ``column`` are copied. A row is copied once for
    each span its halo meets, so ``chunk`` should not be much below ``longest``.
    """
    if chunk is None:
        return df.withColumns(made(lambda span: trailing(key, time, span)))
    own = df.withColumn("_chunk", F.floor(F.col(time) / chunk))
    reach = F.sequence(F.col("_chunk"), F.floor((F.col(time) + (longest - 1)) / chunk))
    halo = own.select(key, time, column, F.explode(F.slice(reach, 2, F.size(reach))).alias("_chunk"), F.lit(True).alias("_copy"))
    rows = own.withColumn("_copy", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    rows = rows.withColumns(made(lambda span: Window.partitionBy(key, "_chunk").orderBy(time).rangeBetween(-(span - 1), 0)))
    return rows.where(~F.col("_copy")).drop("_chunk", "_copy")


def rolling(df: DataFrame, span: int, column: str, key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds n, sum and mean of ``column`` over (t - span, t]. ``chunk`` splits a key's rows by time, with the same result."""

    def made(frame: Callable[[int], Window]) -> dict[str, Column]:
        w = frame(span)
        return {f"{column}_n": F.count(column).over(w), f"{column}_sum": F.sum(column).over(w), f"{column}_avg": F.avg(column).over(w)}

    return _over(df, made, column, span, key, time, chunk)


def lookback(df: DataFrame, column: str, spans: Sequence[int], key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds the trailing mean over each span, its difference to the longest, and the std over the middle one.

    ``chunk`` splits a key's rows by time, with the same result.
    """

    def made(frame: Callable[[int], Window]) -> dict[str, Column]:
        spread = F.stddev_samp(column).over(frame(spans[len(spans) // 2]))
        return {f"{column}_m{i}": F.avg(column).over(frame(s)) for i, s in enumerate(spans)} | {f"{column}_spread": F.coalesce(spread, F.lit(0.0))}

    out = _over(df, made, column, max(spans), key, time, chunk)
    return out.withColumn(f"{column}_drift", F.col(f"{column}_m0") - F.col(f"{column}_m{len(spans) - 1}"))


def fused(df: DataFrame, score: str, span: int, key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds the mean and the greater of a score and its own trailing mean (W3). ``chunk`` splits a key's rows by time, with the same result."""
    out = _over(df, lambda frame: {"_trail": F.avg(score).over(frame(span))}, score, span, key, time, chunk)
    return out.withColumn("fused_mean", (F.col(score) + F.col("_trail")) / 2).withColumn("fused_max", F.greatest(F.col(score), F.col("_trail"))).drop("_trail")


def centred(df: DataFrame, column: str, reference: Column, key: str = "gun") -> DataFrame:
    """Adds ``column``_centred: less the key's mean over the rows of ``reference``."""
    mean = F.avg(F.when(reference, F.col(column))).over(Window.partitionBy(key))
    return df.withColumn(f"{column}_centred", F.col(column) - mean)


def recentred(df: DataFrame, column: str, width: int, least: int, key: str = "gun", time: str = "t") -> DataFrame:
    """Adds ``column``_recentred: less the mean of the key's block before, if that has ``least`` rows."""
    rows = df.withColumn("_block", F.floor(F.col(time) / width))
    before = rows.groupBy(key, (F.col("_block") + 1).alias("_block")).agg(F.avg(column).alias("_mean"), F.count(column).alias("_n"))
    joined = rows.join(before, [key, "_block"], "left")
    shift = F.when(F.col("_n") >= least, F.col("_mean")).otherwise(0.0)
    return joined.withColumn(f"{column}_recentred", F.col(column) - shift).drop("_block", "_mean", "_n")


def residual(df: DataFrame, column: str, program: str, baseline: Column, least: int) -> DataFrame:
    """Adds residual: less the program's mean in the baseline, null if that has fewer than ``least`` rows."""
    base = df.where(baseline).groupBy(program).agg(F.avg(column).alias("_mean"), F.count(column).alias("_n")).where(F.col("_n") >= least)
    return df.join(base, program, "left").withColumn("residual", F.col(column) - F.col("_mean")).drop("_mean", "_n")


def day_index(ttf: Column, key: str = "gun", day: int = 86_400_000_000) -> Column:
    """Days since the key's start, by time to its end."""
    return F.floor((F.max(ttf).over(Window.partitionBy(key)) - ttf) / day)


def every_kth(df: DataFrame, k: int, key: str = "gun", time: str = "t") -> DataFrame:
    """The first row of a key and each k-th after."""
    n = F.row_number().over(ordered(key, time))
    return df.withColumn("_n", n).where((F.col("_n") - 1) % k == 0).drop("_n")


def hashed_sample(df: DataFrame, n: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows, the same for a seed, in the order of draws from ``by`` (O12); each task keeps its own n first rows."""
    return df.orderBy(draw(F.lit(seed), *[F.col(c) for c in by]), *by).limit(n)


def first_in_last(df: DataFrame, flag: Column, last: int, fallback: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, at): the first flagged row in the last ``last`` of a key, else its end less ``fallback``."""
    rows = df.withColumn("_end", F.max(time).over(Window.partitionBy(key)))
    hit = F.min(F.when(flag & (F.col("_end") - F.col(time) <= last), F.col(time)))
    return rows.groupBy(key).agg(F.coalesce(hit, F.max("_end") - fallback).alias("at"))


def quantile_features(df: DataFrame, width: int, column: str, key: str = "gun", time: str = "t", pause: int | None = None) -> DataFrame:
    """Per window: q10, q50, q90, range, and mean and max step between rows, steps over ``pause`` left out."""
    step = F.col(time) - F.lag(time).over(ordered(key, time))
    rows = df.withColumn("_step", F.when(step <= pause, step) if pause is not None else step)
    q = F.percentile(column, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy(key, (F.floor(F.col(time) / width) * width).alias("w_start")).agg(q.alias("_q"), (F.max(column) - F.min(column)).alias("range"), F.avg("_step").alias("step_mean"), F.max("_step").alias("step_max"))
    return out.select(key, "w_start", F.col("_q")[0].alias("q10"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q90"), "range", "step_mean", "step_max")


def series_summary(df: DataFrame, column: str, key: str = "gun", time: str = "t") -> DataFrame:
    """Per key: mean, sd, min, max, last less first, share of zeros, mean absolute step."""
    rows = df.withColumn("_d", F.abs(F.col(column) - F.lag(column).over(ordered(key, time))))
    return rows.groupBy(key).agg(
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("sd"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
        (F.max_by(column, time) - F.min_by(column, time)).alias("rise"),
        F.avg((F.col(column) == 0).cast("double")).alias("zero_share"),
        F.avg("_d").alias("mean_step"),
    )


def minute_document(df: DataFrame, measurements: Sequence[str], states: Sequence[str], setpoints: Sequence[str], scaler: dict[str, tuple[float, float]], width: int, key: str = "gun", time: str = "t", order: Sequence[str] = ()) -> DataFrame:
    """One document per window: measurements by |z| (NaN first, null last), on-shares of states, setpoints.

    ``scaler`` gives mean and deviation of each measurement; one without stands with a null z. Equal |z|
    stand in the order of ``measurements``. With ``order`` a window's doubles are added up in the order of
    these columns, whatever files or tasks its rows lie in: a last bit may decide which |z| is greater.
    """
    start = (F.floor(F.col(time) / width) * width).alias("w_start")
    totals = {"n_samples": F.count("*")} | {f"_m_{c}": F.avg(c) for c in measurements} | {f"_s_{c}": F.avg((F.col(c) > 0).cast("double")) for c in states}
    totals |= {name: x for c in setpoints for name, x in ((f"_p_{c}", F.avg(c)), (f"_d_{c}", F.stddev_samp(c)))}
    if order:
        # a running total at a window's last row; partial sums of a groupBy would be added in no fixed order
        w = Window.partitionBy(key, "w_start").orderBy(*order, *[c for c in measurements if c not in order])
        running = {name: x.over(w.rowsBetween(Window.unboundedPreceding, 0)) for name, x in totals.items()}
        g = df.withColumn("w_start", start).select(key, "w_start", *[x.alias(name) for name, x in running.items()], F.lead(F.lit(True)).over(w).alias("_more")).where("_more is null")
    else:
        g = df.groupBy(key, start).agg(*[x.alias(name) for name, x in totals.items()])
    g = g.withColumns({f"_d_{c}": F.coalesce(F.col(f"_d_{c}"), F.lit(0.0)) for c in setpoints})

    def z(c: str) -> Column:
        mean, std = scaler.get(c, (None, None))
        return (F.col(f"_m_{c}") - mean) / std if std else F.lit(None).cast("double")

    items = [F.struct(F.when(F.isnan(z(c)), float("-inf")).otherwise(F.coalesce(-F.abs(z(c)), F.lit(1.0))).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("feature"), z(c).alias("z"), F.col(f"_m_{c}").alias("value")) for i, c in enumerate(measurements)]
    ordered_items = F.transform(F.sort_array(F.array(*items)), lambda x: F.struct(x["feature"].alias("feature"), x["z"].alias("z"), x["value"].alias("value")))
    state = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(f"_s_{c}").alias("on_share")) for c in states])
    setpoint = F.array(*[F.struct(F.lit(c).alias("setpoint"), F.col(f"_p_{c}").alias("mean"), F.col(f"_d_{c}").alias("std")) for c in setpoints])
    return g.select(key, "w_start", "n_samples", ordered_items.alias("measurements"), state.alias("states"), setpoint.alias("setpoints"))


def with_pairwise_fill(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], key: str = "gun", time: str = "t") -> DataFrame:
    """``left`` with the right side's columns of the same keys, filled forward within a key."""
    j = left.join(right.select(*keys, *columns), list(keys), "left")
    w = ordered(key, time).rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
