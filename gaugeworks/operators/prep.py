"""Preparation of readings: last arrival wins, gap filling, carry, derived columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.intervals import by_chunk, earlier_chunks, ordered, up_to_here

#: Terminal controller codes and the fault class of each.
TERMINAL = {"E012": "E01", "E016": "E02", "E028": "E03", "E029": "E04"}
#: Channels that a non-welding row does not measure (counters c11 and c12 go on).
CARRIED = tuple(f"c{i}" for i in (*range(1, 10), *range(13, 20))) + ("c10",)


def last_arrival(df: DataFrame, arrival: str, key: str = "gun", time: str = "t") -> DataFrame:
    """One row for each key and time: the one that arrived last."""
    names = [c for c in df.columns if c not in (key, time)]
    best = df.groupBy(key, time).agg(F.max_by(F.struct(*names), F.col(arrival)).alias("_row"))
    return best.select(key, time, "_row.*").select(*df.columns)


def fill_gaps(df: DataFrame, step: int, limit: int | None, key: str = "gun", time: str = "t") -> DataFrame:
    """Rows on a grid of ``step``: gaps of at most ``limit`` missing slots are filled forward.

    A longer gap is left whole and the segment ends; ``limit`` None fills all, 0 none. Adds filled (a
    made-up row) and segment_id. Nothing is made up for a gap that is left, so no full grid is built.
    """
    nxt = F.lead(time).over(ordered(key, time))
    missing = F.coalesce(((nxt - F.col(time)) / step).cast("long") - 1, F.lit(0))
    fits = missing if limit is None else F.when(missing <= limit, missing).otherwise(0)
    rows = df.withColumn("_fits", F.greatest(fits, F.lit(0)).cast("long"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_fits"))).alias("_i")).drop("_fits").withColumn("filled", F.col("_i") > 0).withColumn(time, F.col(time) + F.col("_i") * step).drop("_i")
    gap = F.coalesce(F.col(time) - F.lag(time).over(ordered(key, time)) > step, F.lit(False))
    return rows.withColumn("_new", gap.cast("int")).withColumn("segment_id", F.sum("_new").over(up_to_here(ordered(key, time)))).drop("_new")


def missing_rate(df: DataFrame, step: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, missing_rate): the share of slots between first and last without a row."""
    slot = F.floor(F.col(time) / step)
    return df.groupBy(key).agg((1 - F.count_distinct(slot) / (F.max(slot) - F.min(slot) + 1)).alias("missing_rate"))


def non_welding(c16: Column, low: float = 0.0, high: float | None = None) -> Column:
    """At or under ``low``, or over ``high`` where given."""
    return (c16 <= low) | (c16 > high) if high is not None else c16 <= low


def carry(df: DataFrame, blank: Column, columns: Sequence[str], key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """``columns`` are blanked where ``blank``, then filled forward, and the head backward.

    Whatever must see the measured values (P4) is computed before. ``chunk`` splits the work of a key into spans of
    so much time, with the same result; times are not null then.
    """
    w = ordered(key, time)
    named = {c: F.when(~blank, F.col(c)) for c in columns}
    rows = df.withColumns({f"_{c}": e for c, e in named.items()})
    if chunk is not None:
        at = {c: F.when(F.col(f"_{c}").isNotNull(), F.col(time)) for c in columns}
        later = Window.partitionBy(key).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
        ends = {f"_{c}_{n}": f(f"_{c}", at[c]) for c in columns for n, f in (("first", F.min_by), ("last", F.max_by))}
        carried = {f"_{c}_before": F.last(f"_{c}_last", ignorenulls=True).over(earlier_chunks(key)) for c in columns}
        carried |= {f"_{c}_after": F.first(f"_{c}_first", ignorenulls=True).over(later) for c in columns}
        rows = by_chunk(rows.withColumn("_chunk", F.floor(F.col(time) / chunk)), key, ends, carried)
        w = Window.partitionBy(key, "_chunk").orderBy(time)
        ahead = w.rowsBetween(0, Window.unboundedFollowing)
        held = {c: F.coalesce(F.last(f"_{c}", ignorenulls=True).over(up_to_here(w)), F.col(f"_{c}_before"), F.first(f"_{c}", ignorenulls=True).over(ahead), F.col(f"_{c}_after")) for c in columns}
        return rows.withColumns(held).drop("_chunk", *[f"_{c}" for c in columns], *carried)
    held = {c: F.coalesce(F.last(f"_{c}", ignorenulls=True).over(up_to_here(w)), F.first(f"_{c}", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))) for c in columns}
    return rows.withColumns(held).drop(*[f"_{c}" for c in columns])


def clock(time: Column) -> dict[str, Column]:
    """hour_sin, hour_cos, dow (0 = Monday) of a time in microseconds."""
    minute = F.floor(F.pmod(time, F.lit(86_400_000_000)) / 60_000_000)
    angle = minute * (2 * math.pi / 1440)
    return {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "dow": F.pmod(F.floor(time / 86_400_000_000) + 3, F.lit(7)).cast("int")}


def with_ttf(df: DataFrame, horizon: int, key: str = "gun", time: str = "t") -> DataFrame:
    """Adds ttf (time to the key's last row) and label (at most ``horizon`` of it)."""
    ttf = F.max(time).over(Window.partitionBy(key)) - F.col(time)
    return df.withColumn("ttf", ttf).withColumn("label", (F.col("ttf") <= horizon).cast("int"))


def increments(column: str, key: str = "gun", time: str = "t") -> Column:
    """A counter's step from the row before; none at a key's head, none where it was reset."""
    return F.greatest(F.coalesce(F.col(column) - F.lag(column).over(ordered(key, time)), F.lit(0)), F.lit(0))


def fit_scaler(df: DataFrame, columns: Sequence[str], normal: Column) -> DataFrame:
    """One row: mean and standard deviation of each column over normal rows (A3)."""
    rows = df.where(normal)
    return rows.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def z_scores(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled by a one-row ``scaler`` (P9); a column without spread becomes 0."""
    joined = df.crossJoin(F.broadcast(scaler))  # a row
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")), F.lit(0.0)) for c in columns}
    return joined.withColumns(z).drop(*scaler.columns)


def unscale(z: Column, std: Column, mean: Column, n: int = 1) -> Column:
    """P10: the value, or the sum of n of them, of a z-score."""
    return z * std + n * mean


def terminal_class(code: Column, classes: Mapping[str, str] = TERMINAL) -> Column:
    """The fault class of a terminal code, or null."""
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.try_element_at(table, code)


def horizon_bin(ttf: Column, edges: Sequence[int], closed_right: bool = True) -> Column:
    """Number of the bin that holds ``ttf``: (lo, hi] or [lo, hi) (P13); null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        inside = (ttf > lo) & (ttf <= hi) if closed_right else (ttf >= lo) & (ttf < hi)
        out = F.when(inside, i).otherwise(out)
    return out


def switched(*stds: Column) -> Column:
    """A setpoint switched inside the window: any spread over 1e-6."""
    return F.greatest(*stds) > 1e-6 if len(stds) > 1 else stds[0] > 1e-6


def feature_parts(name: Column) -> tuple[Column, Column]:
    """Sensor and statistic of a feature's name, split at its last underscore."""
    return F.regexp_extract(name, "^(.*)_([^_]*)$", 1), F.regexp_extract(name, "^(.*)_([^_]*)$", 2)


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Drops the columns whose names begin so."""
    return df.select(*[c for c in df.columns if not c.startswith(prefix)])


def program_key(*parts: tuple[Column, int]) -> Column:
    """Rounded values joined by a bar (P20); each part is a column and its digits."""
    return F.concat_ws("|", *[F.round(c, n).cast("string") for c, n in parts])


def inferred_class(df: DataFrame, last: int, key: str = "gun", time: str = "t", code: str = "code", classes: Mapping[str, str] = TERMINAL) -> DataFrame:
    """(key, class): of the terminal code closest to the key's end, within ``last`` of it; null without."""
    rows = df.withColumn("_end", F.max(time).over(Window.partitionBy(key))).withColumn("_class", terminal_class(F.col(code), classes))
    near = F.when((F.col("_end") - F.col(time) <= last) & F.col("_class").isNotNull(), F.col(time))
    return rows.groupBy(key).agg(F.max_by("_class", near).alias("class"))


def refused_chunks(df: DataFrame, limit: int, chunk: str = "chunk", key: str = "gun", time: str = "t") -> DataFrame:
    """(key, chunk, reason): chunks that span more than ``limit``, or end that much before the newest row so far.

    Chunks arrive in the order of ``chunk``; those refused don't move the newest row on.
    """
    c = df.groupBy(key, chunk).agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    c = c.withColumn("_wide", F.col("_to") - F.col("_from") > limit)
    newest = F.max(F.when(~F.col("_wide"), F.col("_to"))).over(Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(F.col("_wide"), "span").when(F.col("_to") < newest - limit, "clock went back")
    return c.select(key, chunk, reason.alias("reason")).where("reason is not null")


def sample_time(explicit: Column, code_time: Column, end: Column, before: Column) -> Column:
    """The time to sample: one given, else when the code began, else so long before the end."""
    return F.coalesce(explicit, code_time, end - before)


def clock_slots(start: Column, end: Column, step: int, least: int = 3, most: int = 60) -> Column:
    """Whole steps of a window, or null if it is not of whole steps or has fewer or more than allowed."""
    n = (end - start) / step
    fits = (n == F.floor(n)) & n.between(least, most)
    return F.when(fits, F.sequence(start, end - step, F.lit(step).cast("long")))


def normal_rows(df: DataFrame, label: str = "label", error: str = "error_active", rest: str | None = None) -> DataFrame:
    """Rows before no failure, without an error, and welding where ``rest`` is given."""
    keep = (F.col(label) == 0) & (F.col(error) == 0)
    return df.where(keep & (F.col(rest) == 0) if rest else keep)


def clean_windows(df: DataFrame, error: str = "error_active", rest: str = "non_welding") -> DataFrame:
    """Windows without an error of which at most half is at rest."""
    return df.where((F.col(error) == 0) & (F.col(rest) <= 0.5))


def carried_code(df: DataFrame, code: str = "code", none: str = "0", key: str = "gun", time: str = "t") -> DataFrame:
    """The code of a missing row is that of the last row with one, and ``none`` before the first."""
    held = F.last(code, ignorenulls=True).over(up_to_here(ordered(key, time)))
    return df.withColumn(code, F.coalesce(held, F.lit(none)))


def offsets(df: DataFrame, slot: str, key: str = "event_id") -> DataFrame:
    """Adds offset: 0 at a window's last slot, -1 before it, and so on."""
    return df.withColumn("offset", (F.col(slot) - F.max(slot).over(Window.partitionBy(key))).cast("int"))


def weld_rate(df: DataFrame, counter: str, slot: int, unit: int, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, rate): the median of a counter's positive sums by slot, in ``unit`` of time."""
    sums = df.groupBy(key, F.floor(F.col(time) / slot).alias("_s")).agg(F.sum(counter).alias("_n")).where("_n > 0")
    return sums.groupBy(key).agg((F.percentile("_n", F.lit(0.5)) * (unit / slot)).alias("rate"))
