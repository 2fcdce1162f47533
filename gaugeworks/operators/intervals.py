"""Gaps, runs, sessions, as-of lookups and interval joins over keyed, timed rows.

Times are whole numbers (microseconds or any other unit); every duration is a parameter in that unit.
Rows of one key are ordered by time and then by ``tie``, so results don't depend on arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: str, time: str, *tie: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time, *tie)


def up_to_here(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _chunked(df: DataFrame, key: str, time: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(time) / chunk))


def by_chunk(df: DataFrame, key: str, more: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Joins to each row what its chunk needs from the other chunks of its key.

    ``more`` are aggregates of a chunk, ``carried`` are windows over these, a row a chunk. So a key of any size is
    in as many tasks as it has chunks; only its chunks' aggregates come together.
    """
    ends = df.groupBy(key, "_chunk").agg(*[c.alias(n) for n, c in more.items()])
    ends = ends.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), *[c.alias(n) for n, c in carried.items()])
    return df.join(ends, F.col(key).eqNullSafe(F.col("_k")) & F.col("_chunk").eqNullSafe(F.col("_c"))).drop("_k", "_c")


def earlier_chunks(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def row_before(df: DataFrame, parts: Sequence[str], key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds _before: time and ``parts`` of the key's row before, a struct, null at the first.

    ``chunk`` splits the work of a key into spans of so much time; rows of one time go by ``parts`` then.
    """
    here = F.struct(time, *parts)
    if chunk is None:
        return df.withColumn("_before", F.lag(here).over(ordered(key, time)))
    rows = by_chunk(_chunked(df, key, time, chunk), key, {"_last": F.max(here)}, {"_carried": F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk"))})
    w = Window.partitionBy(key, "_chunk").orderBy(time, *parts)
    return rows.withColumn("_before", F.coalesce(F.lag(here).over(w), F.col("_carried"))).drop("_chunk", "_carried")


def held(df: DataFrame, values: dict[str, tuple[Column, str]], key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds columns: a value's last non-null one ``before`` a row or ``upto`` it, or its next one ``after`` it.

    ``values`` gives (value, which) by name; rows of one key have different times. ``chunk`` splits the work of a
    key into spans of so much time, with the same result.
    """
    rows = df.withColumns({f"_v_{n}": v for n, (v, _) in values.items()})
    back = {"before": -1, "upto": 0}
    keys = [key] if chunk is None else [key, "_chunk"]
    w = Window.partitionBy(*keys).orderBy(time)
    found = {n: F.first(f"_v_{n}", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) if which == "after" else F.last(f"_v_{n}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, back[which])) for n, (_, which) in values.items()}
    if chunk is None:
        return rows.withColumns(found).drop(*[f"_v_{n}" for n in values])
    later = Window.partitionBy(key).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    ends, carried = {}, {}
    for n, (_, which) in values.items():
        at = F.when(F.col(f"_v_{n}").isNotNull(), F.col(time))
        ends[f"_e_{n}"] = F.min_by(f"_v_{n}", at) if which == "after" else F.max_by(f"_v_{n}", at)
        carried[f"_c_{n}"] = F.first(f"_e_{n}", ignorenulls=True).over(later) if which == "after" else F.last(f"_e_{n}", ignorenulls=True).over(earlier_chunks(key))
    rows = by_chunk(_chunked(rows, key, time, chunk), key, ends, carried)
    return rows.withColumns({n: F.coalesce(c, F.col(f"_c_{n}")) for n, c in found.items()}).drop("_chunk", *[f"_v_{n}" for n in values], *carried)


def _numbered_in_chunks(df: DataFrame, name: str, parts: Sequence[str], starts: Callable[[Column], Column], key: str, time: str, chunk: int) -> DataFrame:
    """Adds ``name``: how many rows up to here start something. ``starts`` gets the row before, a struct of time and ``parts``."""
    rows = row_before(df, parts, key, time, chunk).withColumn("_new", starts(F.col("_before")).cast("long"))
    rows = by_chunk(_chunked(rows, key, time, chunk), key, {"_sum": F.sum("_new")}, {"_base": F.coalesce(F.sum("_sum").over(earlier_chunks(key)), F.lit(0))})
    w = Window.partitionBy(key, "_chunk").orderBy(time, *parts)
    return rows.withColumn(name, F.col("_base") + F.sum("_new").over(up_to_here(w))).drop("_chunk", "_before", "_new", "_base")


def with_segments(df: DataFrame, limit: int, key: str = "gun", time: str = "t", tie: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """Adds segment_id: rows of a key, numbered anew after every step longer than ``limit`` (T5).

    ``chunk`` splits the work of a key into spans of so much time, with the same result; times are not null then.
    """
    if chunk is not None:
        return _numbered_in_chunks(df, "segment_id", tie, lambda before: F.coalesce(F.col(time) - before[time] > limit, F.lit(False)), key, time, chunk)
    w = ordered(key, time, *tie)
    step = F.col(time) - F.lag(time).over(w)
    return df.withColumn("_new", F.when(step > limit, 1).otherwise(0)).withColumn("segment_id", F.sum("_new").over(up_to_here(w))).drop("_new")


def gap_list(df: DataFrame, limit: int, context: Sequence[str], key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """One row for each step longer than ``limit``, with the columns of ``context`` on either side.

    ``chunk`` splits the work of a key into spans of so much time, with the same result.
    """
    before = [F.col(f"_before.{c}").alias(f"{c}_before") for c in context]
    rows = row_before(df.select(key, time, *context), context, key, time, chunk)
    steps = rows.select(key, F.col(f"_before.{time}").alias("gap_start"), F.col(time).alias("gap_end"), *before, *[F.col(c).alias(f"{c}_after") for c in context])
    return steps.withColumn("gap", F.col("gap_end") - F.col("gap_start")).where(F.col("gap") > limit)


def runs(df: DataFrame, state: str, key: str = "gun", time: str = "t", limit: int | None = None, chunk: int | None = None) -> DataFrame:
    """Maximal runs of equal ``state``: start_t, end_t, duration, n_rows.

    With ``limit``, a step longer than it ends a run too (T15); without, gaps don't. ``chunk`` splits the work of
    a key into spans of so much time, with the same result; times are not null then, and rows of one time
    go by their state.
    """

    def changed(state_before: Column, time_before: Column) -> Column:
        change = ~F.col(state).eqNullSafe(state_before) | time_before.isNull()
        return change if limit is None else change | (F.col(time) - time_before > limit)

    if chunk is not None:
        islands = _numbered_in_chunks(df, "run_id", [state], lambda before: changed(before[state], before[time]), key, time, chunk)
    else:
        w = ordered(key, time)
        change = changed(F.lag(state).over(w), F.lag(time).over(w))
        islands = df.withColumn("_new", change.cast("int")).withColumn("run_id", F.sum("_new").over(up_to_here(w)))
    out = islands.groupBy(key, "run_id").agg(F.first(state).alias(state), F.min(time).alias("start_t"), F.max(time).alias("end_t"), F.count("*").alias("n_rows"))
    return out.withColumn("duration", F.col("end_t") - F.col("start_t"))


def merge_near(df: DataFrame, gap: int, key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Rows more than ``gap`` after the row before, merged or not: events merge in chains.

    ``chunk`` splits the work of a key into spans of so much time, with the same result.
    """
    step = F.col(time) - F.col(f"_before.{time}")
    return row_before(df, [], key, time, chunk).where(F.col("_before").isNull() | (step > gap)).drop("_before")


def with_sessions(df: DataFrame, gap: int, key: str = "gun", time: str = "t") -> DataFrame:
    """Adds session_id, session_size and simultaneous (a session of several rows)."""
    out = with_segments(df, gap, key, time).withColumnRenamed("segment_id", "session_id")
    size = F.count("*").over(Window.partitionBy(key, "session_id"))
    return out.withColumn("session_size", size).withColumn("simultaneous", size > 1)


def asof_before(left: DataFrame, right: DataFrame, values: Sequence[str], key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` strictly before it: last_t and ``values``.

    One pass over both sides in order of time; no join of every pair. Rows of ``right`` at one time:
    the greatest by ``values`` counts. ``chunk`` splits the work of a key into spans of so much time, with
    the same result; times are not null then.
    """
    facts = F.struct(F.col(time).alias("last_t"), *[F.col(v) for v in values])
    none = F.lit(None)
    l_names = left.columns
    l = left.select(F.struct(*l_names).alias("_row"), F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(0).alias("_side"))
    r = right.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(1).alias("_side"), facts.alias("_fact"))
    both = l.withColumn("_fact", none.cast(r.schema["_fact"].dataType)).unionByName(r.withColumn("_row", none.cast(l.schema["_row"].dataType)))
    if chunk is not None:
        both = by_chunk(_chunked(both, "_key", "_t", chunk), "_key", {"_newest": F.max("_fact")}, {"_earlier": F.max("_newest").over(earlier_chunks("_key"))})
        w = Window.partitionBy("_key", "_chunk").orderBy("_t", "_side", "_fact").rowsBetween(Window.unboundedPreceding, 0)
        last = F.coalesce(F.last("_fact", ignorenulls=True).over(w), F.col("_earlier"))
    else:
        w = Window.partitionBy("_key").orderBy("_t", "_side", "_fact").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last("_fact", ignorenulls=True).over(w)
    found = both.withColumn("_last", last).where(F.col("_side") == 0)
    return found.select("_row.*", "_last.*")


def since_and_until(df: DataFrame, flag: Column, key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds since (time from the last flagged row strictly before) and until (to the next after).

    ``chunk`` splits the work of a key into spans of so much time, with the same result.
    """
    mark = F.when(flag, F.col(time))
    rows = held(df, {"since": (mark, "before"), "until": (mark, "after")}, key, time, chunk)
    return rows.withColumn("since", F.col(time) - F.col("since")).withColumn("until", F.col("until") - F.col(time))


def nearest(df: DataFrame, flag: Column, tolerance: int, key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds near: the distance to the nearest flagged other row, or null beyond ``tolerance``."""
    out = since_and_until(df, flag, key, time, chunk)
    near = F.least("since", "until")
    return out.withColumn("near", F.when(near <= tolerance, near)).drop("since", "until")


def interval_join(points: DataFrame, spans: DataFrame, width: int, key: str = "gun", time: str = "t", start: str = "start_t", end: str = "end_t", how: str = "inner") -> DataFrame:
    """Rows of ``spans`` with the ``points`` of their key in [start, end): an equi-join on bins of ``width``.

    A span is repeated for each bin it meets, a point lies in one, so no pair comes twice and the join
    shuffles on (key, bin) instead of comparing all of a key's rows. ``how`` "left" keeps spans with no
    points. Columns of the two sides other than the key must have different names.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    s = spans.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    p = points.withColumn("_bin", F.floor(F.col(time) / width)).withColumnRenamed(key, "_pkey")
    hit = (s["_bin"] == p["_bin"]) & (s[key] == p["_pkey"]) & (p[time] >= s[start]) & (p[time] < s[end])
    found = s.join(p, hit, "inner").drop("_bin", "_pkey")
    if how == "inner":
        return found
    missing = spans.join(found.select(key, start, end).distinct(), [key, start, end], "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)


def count_in(points: DataFrame, spans: DataFrame, width: int, key: str = "gun", time: str = "t", start: str = "start_t", end: str = "end_t") -> DataFrame:
    """(key, start, end, n_points): points in each distinct span, zero included."""
    named = spans.select(key, start, end).distinct()
    found = interval_join(points.select(key, time), named, width, key, time, start, end)
    n = found.groupBy(key, start, end).agg(F.count("*").alias("n_points"))
    return named.join(n, [key, start, end], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def overlapping(spans: DataFrame, others: DataFrame, width: int, key: str = "gun", start: str = "start_t", end: str = "end_t") -> DataFrame:
    """Distinct ``spans`` of (key, start, end) that some other span overlaps: s < end and e >= start."""
    s = spans.select(key, start, end).distinct().withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    o = others.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    hit = (s[key] == o["_k"]) & (s["_bin"] == o["_bin"]) & (o["_s"] < s[end]) & (o["_e"] >= s[start])
    return s.join(o, hit, "left_semi").select(key, start, end).distinct()


def operating_clock(points: DataFrame, off: DataFrame, key: str = "gun", time: str = "t", start: str = "start_t", end: str = "end_t") -> DataFrame:
    """Adds operating: time since the key's first point, less the time inside ``off`` spans before.

    ``off`` spans of a key don't overlap. Both sides are read once, in order: the running sum of whole
    off spans, and the part of the one that a point lies in.
    """
    whole = off.select(F.col(key).alias("_k"), F.col(start).alias("_t"), F.col(end).alias("_e"), (F.col(end) - F.col(start)).alias("_len"))
    names = points.columns
    p = points.select(F.struct(*names).alias("_row"), F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(None).cast("long").alias("_e"), F.lit(0).cast("long").alias("_len"))
    o = whole.withColumn("_row", F.lit(None).cast(p.schema["_row"].dataType))
    w = Window.partitionBy("_k").orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(o).withColumn("_off", F.sum("_len").over(w)).withColumn("_end", F.last("_e", ignorenulls=True).over(w))
    over = F.greatest(F.coalesce(F.col("_end") - F.col("_t"), F.lit(0)), F.lit(0))
    both = both.where(F.col("_row").isNotNull())
    first = F.min("_t").over(Window.partitionBy("_k"))
    # time off before the first point is not part of its clock
    start_off = F.min_by(F.col("_off") - over, "_t").over(Window.partitionBy("_k"))
    return both.select("_row.*", (F.col("_t") - first - (F.col("_off") - over - start_off)).alias("operating"))


def long_blocks(df: DataFrame, share: str, least: float, length: int, key: str = "gun", slot: str = "slot") -> DataFrame:
    """Runs of consecutive slots whose ``share`` is ``least`` or more, of ``length`` slots at least."""
    busy = df.where(F.col(share) >= least)
    island = F.col(slot) - F.row_number().over(Window.partitionBy(key).orderBy(slot))
    out = busy.withColumn("_island", island).groupBy(key, "_island").agg(F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.count("*").alias("n_slots"))
    return out.where(F.col("n_slots") >= length).drop("_island")


def circular_distance(a: Column, b: Column, around: int) -> Column:
    """The shorter way between two points of a clock of ``around`` units."""
    d = F.pmod(a - b, F.lit(around))
    return F.least(d, around - d)


def circular_mean(x: Column, around: float) -> Column:
    """Aggregate: the mean direction of points on a clock, from 0 to ``around``."""
    import math

    angle = x * (2 * math.pi / around)
    return F.pmod(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * (around / (2 * math.pi)), F.lit(around))


def daily_coverage(counts: DataFrame, key: str = "gun", day: str = "day", n: str = "n") -> DataFrame:
    """A row for every day from a key's first to its last, with 0 where it has none."""
    span = counts.groupBy(key).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    return span.join(counts, [key, day], "left").withColumn(n, F.coalesce(n, F.lit(0)))


def change_points(df: DataFrame, value: str, key: str = "gun", time: str = "t") -> DataFrame:
    """Rows where ``value`` differs from the row before, and each key's first: a run-length code."""
    w = ordered(key, time)
    return df.where(F.col(time).isNotNull()).withColumn("_same", F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(time).over(w).isNotNull()).where(~F.col("_same")).drop("_same")


def expand_changes(times: DataFrame, changes: DataFrame, value: str, key: str = "gun", time: str = "t") -> DataFrame:
    """The value that holds at each of ``times``, from ``change_points``."""
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    c = changes.select(key, time, F.struct(value).alias("_v"), F.lit(0).alias("_side"))
    both = times.select(key, time, F.lit(1).alias("_side")).unionByName(c, allowMissingColumns=True)
    held = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return held.select(key, time, F.col(f"_last.{value}").alias(value))


def gap_kind(gaps: DataFrame, rate: str = "rate", baseline: str = "baseline", delta: str = "delta", least: float = 0.3) -> DataFrame:
    """Adds kind: frozen (counter did not move), logging_dropout (it moved at the usual rate), partial."""
    ratio = F.try_divide(F.col(rate), F.col(baseline))
    return gaps.withColumn("kind", F.when(F.col(delta) <= 0, "frozen").when(ratio >= least, "logging_dropout").otherwise("partial"))
