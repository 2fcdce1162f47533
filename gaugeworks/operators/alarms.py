"""Alarm logic in batch: triggers with cooldown, holds, early-warning runs, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.intervals import asof_before, held, row_before
from gaugeworks.operators.staging import staged


def cooldown(df: DataFrame, wait: int, keys: Sequence[str] = ("gun",), time: str = "t", chunk: int | None = None) -> DataFrame:
    """(keys, time) of the rows that a greedy cooldown accepts: ``wait`` or more after the last accepted.

    Without ``chunk`` the fold runs over each key's sorted times in one task (8 bytes each). With it no
    key's times come together: the row that follows an accepted one is the first at or after its time plus
    ``wait``, found as of spans of ``chunk``; what the first row of a key leads to is marked by doubling
    those steps, so the rounds are the logarithm of the most that a key accepts.
    """
    if chunk is not None:
        return _reached(df, wait, keys, time, chunk)
    times = df.groupBy(*keys).agg(F.sort_array(F.collect_set(time)).alias("_times"))
    none = F.array().cast("array<long>")
    accepted = F.aggregate("_times", F.struct(F.lit(None).cast("long").alias("last"), none.alias("kept")), lambda s, t: F.when(s["last"].isNull() | (t - s["last"] >= wait), F.struct(t.alias("last"), F.concat(s["kept"], F.array(t)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return times.select(*keys, F.explode(accepted).alias(time))


def _reached(df: DataFrame, wait: int, keys: Sequence[str], time: str, chunk: int) -> DataFrame:
    key = F.struct(*keys).alias("_k")
    times = staged(df.where(F.col(time).isNotNull()).select(key, F.col(time).alias("_at")).distinct(), "onsets")
    # looking ahead is looking back on a clock that runs the other way
    asked = times.select("_k", "_at", (-(F.col("_at") + wait) + 1).alias("_clock"))
    known = times.select("_k", (-F.col("_at")).alias("_clock"), F.col("_at").alias("_next"))
    steps = asof_before(asked, known, ["_next"], "_k", "_clock", chunk).where("_next is not null").select("_k", "_at", "_next")
    steps = staged(steps, "steps")
    found = fresh = times.groupBy("_k").agg(F.min("_at").alias("_at"))
    while True:
        # found holds the first 2 ** n accepted rows of each key, steps lead 2 ** n rows on
        fresh = staged(found.join(steps, ["_k", "_at"]).select("_k", F.col("_next").alias("_at")), "accepted")
        if fresh.isEmpty():
            return found.select("_k.*", F.col("_at").alias(time))
        found = found.unionByName(fresh)
        ahead = steps.select("_k", F.col("_at").alias("_next"), F.col("_next").alias("_far"))
        steps = staged(steps.join(ahead, ["_k", "_next"]).select("_k", "_at", F.col("_far").alias("_next")), "steps")


def onsets(df: DataFrame, codes: Sequence[str], key: str = "gun", time: str = "t", code: str = "code", per_code: bool = True, chunk: int | None = None) -> DataFrame:
    """Rows at which a terminal code begins.

    Per code: the code is terminal and differs from the row before. Shared: the row before has no
    terminal code at all. ``chunk`` splits the work of a key into spans of so much time.
    """
    before = F.col(f"_before.{code}")
    terminal = F.col(code).isin(*codes)
    starts = terminal & (~F.col(code).eqNullSafe(before) if per_code else ~F.coalesce(before.isin(*codes), F.lit(False)))
    return row_before(df, [code], key, time, chunk).where(starts).drop("_before")


def triggers(df: DataFrame, codes: Sequence[str], wait: int, repeat: int, key: str = "gun", time: str = "t", code: str = "code", per_code: bool = True, chunk: int | None = None) -> DataFrame:
    """Accepted triggers with repeat: the same code triggered less than ``repeat`` before.

    The cooldown counts per (key, code), or per key where ``per_code`` is false. ``chunk`` splits the work of a
    key into spans of so much time, with the same result; a key's times are never in one task then.
    """
    starts = onsets(df, codes, key, time, code, per_code, chunk)
    kept = cooldown(starts, wait, [key, code] if per_code else [key], time, chunk)
    rows = starts.join(kept, [key, code, time] if per_code else [key, time], "left_semi")
    rows = row_before(rows.withColumn("_own", F.struct(key, code)), [], "_own", time, chunk)
    return rows.withColumn("repeat", F.coalesce(F.col(time) - F.col(f"_before.{time}") < repeat, F.lit(False))).drop("_before", "_own")


def with_profile(df: DataFrame, profiles: DataFrame, key: str = "gun", code: str = "code") -> DataFrame:
    """Adds out_of_profile: the key has a profile (array column ``codes``) without the code.

    No profile (or a null one) allows all codes, an empty one none.
    """
    joined = df.join(profiles.select(key, F.col("codes").alias("_codes")), key, "left")
    return joined.withColumn("out_of_profile", F.coalesce(~F.array_contains("_codes", F.col(code)), F.lit(False))).drop("_codes")


def restart_hold(df: DataFrame, idle: str, least: int, hold: int, step: int, key: str = "gun", slot: str = "w_end", chunk: int | None = None) -> DataFrame:
    """Adds held: windows less than ``hold`` after the first active window that follows a long idle time.

    ``least`` idle windows in a row make it long; windows that are missing count as idle. Idle windows
    inside a hold are held too. ``slot`` advances by ``step`` from window to window. ``chunk`` splits the
    work of a key into spans of so much time, with the same result.
    """
    # what lies before the first active window counts from the key's first window
    rows = held(df, {"_active": (F.when(~F.col(idle), F.col(slot)), "before"), "_seen": (F.col(slot), "before")}, key, slot, chunk)
    rows = held(rows, {"_first": (F.when(F.col("_seen").isNull(), F.col(slot)), "upto")}, key, slot, chunk)
    quiet = F.coalesce((F.col(slot) - F.col("_active")) / step - 1, (F.col(slot) - F.col("_first")) / step)
    rows = held(rows, {"_since": (F.when(~F.col(idle) & (quiet >= least), F.col(slot)), "upto")}, key, slot, chunk)
    return rows.withColumn("held", F.coalesce(F.col(slot) - F.col("_since") < hold, F.lit(False))).drop("_active", "_seen", "_first", "_since")


def alarm_gate(non_welding: Column, warm_up: Column, hold: Column, above: Column) -> tuple[Column, Column]:
    """(alarm, hold_reason): a window that is held for any reason is no alarm; reasons in this order."""
    reason = F.when(non_welding > 0.5, "non_welding").when(warm_up, "warm_up").when(hold, "restart_hold")
    return above & reason.isNull(), reason


def alarm_runs(df: DataFrame, alarm: str, step: int, sustained: int, key: str = "gun", time: str = "t", chunk: int | None = None) -> DataFrame:
    """Runs of alarm windows, broken by any other window or a step over ``step``: duration and sustained.

    ``chunk`` splits the work of a key into spans of so much time, with the same result.
    """
    rows = row_before(df, [alarm], key, time, chunk)
    breaks = ~F.coalesce(F.col(f"_before.{alarm}"), F.lit(False)) | (F.col(time) - F.col(f"_before.{time}") > step)
    rows = held(rows, {"_run": (F.when(F.col(alarm) & breaks, F.col(time)), "upto")}, key, time, chunk).where(F.col(alarm))
    out = rows.groupBy(key, "_run").agg(F.min(time).alias("start_t"), F.max(time).alias("end_t"), F.count("*").alias("n_windows")).drop("_run")
    return out.withColumn("duration", F.col("end_t") - F.col("start_t")).withColumn("sustained", F.col("duration") >= sustained)


def early_warning(df: DataFrame, condition: Column, k: int, step: int, key: str = "gun", slot: str = "w_end", chunk: int | None = None) -> DataFrame:
    """Adds run_position, active and onset: k windows in a row, exactly ``step`` apart, meet the condition.

    The k-th is the onset; a run is active from it on. ``chunk`` splits the work of a key into spans of so
    much time, with the same result.
    """
    rows = row_before(df.withColumn("_met", F.coalesce(condition, F.lit(False))), ["_met"], key, slot, chunk)
    new = ~F.coalesce(F.col("_before._met"), F.lit(False)) | (F.col(slot) - F.col(f"_before.{slot}") != step)
    rows = held(rows, {"_from": (F.when(F.col("_met") & new, F.col(slot)), "upto")}, key, slot, chunk)
    # windows of a run are a step apart, so their distance counts them
    position = ((F.col(slot) - F.col("_from")) / step + 1).cast("int")
    rows = rows.withColumn("run_position", F.when(F.col("_met"), position).otherwise(0))
    return rows.withColumn("active", F.col("run_position") >= k).withColumn("onset", F.col("run_position") == k).drop("_met", "_before", "_from")


def condition(kind: str, score: Column, threshold: Column, gate: Column, terminal: Column, error: Column, warm_up: Column) -> Column:
    """The condition of an early-warning kind; never during warm-up."""
    above = score >= threshold
    watch = ~terminal & error
    kinds = {
        "model": above & gate,
        "model_ng": above,
        "model_quiet": above & gate & ~error,
        "model_watch": (above & gate) | watch,
        "watch": watch,
        "stop": ~gate,
    }
    return kinds[kind] & ~warm_up


def suppression(critical: Column, terminal: Column, cooling: Column, handoffs_off: Column) -> Column:
    """Why an early warning is not handed on: the first reason that holds, or null."""
    return F.when(critical, "critical").when(terminal, "terminal_code").when(cooling, "cooldown").when(handoffs_off, "handoffs_off")


def severity(rule: Column, rule_critical: Column, model_critical: Column, alarm: Column) -> Column:
    """critical, warning or normal."""
    return F.when(rule_critical | model_critical, "critical").when(alarm | rule, "warning").otherwise("normal")


def daily_counters(df: DataFrame, flags: Sequence[str], key: str = "gun", day: str = "day") -> DataFrame:
    """Windows and true flags per key and day."""
    return df.groupBy(key, day).agg(F.count("*").alias("windows"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def drift_days(counters: DataFrame, rate: Column, limit: float, days: int = 3, least: int = 1, key: str = "gun", day: str = "day") -> DataFrame:
    """(key, day, drift): whether the last ``days`` days with data are in a row and each is over ``limit``.

    Days with fewer than ``least`` windows count as not over.
    """
    over = counters.withColumn("_over", F.coalesce((rate > limit) & (F.col("windows") >= least), F.lit(False)))
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-(days - 1), 0)
    together = (F.count("*").over(w) == days) & (F.datediff(F.max(day).over(w), F.min(day).over(w)) == days - 1)
    return over.withColumn("drift", together & F.bool_and("_over").over(w)).select(key, day, "drift")


def chained_episode(events: DataFrame, warnings: DataFrame, key: str = "gun", time: str = "t") -> DataFrame:
    """Adds episode_id: that of the key's warning (start_t, end_t, episode_id) active at the event, else its own."""
    facts = warnings.select(key, F.col("start_t").alias(time), F.col("end_t").alias("_until"), F.col("episode_id").alias("_episode"))
    shifted = events.withColumn(time, F.col(time) + 1)
    found = asof_before(shifted, facts, ["_until", "_episode"], key, time).withColumn(time, F.col(time) - 1)
    own = F.substring(F.sha2(F.concat_ws("|", key, time), 256), 1, 32)
    return found.withColumn("episode_id", F.when(F.col("_until") >= F.col(time), F.col("_episode")).otherwise(own)).drop("_until", "_episode", "last_t")


def last_windows(df: DataFrame, n: int, key: str = "gun", time: str = "w_end") -> DataFrame:
    """The last n rows of each key, in order: a trace."""
    w = Window.partitionBy(key).orderBy(F.desc(time))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
