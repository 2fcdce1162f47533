"""The case store as tables: grouping, inboxes, memory, exports, outbox."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a closed case, and the two that the inbox knows.
CLOSED = ("resolved", "unresolved", "false_alarm")
INBOX_CLOSED = ("resolved", "unresolved")


def grouped(handoffs: DataFrame, closes: DataFrame, codeless: Column | None = None, key: str = "gun", group: str = "grp", time: str = "t", event: str = "event_id") -> DataFrame:
    """Adds case_no, case_start and outcome: new, repeat, duplicate or ignored.

    A handoff joins the open case of its key and group, or opens one; a case is open until the first of
    ``closes`` (key, time) after its start. A later row of one event id is a duplicate; rows for which
    ``codeless`` holds open nothing. Between two closes there is at most one case, so counting closes
    finds it, with no fold over a case's rows.
    """
    rows = handoffs.withColumn("_copy", F.row_number().over(Window.partitionBy(event).orderBy(time)))
    rows = rows.withColumn("_ignored", codeless if codeless is not None else F.lit(False))
    names = rows.columns
    c = closes.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(1).alias("_close"))
    r = rows.select(F.struct(*names).alias("_row"), F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(0).alias("_close"))
    both = r.unionByName(c.withColumn("_row", F.lit(None).cast(r.schema["_row"].dataType)))
    before = F.sum("_close").over(Window.partitionBy("_key").orderBy("_t", "_close").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("case_no", before).where(F.col("_row").isNotNull()).select("_row.*", "case_no")
    counts = ~F.col("_ignored") & (F.col("_copy") == 1)
    case = Window.partitionBy(key, group, "case_no")
    start = F.min(F.when(counts, F.struct(time, event))).over(case)
    outcome = F.when(F.col("_copy") > 1, "duplicate").when(F.col("_ignored"), "ignored").when(F.struct(time, event) == start, "new").otherwise("repeat")
    return placed.withColumn("case_start", start[time]).withColumn("outcome", outcome).drop("_copy", "_ignored")


def severity_of(df: DataFrame, case: Sequence[str], critical: Column) -> DataFrame:
    """(case, severity, n_events): critical once any of its events is."""
    return df.groupBy(*case).agg(F.when(F.bool_or(critical), "critical").otherwise("warning").alias("severity"), F.count("*").alias("n_events"))


def latest(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """The last row of each key by time, then by ``tie``; null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def memory(cases: DataFrame, closed: Column, key: str, time: str, case: str = "case_id", most: int = 3) -> DataFrame:
    """(case, n_past, recent): for each case, how many closed ones of its key came before it, and the latest.

    One ordered pass over each key's cases with a frame of ``most`` closed ones; no join of all pairs.
    """
    facts = F.struct(F.col(time), F.col(case))
    w = Window.partitionBy(key).orderBy(time, case)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    done = cases.withColumn("_done", closed)
    rows = done.withColumn("n_past", F.count(F.when(F.col("_done"), 1)).over(past)).withColumn("_rank", F.col("n_past") + F.col("_done").cast("int"))
    closures = rows.where("_done").select(F.col(key).alias("_k"), F.col("_rank").alias("_at"), facts.alias("_f"))
    wanted = rows.select(key, case, "n_past", F.explode_outer(F.when(F.col("n_past") > 0, F.sequence(F.greatest(F.col("n_past") - most + 1, F.lit(1)), F.col("n_past")))).alias("_at2"))
    found = wanted.join(closures, (F.col(key) == F.col("_k")) & (F.col("_at2") == F.col("_at")), "left")
    return found.groupBy(key, case, "n_past").agg(F.sort_array(F.collect_list("_f"), False).alias("recent")).withColumn("recent", F.transform("recent", lambda x: x[case]))


def merged_checks(recorded: Column, draft: Column) -> Column:
    """Two maps of check states; the draft wins where both have a key."""
    kept = F.map_filter(recorded, lambda k, v: ~F.coalesce(F.map_contains_key(draft, k), F.lit(False)))
    return F.when(recorded.isNull(), draft).when(draft.isNull(), recorded).otherwise(F.map_concat(kept, draft))


def tallies(checks: Column, states: Sequence[str]) -> Column:
    """How many checks are in each state."""
    return F.struct(*[F.size(F.filter(F.map_values(checks), lambda v: v == s)).alias(s) for s in states])


def trace_before(points: DataFrame, events: DataFrame, span: int, width: int, key: str = "gun", time: str = "t", event: str = "event_id") -> DataFrame:
    """(event_id, time, points' columns): what a key measured in (t - span, t] of each event."""
    from gaugeworks.operators.intervals import interval_join

    spans = events.select(key, event, (F.col(time) - span + 1).alias("start_t"), (F.col(time) + 1).alias("end_t"))
    return interval_join(points, spans, width, key, time).drop("start_t", "end_t")


def due(outbox: DataFrame, now: int, most: int) -> DataFrame:
    """Pending rows whose time has come and that have attempts left, oldest first by rank."""
    rows = outbox.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now) & (F.col("attempts") < most))
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("pattern_key").orderBy("next_attempt_at", "event_id")))


def claimed(outbox: DataFrame, now: int, lease_until: int, most: int = 1) -> DataFrame:
    """The ``most`` pending rows that have been due longest, each with one more attempt and a lease.

    Each task keeps its own ``most`` first rows, so ``most`` is what a worker can deliver in one go.
    """
    first = outbox.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "event_id").limit(most)
    return first.withColumn("attempts", F.col("attempts") + 1).withColumn("next_attempt_at", F.lit(lease_until).cast(outbox.schema["next_attempt_at"].dataType))


def finished(outbox: DataFrame, answers: DataFrame) -> DataFrame:
    """``outbox`` with the status and next time that ``answers`` (event_id, attempts, status, next_attempt_at) set.

    An answer counts only if the row is pending and no later attempt has been claimed; answers are distinct by event_id
    and attempts.
    """
    a = answers.select("event_id", "attempts", F.struct("status", "next_attempt_at").alias("_set"))
    j = outbox.join(a, ["event_id", "attempts"], "left").withColumn("_set", F.when(F.col("status") == "pending", F.col("_set")))
    changed = {c: F.when(F.col("_set").isNotNull(), F.col(f"_set.{c}").cast(outbox.schema[c].dataType)).otherwise(F.col(c)) for c in ("status", "next_attempt_at")}
    return j.withColumns(changed).select(*outbox.columns)


def backoff(attempts: Column, steps: Sequence[int] = (10, 30, 120, 600)) -> Column:
    """Seconds until the next attempt after so many."""
    table = F.array(*map(F.lit, steps))
    return F.element_at(table, F.least(F.greatest(attempts, F.lit(1)), F.lit(len(steps))))


def delivery(outbox: DataFrame, most: int = 5) -> DataFrame:
    """Adds outcome of the last answer (column http): done, failed for good, or retry after a wait.

    4xx answers other than 408 and 429 are final, as is the last attempt.
    """
    final = (F.col("http").between(400, 499)) & ~F.col("http").isin(408, 429)
    outcome = F.when(F.col("http").between(200, 299), "done").when(final | (F.col("attempts") >= most), "failed").otherwise("retry")
    return outbox.withColumn("outcome", outcome).withColumn("wait", F.when(F.col("outcome") == "retry", backoff(F.col("attempts"))))


def preferred_event(events: DataFrame, case: str, code: str, time: str, event: str = "event_id") -> DataFrame:
    """(case, event_id): the latest with a controller code, else the first of all."""
    coded = F.when(F.col(code).isNotNull(), F.struct(time, event))
    return events.groupBy(case).agg(F.coalesce(F.max(coded)[event], F.min(F.struct(time, event))[event]).alias(event))


def ordered_union(*parts: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of all parts, those of earlier parts first, each key once, at its first place."""
    rows = None
    for i, p in enumerate(parts):
        own = p.select(key, F.struct(F.lit(i).alias("part"), F.col(position).alias("at")).alias("_at"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(key).agg(F.min("_at").alias("_at")).select(key, F.col("_at.part").alias("part"), F.col("_at.at").alias(position))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds reasons: the names of checks a row fails, in order."""
    failed = [F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*failed)))


def open_cases(cases: DataFrame, closed: Sequence[str] = CLOSED, status: str = "status") -> DataFrame:
    """Cases that are in none of the closed states; a null state is open."""
    return cases.where(~F.coalesce(F.col(status).isin(*closed), F.lit(False)))


def lease_backoff(attempts: Column) -> Column:
    """Seconds until a leased delivery is tried again: doubling, at most 300."""
    return F.least(F.lit(300), F.pow(F.lit(2), F.least(attempts, F.lit(9))).cast("int"))


def reuse_counts(resolutions: DataFrame, card: str = "card_id", case: str = "case_id", scope: str = "scope", time: str = "closed_at") -> DataFrame:
    """(card, scope, cases, last_case): distinct cases that a card resolved in a scope, and the latest."""
    return resolutions.groupBy(card, scope).agg(F.count_distinct(case).alias("cases"), F.max(F.struct(time, case))[case].alias("last_case"))


def pending_patterns(outbox: DataFrame) -> DataFrame:
    """(pattern_key, pending): patterns with a delivery that is pending or has failed (C4); null keys have none."""
    waiting = F.coalesce(F.col("status").isin("pending", "failed"), F.lit(False))
    return outbox.where(F.col("pattern_key").isNotNull()).groupBy("pattern_key").agg(F.bool_or(waiting).alias("pending"))


def excluded(judgments: DataFrame, results: DataFrame, case: str = "case_id", candidate: str = "candidate_id", time: str = "at") -> DataFrame:
    """(case, candidate, excluded): the latest word on a candidate is a rejection, or a failed result after it."""
    j = judgments.groupBy(case, candidate).agg(F.max(F.struct(time, "verdict")).alias("_j"))
    r = results.groupBy(case, candidate).agg(F.max(F.struct(time, "outcome")).alias("_r"))
    both = j.join(r, [case, candidate], "full_outer")
    rejected = F.coalesce(F.col("_j.verdict") == "rejected", F.lit(False))
    failed = F.coalesce(F.col("_r.outcome") == "failed", F.lit(False)) & (F.col("_j").isNull() | (F.col(f"_r.{time}") >= F.col(f"_j.{time}")))
    return both.select(case, candidate, (rejected | failed).alias("excluded"))


def cards(rows: DataFrame, rejected: DataFrame, card: str = "card_id", order: str = "position") -> DataFrame:
    """The last row of each card, without those rejected (C14)."""
    w = Window.partitionBy(card).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(rejected.select(card), card, "left_anti")


def inbox(keys: DataFrame, cases: DataFrame, key: str = "gun", time: str = "detected_at", case: str = "case_id", closed: Sequence[str] = CLOSED) -> DataFrame:
    """(key, n_open, cases): every key with its open cases, newest first; none is an empty list."""
    o = open_cases(cases, closed).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(time, case)), False).alias("_c"))
    j = keys.select(key).distinct().join(o, key, "left")
    ids = F.transform("_c", lambda x: x[case])
    return j.select(key, F.coalesce(F.size("_c"), F.lit(0)).alias("n_open"), F.coalesce(ids, F.array()).alias("cases")).withColumn("n_open", F.greatest("n_open", F.lit(0)))


def feedback_export(cases: DataFrame, events: DataFrame, states: Sequence[str] = ("abnormal", "normal", "unchecked"), case: str = "case_id") -> DataFrame:
    """Closed early-warning cases by (closed_at, id): outcome, merged check counts, events in order.

    ``cases`` has outcome, closed_at, kind, and maps recorded and draft; ``events`` (case_id, event_id, t).
    """
    e = events.groupBy(case).agg(F.sort_array(F.collect_list(F.struct("t", "event_id"))).alias("_e"))
    rows = cases.where(F.col("closed_at").isNotNull() & (F.col("kind") == "early_warning")).join(e, case, "left")
    counts = tallies(merged_checks(F.col("recorded"), F.col("draft")), states)
    place = F.row_number().over(Window.partitionBy(F.to_date("closed_at")).orderBy("closed_at", case))
    return rows.select(case, "outcome", "closed_at", counts.alias("checks"), F.transform("_e", lambda x: x["event_id"]).alias("events"), place.alias("place_in_day"))


def group_key(episode: Column, kind: Column, code: Column) -> Column:
    """What a handoff is grouped by: its episode, else being an early warning, else its code."""
    return F.when(episode.isNotNull(), F.concat(F.lit("episode:"), episode)).when(kind == "early_warning", "early_warning").otherwise(code)


def without_rejected(lists: Column, rejected: Column, card: str = "card_id") -> Column:
    """An array of cards without those whose id is in ``rejected``."""
    return F.filter(lists, lambda x: ~F.coalesce(F.array_contains(rejected, x[card]), F.lit(False)))


def seen_cards(shown: Column, more: Column) -> Column:
    """Two maps of shown cards by id; what was shown last wins."""
    return merged_checks(shown, more)


def distinct_in_order(items: Column, field: str) -> Column:
    """An array of structs with the first of each ``field`` only."""
    ids = F.transform(items, lambda x: x[field])
    return F.filter(items, lambda x, i: F.array_position(ids, x[field]) == i + 1)


def group_report(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n, valid, failed, mean, std): failures are null values and never count as 0."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("valid"), F.count_if(F.col(value).isNull()).alias("failed"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def disjoint(*parts: DataFrame, key: str) -> DataFrame:
    """(key, times): members of several parts of a split; empty if it is one."""
    rows = None
    for p in parts:
        own = p.select(key).distinct()
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")
