"""Queries on alarm logic. Gun = user, terminal codes = error and signup, windows of six hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import alarms as A
from gaugeworks.operators import intervals as I
from gaugeworks.plans.registry import DAY, HOUR, query, readings, rounded

CODES = ("error", "signup")
WAIT, REPEAT, W = 12 * HOUR, 7 * DAY, 6 * HOUR

_RULE = f"""WITH RECURSIVE o AS (SELECT gun, t, code FROM (SELECT *, lag(code) OVER (PARTITION BY gun ORDER BY t) AS before FROM ev)
 WHERE code IN ('error', 'signup') AND {{start}}),
n AS (SELECT *, row_number() OVER (PARTITION BY {{keys}} ORDER BY t) AS rn FROM o),
f AS (SELECT gun, code, t, rn, t AS last, true AS kept FROM n WHERE rn = 1
 UNION ALL SELECT n.gun, n.code, n.t, n.rn, CASE WHEN n.t - f.last >= {WAIT} THEN n.t ELSE f.last END, n.t - f.last >= {WAIT}
 FROM f JOIN n ON {{match}} AND n.rn = f.rn + 1)
SELECT gun, code, t, coalesce(t - lag(t) OVER (PARTITION BY gun, code ORDER BY t) < {REPEAT}, false) AS repeat FROM f WHERE kept"""


@query(_RULE.format(start="(before IS NULL OR before <> code)", keys="gun, code", match="n.gun = f.gun AND n.code = f.code"))
def alarm_rule_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.triggers(readings(spark, sf_dir), CODES, WAIT, REPEAT).select("gun", "code", "t", "repeat")


@query(_RULE.format(start="(before IS NULL OR before NOT IN ('error', 'signup'))", keys="gun", match="n.gun = f.gun"))
def alarm_rule_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.triggers(readings(spark, sf_dir), CODES, WAIT, REPEAT, per_code=False).select("gun", "code", "t", "repeat")


@query(_RULE.format(start="(before IS NULL OR before <> code)", keys="gun, code", match="n.gun = f.gun AND n.code = f.code"))
def alarm_rule_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, R11 per code, R13, a gun's rows in spans of three days and no key's times in one task."""
    return A.triggers(readings(spark, sf_dir), CODES, WAIT, REPEAT, chunk=3 * DAY).select("gun", "code", "t", "repeat")


@query(_RULE.format(start="(before IS NULL OR before NOT IN ('error', 'signup'))", keys="gun", match="n.gun = f.gun"))
def alarm_rule_shared_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared rule, likewise."""
    return A.triggers(readings(spark, sf_dir), CODES, WAIT, REPEAT, per_code=False, chunk=3 * DAY).select("gun", "code", "t", "repeat")


@query("""SELECT event_id, code, CASE WHEN gun % 3 = 0 THEN false WHEN gun % 3 = 1 THEN code <> 'error' ELSE true END AS out_of_profile FROM ev WHERE code IN ('error', 'signup')""")
def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guns by thirds: no profile, a profile of one code, an empty profile."""
    ev = readings(spark, sf_dir).where(F.col("code").isin(*CODES))
    profiles = ev.select("gun").distinct().withColumn("codes", F.when(F.expr("gun % 3 = 1"), F.array(F.lit("error"))).when(F.expr("gun % 3 = 2"), F.array().cast("array<string>")))
    return A.with_profile(ev, profiles).select("event_id", "code", "out_of_profile")


_WINDOWS = f"""w AS (SELECT gun, (t // {W} + 1) * {W} AS w_end, count(*) AS n, avg(value) AS score, max(CASE WHEN code = 'error' THEN 1 ELSE 0 END) = 1 AS error,
 avg(CASE WHEN code = 'view' THEN 1.0 ELSE 0.0 END) AS non_welding FROM ev GROUP BY 1, 2)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of six hours: n, score (mean value), error, non_welding (share of views)."""
    ev = readings(spark, sf_dir)
    return ev.groupBy("gun", ((F.floor(F.col("t") / W) + 1) * W).alias("w_end")).agg(
        F.count("*").alias("n"),
        F.avg("value").alias("score"),
        F.bool_or(F.col("code") == "error").alias("error"),
        F.avg((F.col("code") == "view").cast("double")).alias("non_welding"),
    )


_HELD = f"""{_WINDOWS}, a AS (SELECT *, non_welding > 0.5 AS idle, max(CASE WHEN non_welding <= 0.5 THEN w_end END) OVER (PARTITION BY gun ORDER BY w_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la,
 min(w_end) OVER (PARTITION BY gun) AS f FROM w),
b AS (SELECT *, CASE WHEN NOT idle AND coalesce((w_end - la) / {W} - 1, (w_end - f) / {W}) >= 3 THEN w_end END AS begins FROM a),
h AS (SELECT *, coalesce(w_end - max(begins) OVER (PARTITION BY gun ORDER BY w_end ROWS UNBOUNDED PRECEDING) < {DAY}, false) AS held FROM b)"""


def held_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.restart_hold(windows(spark, sf_dir).withColumn("idle", F.col("non_welding") > 0.5), "idle", 3, DAY, W)


@query(f"WITH {_HELD} SELECT gun, w_end, held FROM h")
def restart_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_windows(spark, sf_dir).select("gun", "w_end", "held")


_GATED = f"""{_HELD}, u AS (SELECT *, w_end < f + {2 * DAY} AS warm_up FROM h),
g AS (SELECT *, CASE WHEN non_welding > 0.5 THEN 'non_welding' WHEN warm_up THEN 'warm_up' WHEN held THEN 'restart_hold' END AS hold_reason FROM u),
z AS (SELECT *, score > 60 AND hold_reason IS NULL AS alarm FROM g)"""


def gated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held_windows(spark, sf_dir)
    rows = rows.withColumn("warm_up", F.col("w_end") < F.min("w_end").over(I.Window.partitionBy("gun")) + 2 * DAY)
    alarm, reason = A.alarm_gate(F.col("non_welding"), F.col("warm_up"), F.col("held"), F.col("score") > 60)
    return rows.withColumn("hold_reason", reason).withColumn("alarm", alarm)


@query(f"WITH {_GATED} SELECT gun, w_end, hold_reason, alarm FROM z")
def alarm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_windows(spark, sf_dir).select("gun", "w_end", "hold_reason", "alarm")


@query(f"""WITH {_GATED}, r AS (SELECT *, sum(CASE WHEN NOT alarm OR NOT coalesce(lag_alarm, false) OR step > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY gun ORDER BY w_end ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, lag(alarm) OVER (PARTITION BY gun ORDER BY w_end) AS lag_alarm, w_end - lag(w_end) OVER (PARTITION BY gun ORDER BY w_end) AS step FROM z))
SELECT gun, min(w_end) AS start_t, max(w_end) AS end_t, count(*) AS n_windows, max(w_end) - min(w_end) AS duration, max(w_end) - min(w_end) >= {W} AS sustained FROM r WHERE alarm GROUP BY gun, run""")
def alarm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alarm_runs(gated_windows(spark, sf_dir), "alarm", DAY, W, time="w_end")


_EW = f"""{_WINDOWS}, c AS (SELECT *, score >= {{thr}} AS met FROM w),
i AS (SELECT *, sum(CASE WHEN NOT met OR NOT coalesce(lm, false) OR d <> {W} THEN 1 ELSE 0 END) OVER (PARTITION BY gun ORDER BY w_end ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, lag(met) OVER (PARTITION BY gun ORDER BY w_end) AS lm, w_end - lag(w_end) OVER (PARTITION BY gun ORDER BY w_end) AS d FROM c)),
p AS (SELECT *, CASE WHEN met THEN row_number() OVER (PARTITION BY gun, run ORDER BY w_end) ELSE 0 END AS run_position FROM i)"""


@query(f"WITH {_EW.format(thr=40)} SELECT gun, w_end, CAST(run_position AS INTEGER) AS run_position, run_position >= 2 AS active, run_position = 2 AS onset FROM p")
def early_warning_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.early_warning(windows(spark, sf_dir), F.col("score") >= 40, 2, W).select("gun", "w_end", "run_position", "active", "onset")


_ZONES = f"""t AS (SELECT gun, max(w_end) AS t_end FROM w WHERE error GROUP BY 1)"""


def _event_metrics(rows: DataFrame) -> DataFrame:
    """Per gun: hit (active in the last day before its end), chance (the same, days 1 to 6 earlier), false onsets."""
    end = rows.where("error").groupBy("gun").agg(F.max("w_end").alias("t_end"))
    back = F.floor((F.col("t_end") - F.col("w_end")) / DAY)
    joined = rows.join(end, "gun").withColumn("back", back).where("back >= 0")
    per_day = joined.groupBy("gun", "back").agg(F.bool_or("active").cast("double").alias("any"), F.count_if("onset").alias("onsets"))
    return per_day.groupBy("gun").agg(
        F.max(F.when(F.col("back") == 0, F.col("any"))).alias("hit"),
        F.avg(F.when(F.col("back").between(1, 6), F.col("any"))).alias("chance"),
        F.sum(F.when(F.col("back") >= 1, F.col("onsets")).otherwise(0)).alias("false_onsets"),
        F.count_if(F.col("back") >= 1).alias("days"),
    )


_METRICS = f"""{_ZONES}, q AS (SELECT p.gun, (t_end - w_end) // {DAY} AS back, max(CASE WHEN run_position >= 2 THEN 1.0 ELSE 0.0 END) AS hit_any, count(*) FILTER (WHERE run_position = 2) AS onsets
 FROM p JOIN t USING (gun) WHERE w_end <= t_end GROUP BY 1, 2),
m AS (SELECT gun, max(CASE WHEN back = 0 THEN hit_any END) AS hit, avg(CASE WHEN back BETWEEN 1 AND 6 THEN hit_any END) AS chance, sum(CASE WHEN back >= 1 THEN onsets ELSE 0 END) AS false_onsets, count(*) FILTER (WHERE back >= 1) AS days FROM q GROUP BY 1)"""


@query(f"WITH {_EW.format(thr=40)}, {_METRICS} SELECT gun, CAST(hit AS DOUBLE) AS hit, round(chance, 6) AS chance, CAST(false_onsets AS BIGINT) AS false_onsets, days FROM m")
def ew_event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_event_metrics(A.early_warning(windows(spark, sf_dir), F.col("score") >= 40, 2, W)))


@query("WITH " + _WINDOWS + f""", g AS (SELECT * FROM w, (VALUES (20.0), (40.0), (60.0), (80.0)) v(thr)), c AS (SELECT *, score >= thr AS met FROM g),
i AS (SELECT *, sum(CASE WHEN NOT met OR NOT coalesce(lm, false) OR d <> {W} THEN 1 ELSE 0 END) OVER (PARTITION BY gun, thr ORDER BY w_end ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, lag(met) OVER (PARTITION BY gun, thr ORDER BY w_end) AS lm, w_end - lag(w_end) OVER (PARTITION BY gun, thr ORDER BY w_end) AS d FROM c)),
p AS (SELECT *, CASE WHEN met THEN row_number() OVER (PARTITION BY gun, thr, run ORDER BY w_end) ELSE 0 END AS run_position FROM i), {_ZONES},
q AS (SELECT thr, p.gun, (t_end - w_end) // {DAY} AS back, max(CASE WHEN run_position >= 2 THEN 1.0 ELSE 0.0 END) AS hit_any, count(*) FILTER (WHERE run_position = 2) AS onsets
 FROM p JOIN t USING (gun) WHERE w_end <= t_end GROUP BY 1, 2, 3),
m AS (SELECT thr, gun, max(CASE WHEN back = 0 THEN hit_any END) AS hit, avg(CASE WHEN back BETWEEN 1 AND 6 THEN hit_any END) AS chance, sum(CASE WHEN back >= 1 THEN onsets ELSE 0 END) AS fo, count(*) FILTER (WHERE back >= 1) AS days FROM q GROUP BY 1, 2)
SELECT CAST(thr AS DOUBLE) AS threshold, round(avg(hit), 6) AS recall, round(avg(chance), 6) AS chance, round(avg(hit) - avg(chance), 6) AS excess, round(sum(fo) / sum(days), 6) AS false_per_day FROM m GROUP BY 1""")
def ew_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics over a grid of thresholds; each window is repeated once for each."""
    grid = windows(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, (20.0, 40.0, 60.0, 80.0)))))
    keyed = grid.withColumn("gun", F.struct("threshold", "gun"))
    m = _event_metrics(A.early_warning(keyed, F.col("score") >= F.col("threshold"), 2, W))
    out = m.groupBy(F.col("gun.threshold").alias("threshold")).agg(F.avg("hit").alias("recall"), F.avg("chance").alias("chance"), (F.avg("hit") - F.avg("chance")).alias("excess"), (F.sum("false_onsets") / F.sum("days")).alias("false_per_day"))
    return rounded(out)


_COUNTERS = f"""{_GATED}, d AS (SELECT gun, CAST(make_timestamp(w_end) AS DATE) AS day, count(*) AS windows, count(*) FILTER (WHERE alarm) AS alarm, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE warm_up) AS warm_up, count(*) FILTER (WHERE error) AS error FROM z GROUP BY 1, 2)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gated_windows(spark, sf_dir).withColumn("day", F.to_date(F.timestamp_micros("w_end")))
    return A.daily_counters(rows, ["alarm", "held", "warm_up", "error"])


@query(f"WITH {_COUNTERS} SELECT * FROM d")
def daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(spark, sf_dir)


@query(f"""WITH {_COUNTERS}, o AS (SELECT *, windows >= 1 AND error / windows > 0.2 AS over FROM d)
SELECT gun, day, count(*) OVER w = 3 AND date_diff('day', min(day) OVER w, max(day) OVER w) = 2 AND bool_and(over) OVER w AS drift FROM o WINDOW w AS (PARTITION BY gun ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def drift_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drift_days(counters(spark, sf_dir), F.col("error") / F.col("windows"), 0.2)


@query(f"""WITH {_COUNTERS} SELECT gun, CAST(sum(windows) AS BIGINT) AS windows, CAST(sum(alarm) AS BIGINT) AS alarm, round(sum(alarm) / nullif(sum(windows) - sum(warm_up) - sum(held), 0), 6) AS alarm_rate FROM d GROUP BY 1""")
def period_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all days and the alarm rate, null where there is no window to judge."""
    d = counters(spark, sf_dir).groupBy("gun").agg(*[F.sum(c).alias(c) for c in ("windows", "alarm", "held", "warm_up")])
    return rounded(d.select("gun", "windows", "alarm", F.try_divide("alarm", F.col("windows") - F.col("warm_up") - F.col("held")).alias("alarm_rate")))


@query(f"""WITH {_GATED}, s AS (SELECT gun, w_end, CASE WHEN error AND alarm THEN 'critical' WHEN alarm OR error THEN 'warning' ELSE 'normal' END AS severity FROM z)
SELECT severity, count(*) AS n, count(DISTINCT gun) AS guns FROM s GROUP BY 1""")
def severity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gated_windows(spark, sf_dir)
    level = A.severity(F.col("error"), F.col("error") & F.col("alarm"), F.lit(False), F.col("alarm"))
    return rows.groupBy(level.alias("severity")).agg(F.count("*").alias("n"), F.count_distinct("gun").alias("guns"))


@query(f"""WITH e AS (SELECT event_id, gun, t FROM ev WHERE code = 'error'), p AS (SELECT gun, t AS start_t, t + {DAY} AS end_t, 'w' || event_id AS episode_id FROM ev WHERE code = 'purchase')
SELECT e.event_id, CASE WHEN p.end_t >= e.t THEN p.episode_id ELSE substr(sha256(e.gun || '|' || e.t), 1, 32) END AS episode_id FROM e ASOF LEFT JOIN p ON e.gun = p.gun AND e.t >= p.start_t""")
def episode_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error takes the id of the purchase that is at most a day old."""
    ev = readings(spark, sf_dir)
    warnings = ev.where("code = 'purchase'").selectExpr("gun", "t as start_t", f"t + {DAY} as end_t", "concat('w', event_id) as episode_id")
    return A.chained_episode(ev.where("code = 'error'").select("event_id", "gun", "t"), warnings).select("event_id", "episode_id")


@query("""SELECT event_id, CASE WHEN value > 80 THEN 'critical' WHEN code = 'error' THEN 'terminal_code' WHEN k < 30 THEN 'cooldown' WHEN gun % 5 = 0 THEN 'handoffs_off' END AS reason FROM ev""")
def warning_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = A.suppression(F.col("value") > 80, F.col("code") == "error", F.col("k") < 30, F.expr("gun % 5 = 0"))
    return readings(spark, sf_dir).select("event_id", reason.alias("reason"))


@query("""SELECT kind, count(*) FILTER (WHERE c) AS n FROM (SELECT unnest(['model', 'model_ng', 'model_quiet', 'model_watch', 'watch', 'stop']) AS kind,
 unnest([a AND g, a, a AND g AND NOT e, (a AND g) OR (e AND NOT x), e AND NOT x, NOT g]) AND NOT u AS c FROM
 (SELECT value >= 40 AS a, k < 70 AS g, code = 'error' AS x, code IN ('error', 'signup') AS e, gun % 4 = 0 AS u FROM ev)) GROUP BY 1""")
def warning_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    kinds = ("model", "model_ng", "model_quiet", "model_watch", "watch", "stop")
    c = lambda kind: A.condition(kind, F.col("value"), F.lit(40), F.col("k") < 70, F.col("code") == "error", F.col("code").isin(*CODES), F.expr("gun % 4 = 0"))
    counts = ev.agg(*[F.count_if(c(k)).alias(k) for k in kinds])
    return counts.unpivot([], list(kinds), "kind", "n")


