"""Queries on offline analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import experiments as X
from gaugeworks.operators import intervals as I
from gaugeworks.operators import prep as P
from gaugeworks.plans.registry import DAY, HOUR, drawn, query, readings, rounded

SIX = 6 * HOUR
_TTF = "r AS (SELECT *, max(t) OVER (PARTITION BY gun) - t AS ttf FROM ev)"


@query(f"""SELECT gun, t // {DAY} AS slot, count(*) AS n, count(*) FILTER (WHERE code = 'click') AS n_weld, count(*) FILTER (WHERE code <> 'error') AS n_press,
round(CASE WHEN count(*) FILTER (WHERE code = 'click') >= 3 THEN quantile_cont(value, 0.5) FILTER (WHERE code = 'click') END, 6) AS weld_median, round(avg(value) FILTER (WHERE code <> 'error'), 6) AS press_mean,
round(avg(CASE WHEN code <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS press_share FROM ev GROUP BY 1, 2""")
def minute_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.minute_profile(readings(spark, sf_dir), DAY, F.col("code") == "click", F.col("code") != "error", "value"))


@query(f"""WITH a AS (SELECT gun, t // {DAY} AS slot, count(*) AS clicks FROM ev WHERE code = 'click' GROUP BY 1, 2), b AS (SELECT gun, t // {DAY} AS slot, round(max(value), 6) AS top FROM ev WHERE code = 'error' GROUP BY 1, 2)
SELECT coalesce(a.gun, b.gun) AS gun, coalesce(a.slot, b.slot) AS slot, clicks, top FROM a FULL OUTER JOIN b ON a.gun = b.gun AND a.slot = b.slot""")
def chart_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir).withColumn("slot", F.floor(F.col("t") / DAY))
    a = ev.where("code = 'click'").groupBy("gun", "slot").agg(F.count("*").alias("clicks"))
    b = ev.where("code = 'error'").groupBy("gun", "slot").agg(F.max("value").alias("top"))
    return rounded(X.joined_minutes(a, b, ["gun", "slot"]))


@query("""WITH r AS (SELECT gun, rid, min(code) AS code, max(t) - min(t) AS duration FROM (SELECT *, sum(n) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS rid FROM
 (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR code <> lag(code) OVER w THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY gun ORDER BY t))) GROUP BY 1, 2)
SELECT code, count(*) AS episodes, count(DISTINCT gun) AS keys, quantile_cont(duration, 0.5) AS median_duration, max(duration) AS longest, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY 1""")
def episode_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.episode_statistics(I.runs(readings(spark, sf_dir), "code")))


@query(f"""SELECT gun, (e - t) // {5 * DAY} AS bin, count(*) FILTER (WHERE nx - t > {DAY}) AS starts, count(*) AS n FROM (SELECT gun, t, lead(t) OVER (PARTITION BY gun ORDER BY t) AS nx, max(t) OVER (PARTITION BY gun) AS e FROM ev) GROUP BY 1, 2""")
def gap_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gap_starts(readings(spark, sf_dir), DAY, 5 * DAY)


@query("SELECT code, round(corr(value, k), 6) AS r, round(quantile_cont(value / nullif(k, 0), 0.5), 6) AS ratio, round(avg(CASE WHEN abs(value / nullif(k, 0) - 1) <= 0.1 THEN 1.0 WHEN k <> 0 THEN 0.0 END), 6) AS agree FROM ev GROUP BY 1")
def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.pair_agreement(readings(spark, sf_dir), "value", "k", ["code"]))


@query("""SELECT gun, kind, count(*) AS n, round(quantile_cont(step, 0.5), 6) AS median_step FROM (SELECT gun, step, CASE WHEN step <= -50 THEN 'cap_change' WHEN step BETWEEN 5 AND 30 THEN 'dressing' WHEN step IS NOT NULL THEN 'other' END AS kind FROM
(SELECT gun, value - lag(value) OVER (PARTITION BY gun ORDER BY t) AS step FROM ev)) WHERE kind IS NOT NULL GROUP BY 1, 2""")
def cap_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.cap_cycle(readings(spark, sf_dir), "value", dress=(5, 30), change=-50).where("kind is not null")
    return rounded(rows.groupBy("gun", "kind").agg(F.count("*").alias("n"), F.percentile("step", F.lit(0.5)).alias("median_step")))


@query("""SELECT code, signal, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS on_share FROM (SELECT code, unnest(['high', 'odd']) AS signal, unnest([CASE WHEN k >= 50 THEN 1 ELSE 0 END, k % 2]) AS x FROM ev) GROUP BY 1, 2""")
def on_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir).selectExpr("code", "int(k >= 50) as high", "k % 2 as odd")
    return rounded(X.on_shares(ev, ["high", "odd"], ["code"]))


_WARM = f"""c AS (SELECT *, sum(CASE WHEN code <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM ev),
w AS (SELECT gun, least(min(CASE WHEN n >= 20 AND code <> 'error' THEN t END), min(t) + {10 * DAY}) AS ends_at, CASE WHEN min(CASE WHEN n >= 20 AND code <> 'error' THEN t END) < min(t) + {10 * DAY} THEN 'gun' ELSE 'global' END AS source FROM c GROUP BY 1)"""


@query(f"WITH {_WARM} SELECT * FROM w")
def warm_up_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.warm_up_end(readings(spark, sf_dir), F.col("code") != "error", 10 * DAY, 20)


@query(f"WITH {_WARM} SELECT event_id, CASE WHEN t >= ends_at AND source = 'gun' THEN 80 ELSE 60 END AS threshold FROM ev JOIN w USING (gun)")
def regime_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    ends = X.warm_up_end(ev, F.col("code") != "error", 10 * DAY, 20)
    own = F.when(F.col("source") == "gun", 80).otherwise(60)
    return X.regime_threshold(ev.withColumn("w_start", F.col("t")), ends, own, F.lit(60)).select("event_id", "threshold")


@query(f"""WITH w AS (SELECT DISTINCT gun, (t // {SIX} + 1) * {SIX} AS w_end FROM ev WHERE code <> 'error') SELECT e.event_id, coalesce((SELECT min(w_end) FROM w WHERE w.gun = e.gun AND w_end >= e.t), (SELECT max(w_end) FROM w WHERE w.gun = e.gun)) AS w_end
FROM ev e WHERE code = 'error'""")
def event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    windows = ev.where("code <> 'error'").select("gun", ((F.floor(F.col("t") / SIX) + 1) * SIX).alias("w_end")).distinct()
    return X.event_window(windows, ev.where("code = 'error'"))


@query(f"WITH {_TTF} SELECT code, round(avg(CASE WHEN value >= 60 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ttf > {DAY}), 6) AS normal_alarm_rate, round(avg(CASE WHEN value >= 60 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ttf <= {DAY}), 6) AS recall FROM r GROUP BY 1")
def alarm_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_ttf(readings(spark, sf_dir), DAY).withColumn("alarm", F.col("value") >= 60)
    return rounded(X.alarm_rates(rows, "alarm", "label", ["code"]))


@query(f"WITH {_TTF}, p AS (SELECT gun, max(CASE WHEN ttf <= {3 * DAY} THEN ttf END) AS lead, count(*) FILTER (WHERE ttf > {3 * DAY}) AS wrong FROM r WHERE code = 'error' GROUP BY 1) SELECT count(*) AS keys, count(lead) AS hits, quantile_cont(lead, 0.5) AS median_lead, CAST(sum(wrong) AS BIGINT) AS false_triggers FROM p")
def rule_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rule_baseline(P.with_ttf(readings(spark, sf_dir), DAY).where("code = 'error'"), 3 * DAY)


@query(f"""WITH d AS (SELECT gun, t // {SIX} AS slot, max(value) >= 40 AS alarm FROM ev GROUP BY 1, 2), i AS (SELECT *, slot - row_number() OVER (PARTITION BY gun ORDER BY slot) AS i FROM d WHERE alarm),
r AS (SELECT gun, min(slot) AS first, count(*) AS length FROM i GROUP BY gun, i), g AS (SELECT * FROM r, (SELECT unnest([1, 2, 3]) AS sustain), (SELECT unnest([0, 4, 8]) AS hold) WHERE length >= sustain),
l AS (SELECT *, lag(first + length) OVER (PARTITION BY gun, sustain, hold ORDER BY first) AS b FROM g)
SELECT sustain, hold, count(*) FILTER (WHERE b IS NULL OR first - b >= hold) AS alarms, count(*) AS runs FROM l GROUP BY 1, 2""")
def alarm_policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = readings(spark, sf_dir).groupBy("gun", F.floor(F.col("t") / SIX).alias("slot")).agg((F.max("value") >= 40).alias("alarm"))
    return X.policy_grid(slots, "alarm", [1, 2, 3], [0, 4, 8])


@query("""WITH g AS (SELECT s AS share_least, d AS deviation_least, gun AS event_id, count(*) FILTER (WHERE k / 100.0 >= s AND abs(value - 50) >= d) AS n FROM ev, (SELECT unnest([0.3, 0.6, 0.9]) AS s), (SELECT unnest([10.0, 40.0]) AS d) GROUP BY 1, 2, 3)
SELECT CAST(share_least AS DOUBLE) AS share_least, CAST(deviation_least AS DOUBLE) AS deviation_least, quantile_cont(n, 0.5) AS median, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM g GROUP BY 1, 2""")
def findings_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).selectExpr("gun as event_id", "k / 100.0D as share", "value - 50 as deviation")
    return rounded(X.findings_sweep(rows, [0.3, 0.6, 0.9], [10.0, 40.0]))


@query("""WITH a AS (SELECT code, quantile_cont(value, 0.9) AS q FROM ev GROUP BY 1), o AS (SELECT gun, code, quantile_cont(value, 0.9) AS q FROM ev GROUP BY 1, 2 HAVING count(value) >= 10)
SELECT event_id, round(value - greatest(a.q, coalesce(o.q, a.q)), 6) AS margin FROM ev JOIN a USING (code) LEFT JOIN o ON o.gun = ev.gun AND o.code = ev.code""")
def type_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.type_thresholds(readings(spark, sf_dir), "value", "code", 0.9).select("event_id", "margin"))


@query(f"""WITH a AS (SELECT gun, t FROM ev WHERE code = 'click'), f AS (SELECT gun, t FROM ev WHERE code = 'error')
SELECT (SELECT count(*) FROM a) AS alerts, round((SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.gun = a.gun AND f.t - a.t > {HOUR} AND f.t - a.t <= {DAY}) THEN 1.0 ELSE 0.0 END) FROM a), 6) AS precision,
(SELECT count(*) FROM f) AS failures, round((SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM a WHERE f.gun = a.gun AND f.t - a.t > {HOUR} AND f.t - a.t <= {DAY}) THEN 1.0 ELSE 0.0 END) FROM f), 6) AS recall""".replace("WITH a", "WITH a"))
def watch_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    return rounded(X.watch_rule(ev.where("code = 'click'"), ev.where("code = 'error'"), HOUR, DAY))


@query(f"SELECT e.event_id, count(p.value) AS n, round(avg(p.value), 6) AS mean FROM (SELECT * FROM ev WHERE code = 'error') e JOIN ev p ON p.gun = e.gun AND p.t > e.t AND p.t <= e.t + {DAY} GROUP BY 1 HAVING count(p.value) >= 2")
def after_event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    return rounded(X.after_event_features(ev, ev.where("code = 'error'"), "value", DAY, 2, 12 * HOUR))


_EDGES = (0, DAY, 3 * DAY, 7 * DAY)


@query(f"""WITH {_TTF}, s AS (SELECT ttf - shift AS x, shift, value FROM r, (SELECT unnest([0, {DAY}, {7 * DAY}]) AS shift)), b AS (SELECT shift, CASE WHEN x > 0 AND x <= {DAY} THEN 0 WHEN x > {DAY} AND x <= {3 * DAY} THEN 1 WHEN x > {3 * DAY} AND x <= {7 * DAY} THEN 2 END AS bin, value FROM s)
SELECT CAST(shift AS BIGINT) AS shift, bin, count(*) AS n, round(avg(value), 6) AS mean_score, round(avg(CASE WHEN value >= 60 THEN 1.0 ELSE 0.0 END), 6) AS alarm_rate FROM b WHERE bin IS NOT NULL GROUP BY 1, 2""")
def horizon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.horizon_table(P.with_ttf(readings(spark, sf_dir), DAY), "value", 60, _EDGES, [0, DAY, 7 * DAY])
    return rounded(out.withColumn("shift", F.col("shift").cast("long")))


@query("""WITH n AS (SELECT gun, code, (row_number() OVER (PARTITION BY gun ORDER BY t DESC) - 1) // 10 AS block FROM ev) SELECT gun, block, round(avg(CASE WHEN code = 'error' THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM n GROUP BY 1, 2 HAVING count(*) = 10""")
def block_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.block_missing(readings(spark, sf_dir), F.col("code") == "error", 10))


@query("""SELECT event_id, since_click, since_view FROM (SELECT *, t - max(CASE WHEN code = 'click' THEN t END) OVER w AS since_click, t - max(CASE WHEN code = 'view' THEN t END) OVER w AS since_view FROM ev WINDOW w AS (PARTITION BY gun ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE code = 'error'""")
def last_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.last_of_kinds(readings(spark, sf_dir), ["click", "view"], F.col("code") == "error").select("event_id", "since_click", "since_view")


@query(f"""SELECT e.gun, e.t AS tick, arg_max(p.t, (p.value, -p.t)) AS at, max(p.value) AS value FROM (SELECT * FROM ev WHERE code = 'error') e JOIN ev p ON p.gun = e.gun AND p.t BETWEEN e.t - {SIX} AND e.t + {DAY} GROUP BY 1, 2""")
def moment_of_press(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    return X.moment_of(ev.where("code = 'error'"), ev, "value", SIX, DAY, 12 * HOUR)


@query("""WITH o AS (SELECT gun, quantile_cont(CASE WHEN code <> 'error' THEN value END, 0.95) AS q FROM ev GROUP BY 1 HAVING count(CASE WHEN code <> 'error' THEN value END) >= 40)
SELECT code, count(*) AS n, round(avg(CASE WHEN value > q THEN 1.0 ELSE 0.0 END), 6) AS unusual FROM ev JOIN o USING (gun) GROUP BY 1""")
def unusual_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.unusual_rate(readings(spark, sf_dir), "value", "code", F.col("code") != "error", least=40))


@query(f"""WITH o AS (SELECT gun, t // {5 * DAY} AS run, avg(value) AS v FROM ev GROUP BY 1, 2), m AS (SELECT gun, avg(v) AS m FROM o GROUP BY 1) SELECT round(avg(m), 6) AS mean, count(*) AS keys FROM m""")
def pooled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.pooled_runs(readings(spark, sf_dir).withColumn("run", F.floor(F.col("t") / (5 * DAY))), "value", "run"))


@query(f"""WITH u AS (SELECT value AS s, t - max(CASE WHEN code = 'error' THEN t END) OVER p AS since, min(CASE WHEN code = 'error' THEN t END) OVER n - t AS until FROM ev
 WINDOW p AS (PARTITION BY gun ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY gun ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
l AS (SELECT s, CASE WHEN coalesce(since > {HOUR}, true) AND until <= {DAY} THEN 1 WHEN coalesce(since > {HOUR}, true) AND coalesce(until > {2 * DAY}, true) THEN 0 END AS y FROM u),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM l WHERE y IS NOT NULL)
SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auroc FROM k""")
def event_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.separation(readings(spark, sf_dir), "value", F.col("code") == "error", DAY, 2 * DAY, HOUR))


@query(f"""WITH o AS (SELECT gun, avg(value) AS v, max(k) >= 95 AS flag FROM ev GROUP BY 1), m AS (SELECT count(*) FILTER (WHERE flag) AS m FROM o),
c AS (SELECT i, v, CASE WHEN i = 0 THEN flag ELSE row_number() OVER (PARTITION BY i ORDER BY {drawn("0", "i", "gun")}, gun) <= m END AS c FROM o, m, (SELECT unnest(range(0, 201)) AS i)),
d AS (SELECT i, avg(v) FILTER (WHERE c) - avg(v) FILTER (WHERE NOT c) AS d FROM c GROUP BY 1)
SELECT round(max(d) FILTER (WHERE i = 0), 6) AS difference, round((1 + count(*) FILTER (WHERE i > 0 AND abs(d) >= (SELECT abs(d) FROM d WHERE i = 0))) / 201.0, 6) AS p FROM d""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = readings(spark, sf_dir).groupBy("gun").agg(F.avg("value").alias("v"), (F.max("k") >= 95).alias("flag"))
    return rounded(X.permuted(own, "v", "flag", "gun", 200))


@query(f"""WITH e AS (SELECT gun, t FROM ev WHERE code = 'error'), s AS (SELECT gun, t AS original, t - {DAY} - CAST(floor({drawn("0", "gun", "t")} * {DAY}) AS BIGINT) AS t FROM e)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.gun = s.gun AND abs(e.t - s.t) <= {SIX})""")
def pseudo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir).where("code = 'error'")
    return X.pseudo_events(ev, ev, DAY, 2 * DAY, SIX)


@query()
def two_sample_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).withColumn("y", (F.col("code") == "error").cast("double")).withColumn("fold", F.expr("int(gun % 3)"))
    return rounded(X.two_sample(rows, ["value", "k"], "y", "fold", 3))


@query("""WITH s AS (SELECT stddev_samp(value) AS sd FROM ev), g AS (SELECT shift, value + CASE WHEN code = 'error' THEN shift * sd ELSE 0 END AS s, CASE WHEN code = 'error' THEN 1 ELSE 0 END AS y FROM ev, s, (SELECT unnest([0.0, 0.5, 1.0]) AS shift)),
k AS (SELECT shift, y, rank() OVER (PARTITION BY shift ORDER BY s) + (count(*) OVER (PARTITION BY shift, s) - 1) / 2.0 AS rk FROM g)
SELECT CAST(shift AS DOUBLE) AS shift, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 4) AS auroc FROM k GROUP BY 1""")
def detection_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).withColumn("y", (F.col("code") == "error").cast("int"))
    return rounded(X.detectable(rows, "value", "y", [0.0, 0.5, 1.0]), 4)


@query(f"""WITH g AS (SELECT *, sum(n) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY gun ORDER BY t) > {2 * DAY} THEN 1 ELSE 0 END AS n FROM ev)),
r AS (SELECT *, row_number() OVER (PARTITION BY gun, seg ORDER BY t) AS i, count(*) OVER (PARTITION BY gun, seg) AS c FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {drawn("0", "gun", "t")}, gun, t) AS p FROM r WHERE i >= 5 AND c - i >= 3)
SELECT event_id, gun, t, code FROM p WHERE p <= 20""")
def forecast_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.with_segments(readings(spark, sf_dir), 2 * DAY)
    return X.forecast_origins(rows, 5, 3, 20, "code").select("event_id", "gun", "t", "code")
