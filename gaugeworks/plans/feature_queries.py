"""Queries on preparation, windows and trailing frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import features as W
from gaugeworks.operators import prep as P
from gaugeworks.plans.registry import DAY, HOUR, query, readings, rounded

SIX = 6 * HOUR


@query("SELECT gun, slot, event_id, code FROM (SELECT gun, t // 86400000000 AS slot, event_id, code, row_number() OVER (PARTITION BY gun, t // 86400000000 ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1")
def dedup_last_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).select("gun", F.floor(F.col("t") / DAY).alias("slot"), "event_id", "code")
    return P.last_arrival(rows, "event_id", time="slot")


_GRID = f"g AS (SELECT gun, t // {SIX} * {SIX} AS t, max(value) AS value FROM ev GROUP BY 1, 2)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    return ev.groupBy("gun", (F.floor(F.col("t") / SIX) * SIX).alias("t")).agg(F.max("value").alias("value"))


_FILL = f"""WITH {_GRID}, n AS (SELECT *, coalesce((lead(t) OVER (PARTITION BY gun ORDER BY t) - t) // {SIX} - 1, 0) AS missing FROM g),
x AS (SELECT gun, t + i * {SIX} AS t, value, i > 0 AS filled FROM (SELECT *, unnest(range(0, 1 + {{fits}})) AS i FROM n))
SELECT gun, t, value, filled, CAST(sum(CASE WHEN d > {SIX} THEN 1 ELSE 0 END) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id
FROM (SELECT *, t - lag(t) OVER (PARTITION BY gun ORDER BY t) AS d FROM x)"""


@query(_FILL.format(fits="CASE WHEN missing <= 4 THEN missing ELSE 0 END"))
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fill_gaps(grid(spark, sf_dir), SIX, 4)


@query(_FILL.format(fits="0"))
def gap_fill_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fill_gaps(grid(spark, sf_dir), SIX, 0)


@query(_FILL.format(fits="missing"))
def gap_fill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fill_gaps(grid(spark, sf_dir), SIX, None)


@query(f"SELECT gun, round(1 - count(DISTINCT t // {SIX}) / (max(t // {SIX}) - min(t // {SIX}) + 1), 6) AS missing_rate FROM ev GROUP BY 1")
def missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.missing_rate(readings(spark, sf_dir), SIX))


@query("""WITH b AS (SELECT *, CASE WHEN k > 20 THEN value END AS v, k <= 20 AS non_welding FROM ev)
SELECT event_id, non_welding, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING),
 first_value(v IGNORE NULLS) OVER (PARTITION BY gun ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM b""")
def carry_non_welding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).withColumn("non_welding", P.non_welding(F.col("k"), 20))
    return P.carry(rows, F.col("non_welding"), ["value"]).select("event_id", "non_welding", "value")


@query("""WITH b AS (SELECT *, CASE WHEN k > 20 THEN value END AS v, k <= 20 AS non_welding FROM ev)
SELECT event_id, non_welding, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING),
 first_value(v IGNORE NULLS) OVER (PARTITION BY gun ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM b""")
def carry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a gun's rows in spans of three days."""
    rows = readings(spark, sf_dir).withColumn("non_welding", P.non_welding(F.col("k"), 20))
    return P.carry(rows, F.col("non_welding"), ["value"], chunk=3 * DAY).select("event_id", "non_welding", "value")


@query("""SELECT event_id, round(sin(2 * pi() * m / 1440), 6) AS hour_sin, round(cos(2 * pi() * m / 1440), 6) AS hour_cos, CAST(isodow - 1 AS INTEGER) AS dow
FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, isodow(ts) AS isodow FROM events)""")
def clock_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(readings(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in P.clock(F.col("t")).items()]))


@query(f"SELECT event_id, max(t) OVER (PARTITION BY gun) - t AS ttf, CASE WHEN max(t) OVER (PARTITION BY gun) - t <= {DAY} THEN 1 ELSE 0 END AS label FROM ev")
def ttf_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_ttf(readings(spark, sf_dir), DAY).select("event_id", "ttf", "label")


_BINS = f"""SELECT CASE {{cases}} END AS bin, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT *, max(t) OVER (PARTITION BY gun) - t AS ttf FROM ev) GROUP BY 1"""
_EDGES = (0, DAY, 3 * DAY, 7 * DAY, 30 * DAY)


@query(_BINS.format(cases=" ".join(f"WHEN ttf > {a} AND ttf <= {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False)))))
def horizon_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_ttf(readings(spark, sf_dir), DAY)
    return rounded(rows.groupBy(P.horizon_bin(F.col("ttf"), _EDGES).alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query(_BINS.format(cases=" ".join(f"WHEN ttf >= {a} AND ttf < {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False)))))
def missing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_ttf(readings(spark, sf_dir), DAY)
    return rounded(rows.groupBy(P.horizon_bin(F.col("ttf"), _EDGES, closed_right=False).alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query("""WITH s AS (SELECT avg(value) AS vm, stddev_samp(value) AS vs, avg(k) AS km, stddev_samp(k) AS ks FROM ev WHERE code <> 'error')
SELECT event_id, round((value - vm) / vs, 6) AS value, round((k - km) / ks, 6) AS k FROM ev, s""")
def scaler_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    scaler = P.fit_scaler(ev, ["value", "k"], F.col("code") != "error")
    return rounded(P.z_scores(ev.select("event_id", "value", "k"), scaler, ["value", "k"]))


@query("SELECT event_id, greatest(coalesce(k - lag(k) OVER (PARTITION BY gun ORDER BY t), 0), 0) AS delta FROM ev")
def counter_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", P.increments("k").alias("delta"))


@query(f"""SELECT gun, arg_max(c, t) AS class FROM (SELECT gun, t, CASE code WHEN 'error' THEN 'E01' WHEN 'signup' THEN 'E02' END AS c, max(t) OVER (PARTITION BY gun) - t AS ttf FROM ev)
WHERE ttf <= {3 * DAY} AND c IS NOT NULL GROUP BY 1 UNION ALL SELECT gun, NULL FROM ev GROUP BY 1 HAVING count(*) FILTER (WHERE code IN ('error', 'signup') AND t >= (SELECT max(t) FROM ev e WHERE e.gun = ev.gun) - {3 * DAY}) = 0""")
def class_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inferred_class(readings(spark, sf_dir), 3 * DAY, classes={"error": "E01", "signup": "E02"})


@query(f"SELECT gun, t // {SIX} * {SIX} AS w_start, count(*) AS n, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std, max(CASE WHEN code = 'error' THEN 1 ELSE 0 END) AS error_active FROM ev GROUP BY 1, 2")
def tumbling_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.tumbling(readings(spark, sf_dir), SIX, ["value"], more=[F.max((F.col("code") == "error").cast("int")).alias("error_active")]))


@query(f"SELECT gun, t // {DAY} * {DAY} AS w_start, count(*) AS n, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std FROM ev GROUP BY 1, 2 HAVING count(*) >= 2")
def window_min_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.enough(W.tumbling(readings(spark, sf_dir), DAY, ["value"]), 4))


_ROLLING = f"""SELECT event_id, count(value) OVER w AS value_n, round(sum(value) OVER w, 6) AS value_sum, round(avg(value) OVER w, 6) AS value_avg FROM ev
WINDOW w AS (PARTITION BY gun ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)"""


@query(_ROLLING)
def rolling_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.rolling(readings(spark, sf_dir), DAY, "value").select("event_id", "value_n", "value_sum", "value_avg"))


@query(_ROLLING)
def rolling_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a gun's rows in spans of three days with halos of one."""
    return rounded(W.rolling(readings(spark, sf_dir), DAY, "value", chunk=3 * DAY).select("event_id", "value_n", "value_sum", "value_avg"))


_LOOKBACK = f"""SELECT event_id, round(avg(value) OVER a, 6) AS value_m0, round(avg(value) OVER b, 6) AS value_m1, round(avg(value) OVER c, 6) AS value_m2,
round(avg(value) OVER a - avg(value) OVER c, 6) AS value_drift, round(coalesce(stddev_samp(value) OVER b, 0), 6) AS value_spread FROM ev
WINDOW a AS (PARTITION BY gun ORDER BY t RANGE BETWEEN {SIX - 1} PRECEDING AND CURRENT ROW), b AS (PARTITION BY gun ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW),
c AS (PARTITION BY gun ORDER BY t RANGE BETWEEN {7 * DAY - 1} PRECEDING AND CURRENT ROW)"""


@query(_LOOKBACK)
def lookback_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.lookback(readings(spark, sf_dir), "value", [SIX, DAY, 7 * DAY]).select("event_id", "value_m0", "value_m1", "value_m2", "value_drift", "value_spread"))


@query(_LOOKBACK)
def lookback_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a gun's rows in spans of five days with halos of seven."""
    return rounded(W.lookback(readings(spark, sf_dir), "value", [SIX, DAY, 7 * DAY], chunk=5 * DAY).select("event_id", "value_m0", "value_m1", "value_m2", "value_drift", "value_spread"))


_FUSED = f"""SELECT event_id, round((value + avg(value) OVER a) / 2, 6) AS fused_mean, round(greatest(value, avg(value) OVER a), 6) AS fused_max FROM ev
WINDOW a AS (PARTITION BY gun ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)"""


@query(_FUSED)
def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.fused(readings(spark, sf_dir), "value", DAY).select("event_id", "fused_mean", "fused_max"))


@query(_FUSED)
def score_fusion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a gun's rows in spans of three days."""
    return rounded(W.fused(readings(spark, sf_dir), "value", DAY, chunk=3 * DAY).select("event_id", "fused_mean", "fused_max"))


@query(f"SELECT event_id, round(value - avg(CASE WHEN ttf > {2 * DAY} THEN value END) OVER (PARTITION BY gun), 4) AS value_centred FROM (SELECT *, max(t) OVER (PARTITION BY gun) - t AS ttf FROM ev)")
def gun_centering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_ttf(readings(spark, sf_dir), DAY)
    return rounded(W.centred(rows, "value", F.col("ttf") > 2 * DAY).select("event_id", "value_centred"), 4)


@query(f"""WITH b AS (SELECT gun, t // {DAY} + 1 AS block, avg(value) AS m, count(value) AS n FROM ev GROUP BY 1, 2)
SELECT event_id, round(value - CASE WHEN n >= 2 THEN m ELSE 0 END, 6) AS value_recentred FROM ev LEFT JOIN b ON b.gun = ev.gun AND b.block = ev.t // {DAY}""")
def recentre_previous_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.recentred(readings(spark, sf_dir), "value", DAY, 2).select("event_id", "value_recentred"))


@query(f"""WITH r AS (SELECT *, max(t) OVER (PARTITION BY gun) - t AS ttf FROM ev), b AS (SELECT k, avg(value) AS m FROM r WHERE ttf > {7 * DAY} GROUP BY 1 HAVING count(value) >= 5)
SELECT event_id, round(value - m, 6) AS residual FROM r LEFT JOIN b USING (k)""")
def program_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_ttf(readings(spark, sf_dir), DAY)
    return rounded(W.residual(rows, "value", "k", F.col("ttf") > 7 * DAY, 5).select("event_id", "residual"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY gun ORDER BY t) AS n FROM ev) WHERE (n - 1) % 10 = 0")
def every_kth_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.every_kth(readings(spark, sf_dir), 10).select("event_id")


@query(f"""SELECT gun, coalesce(min(CASE WHEN code = 'error' AND e - t <= {2 * DAY} THEN t END), max(e) - {DAY}) AS at FROM (SELECT *, max(t) OVER (PARTITION BY gun) AS e FROM ev) GROUP BY 1""")
def first_own_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_in_last(readings(spark, sf_dir), F.col("code") == "error", 2 * DAY, DAY)


@query(f"""SELECT gun, t // {DAY} * {DAY} AS w_start, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90,
round(max(value) - min(value), 6) AS range, round(avg(s), 6) AS step_mean, max(s) AS step_max FROM
(SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY gun ORDER BY t) <= {SIX} THEN t - lag(t) OVER (PARTITION BY gun ORDER BY t) END AS s FROM ev) GROUP BY 1, 2""")
def distribution_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.quantile_features(readings(spark, sf_dir), DAY, "value", pause=SIX))


@query("""SELECT gun, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high, round(arg_max(value, t) - arg_min(value, t), 6) AS rise,
avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS zero_share, round(avg(d), 6) AS mean_step FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY gun ORDER BY t)) AS d FROM ev) GROUP BY 1""")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.series_summary(readings(spark, sf_dir), "value"))
