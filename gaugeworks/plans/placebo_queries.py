"""Queries on placebo anchors: three lines of guns, windows of an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import placebos as B
from gaugeworks.plans.registry import DAY, HOUR, drawn, query, readings, rounded

TRIES, PLACEBOS, FOLDS, TOLERANCE, LEAST_POS, LEAST_NEG = 60, 20, 3, 5.0, 3, 6
COLUMNS = ["value", "err", "n"]
TARGET, CONTROL, MOVED = (6 * HOUR, 16 * HOUR), (DAY, 12 * DAY), (12 * HOUR, 15 * DAY)

_SETS = f"""w AS (SELECT gun % 3 AS gun, t // {HOUR} * {HOUR} AS slot, avg(value) AS value, avg(CASE WHEN code = 'error' THEN 1.0 ELSE 0.0 END) AS err, avg(k % 7) AS n, round(avg(k % 2), 0) AS setpoint FROM ev GROUP BY 1, 2),
e AS (SELECT gun, max(slot) AS e FROM w GROUP BY 1), a AS (SELECT gun, anchor, e - CASE WHEN anchor = 0 THEN 0 ELSE {MOVED[0]} + CAST(floor({drawn("0", "gun", "anchor")} * {MOVED[1] - MOVED[0]}) AS BIGINT) END AS moment FROM e, (SELECT unnest(range(0, {TRIES + 1})) AS anchor)),
r AS (SELECT w.gun, anchor, slot, setpoint, 24.0::DOUBLE / {DAY} * (slot % {DAY}) AS clock, CASE WHEN slot >= moment - {TARGET[1]} AND slot < moment - {TARGET[0]} THEN 1 ELSE 0 END AS label FROM w JOIN a ON w.gun = a.gun
  AND ((slot >= moment - {TARGET[1]} AND slot < moment - {TARGET[0]}) OR (slot >= moment - {CONTROL[1]} AND slot < moment - {CONTROL[0]}))),
c AS (SELECT gun, anchor, round((atan2(round(avg(sin(clock * pi() / 12)), 9), round(avg(cos(clock * pi() / 12)), 9)) * 12 / pi() + 24) % 24, 6) AS centre, list(DISTINCT setpoint) AS points FROM r WHERE label = 1 GROUP BY 1, 2),
m AS (SELECT gun, anchor, slot, label FROM r JOIN c USING (gun, anchor) WHERE label = 1 OR (list_contains(points, setpoint) AND round(least(abs(clock - centre), 24 - abs(clock - centre)), 5) <= {TOLERANCE})),
s AS (SELECT gun, anchor, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM m GROUP BY 1, 2 HAVING p >= {LEAST_POS} AND q >= {LEAST_NEG}),
z AS (SELECT *, CASE WHEN anchor = 0 THEN 0 ELSE sum(CASE WHEN anchor = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY gun ORDER BY anchor) END AS number FROM s),
sets AS (SELECT gun, CAST(number AS BIGINT) AS anchor, slot, label, (row_number() OVER (PARTITION BY gun, anchor, label ORDER BY slot) - 1) * {FOLDS} // CASE WHEN label = 1 THEN p ELSE q END AS fold FROM m JOIN z USING (gun, anchor) WHERE number <= {PLACEBOS})"""
_EFFECTS = f"""WITH {_SETS}, v AS (SELECT gun, anchor, label, unnest(['value', 'err', 'n']) AS feature, unnest([coalesce(value, 0), coalesce(err, 0), coalesce(n, 0)]) AS v FROM sets JOIN w USING (gun, slot)),
f AS (SELECT gun, anchor, feature, (avg(v) FILTER (WHERE label = 1) - avg(v) FILTER (WHERE label = 0)) / (stddev_pop(v) FILTER (WHERE label = 0) + 1e-6) AS effect FROM v GROUP BY 1, 2, 3)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir).select((F.col("gun") % 3).alias("gun"), "t", "value", (F.col("code") == "error").cast("double").alias("err"), (F.col("k") % 7).alias("n"), (F.col("k") % 2).alias("band"))
    return B.slots(ev, COLUMNS, HOUR, "band", 0)


def _sets(windows: DataFrame) -> DataFrame:
    return B.matched_windows(windows, B.anchors(windows, *MOVED, TRIES), TARGET, CONTROL, DAY, TOLERANCE, LEAST_POS, LEAST_NEG, PLACEBOS, FOLDS)


@query(f"WITH {_SETS} SELECT gun, anchor, slot, label, fold FROM sets")
def placebo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(_windows(spark, sf_dir))


@query(f"{_EFFECTS} SELECT gun, anchor, feature, round(effect, 6) AS effect FROM f")
def placebo_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    return rounded(B.effects(w, _sets(w), COLUMNS))


@query(f"""{_EFFECTS}, u AS (SELECT gun, anchor, feature, effect / (sqrt(sum(effect * effect) OVER (PARTITION BY gun, anchor)) + 1e-9) AS u FROM f),
p AS (SELECT x.anchor, x.gun AS g, y.gun AS h, sum(x.u * y.u) AS c FROM u x JOIN u y ON x.anchor = y.anchor AND x.feature = y.feature AND x.gun <> y.gun GROUP BY 1, 2, 3)
SELECT k.anchor, k.keys, round(c.c, 6) AS cosine FROM (SELECT anchor, count(DISTINCT gun) AS keys FROM f GROUP BY 1) k LEFT JOIN (SELECT anchor, avg(c) AS c FROM p GROUP BY 1) c ON k.anchor = c.anchor""")
def placebo_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    return rounded(B.agreement(B.effects(w, _sets(w), COLUMNS)))


@query()
def placebo_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a regression for each anchor. Held against a gradient descent and planted shifts in the tests."""
    w = _windows(spark, sf_dir)
    return rounded(B.against_placebos(B.anchored_auroc(w, _sets(w), COLUMNS), 5), 4)
