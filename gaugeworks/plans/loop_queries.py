"""The model loop over days as ticks: a gun's day stands for a file, its mean value and mean k for two versions' scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.operators import control as C
from gaugeworks.plans.registry import DAY, query, readings

#: 32 variants: margins, whether most files must be won, ratios of false alarms.
VARIANTS = "SELECT CAST(row_number() OVER (ORDER BY margin, majority, ratio) AS BIGINT) AS variant, CAST(16 AS BIGINT) AS first, CAST(5 AS BIGINT) AS fresh, CAST(5 AS BIGINT) AS shadow, CAST(5 AS BIGINT) AS confirm, CAST(margin AS DOUBLE) AS margin, CAST(1 AS DOUBLE) AS noise, majority, CAST(ratio AS DOUBLE) AS ratio FROM (VALUES (0.0), (0.5), (2.0), (5.0)) a(margin), (VALUES (true), (false)) b(majority), (VALUES (0.8), (1.0), (1.2), (9.0)) c(ratio)"

_TICKS = f"""f AS (SELECT t // {DAY} AS day, avg(value) AS odd, avg(k) AS even FROM ev GROUP BY gun, t // {DAY}),
p AS (SELECT day, count(*) AS n, sum(odd - even) AS d, count_if(odd >= even) AS odd_wins, count_if(even >= odd) AS even_wins, count_if(odd > 60) AS odd_fa, count_if(even > 60) AS even_fa FROM f GROUP BY 1),
r AS (SELECT unnest(range(min(day), max(day) + 1)) AS day, min(day) AS first_day FROM f),
ticks AS (SELECT r.day - first_day + 1 AS tick, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS n, round(sum(coalesce(d, 0)) OVER w, 3) AS d, CAST(sum(coalesce(odd_wins, 0)) OVER w AS BIGINT) AS odd_wins, CAST(sum(coalesce(even_wins, 0)) OVER w AS BIGINT) AS even_wins,
 CAST(sum(coalesce(odd_fa, 0)) OVER w AS BIGINT) AS odd_fa, CAST(sum(coalesce(even_fa, 0)) OVER w AS BIGINT) AS even_fa FROM r LEFT JOIN p USING (day) WINDOW w AS (ORDER BY r.day))"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix sums over the files that have ended by each day."""
    ev = readings(spark, sf_dir).withColumn("day", F.expr(f"t div {DAY}"))
    files = ev.groupBy("gun", "day").agg(F.avg("value").alias("odd"), F.avg("k").alias("even"))
    per = files.groupBy("day").agg(
        F.count("*").alias("n"), F.sum(F.col("odd") - F.col("even")).alias("d"), F.count_if(F.col("odd") >= F.col("even")).alias("odd_wins"),
        F.count_if(F.col("even") >= F.col("odd")).alias("even_wins"), F.count_if(F.col("odd") > 60).alias("odd_fa"), F.count_if(F.col("even") > 60).alias("even_fa"),
    )
    days = per.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null").select("first", F.explode(F.sequence("first", "last")).alias("day"))
    w = Window.orderBy("day")  # a row a day
    rows = days.join(per, "day", "left").fillna(0)
    sums = {c: F.sum(c).over(w) for c in ("n", "d", "odd_wins", "even_wins", "odd_fa", "even_fa")}
    return rows.select((F.col("day") - F.col("first") + 1).alias("tick"), *[(F.round(e, 3) if c == "d" else e).alias(c) for c, e in sums.items()])


@query(f"WITH RECURSIVE {_TICKS}, variants AS ({VARIANTS}), {C.control_sql('ticks', 'variants')[len('WITH RECURSIVE ') :]}")
def what_if_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loop does on each day under each of 32 rules, with provisional swaps confirmed or reverted."""
    return C.control(ticks(spark, sf_dir), spark.sql(VARIANTS))


@query(f"WITH RECURSIVE {_TICKS}, variants AS ({VARIANTS}), {C.control_sql('ticks', 'variants')[len('WITH RECURSIVE ') :].replace('SELECT variant, tick, champion, challenger, prev, trim(actions) AS actions FROM loop WHERE tick > 0', '')} SELECT variant, count_if(actions LIKE '%swap:%') AS swaps, count_if(actions LIKE '%revert:%') AS reverts, count_if(actions LIKE '%confirm:%') AS confirms, max(versions) AS versions, arg_max(champion, tick) AS final FROM loop WHERE tick > 0 GROUP BY 1")
def what_if_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps, reverts and confirmations of each rule, versions trained and the last champion."""
    rows = C.control(ticks(spark, sf_dir), spark.sql(VARIANTS))
    has = lambda word: F.count_if(F.col("actions").contains(f"{word}:"))
    versions = F.max(F.greatest("champion", F.coalesce("challenger", "champion"), F.coalesce("prev", "champion")))
    return rows.groupBy("variant").agg(has("swap").alias("swaps"), has("revert").alias("reverts"), has("confirm").alias("confirms"), versions.alias("versions"), F.max_by("champion", "tick").alias("final"))
