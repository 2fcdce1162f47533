"""Queries on statistics, detection metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import prep as P
from gaugeworks.operators import stats as S
from gaugeworks.operators.intervals import ordered
from gaugeworks.plans.registry import DAY, HOUR, drawn, query, readings, rounded, table

SIX = 6 * HOUR
TYPES = ("click", "error", "purchase", "signup", "view")

_AUC = """WITH r AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY s) + (count(*) OVER (PARTITION BY {key}, s) - 1) / 2.0 AS rk FROM ({rows}))
SELECT {out} CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
round(CASE WHEN sum(y) >= {lp} AND sum(1 - y) >= {ln} THEN (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) END, 6) AS auroc FROM r {group}"""


@query(_AUC.format(key="1", rows="SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)", out="", lp=1, ln=1, group=""))
def auroc_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(S.auroc(rows, "n_chars", "quality"))


@query(_AUC.format(key="gun", rows="SELECT gun, value AS s, CASE WHEN code = 'error' THEN 1 ELSE 0 END AS y FROM ev", out="gun,", lp=2, ln=20, group="GROUP BY gun"))
def auroc_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir).withColumn("y", (F.col("code") == "error").cast("int"))
    return rounded(S.auroc(ev, "value", "y", ["gun"], 2, 20))


@query("""SELECT event_id, round((rank() OVER (PARTITION BY gun ORDER BY k) - 1 + count(*) OVER (PARTITION BY gun, k) / 2.0) / count(*) OVER (PARTITION BY gun), 6) AS rank_share FROM ev""")
def percentile_rank_half_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.rank_share(readings(spark, sf_dir), "k", "gun").select("event_id", "rank_share"))


_P = "p AS (SELECT o_orderpriority || o_orderstatus AS test, round(avg(CASE WHEN o_totalprice > 400000 THEN 1.0 ELSE 0.0 END) / 10, 9) AS p FROM orders GROUP BY 1)"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("test")).agg(F.round(F.avg((F.col("o_totalprice") > 400000).cast("double")) / 10, 9).alias("p"))


@query(f"WITH {_P}, r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, test) AS raw FROM p) SELECT test, p, round(least(min(raw) OVER (ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS q FROM r")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bh_adjusted(_tests(spark, sf_dir)).withColumn("q", F.round("q", 6))


@query(f"WITH {_P}, r AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) AS raw FROM p) SELECT test, p, round(least(max(raw) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 1), 6) AS p_holm FROM r")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holm_adjusted(_tests(spark, sf_dir)).withColumn("p_holm", F.round("p_holm", 6))


@query("""WITH s AS (SELECT gun, count(*) FILTER (WHERE code = 'error' AND k >= 50) AS a, count(*) FILTER (WHERE code = 'error' AND k < 50) AS b,
count(*) FILTER (WHERE code <> 'error' AND k >= 50) AS c, count(*) FILTER (WHERE code <> 'error' AND k < 50) AS d, count(*) AS n FROM ev GROUP BY 1)
SELECT round(sum(a * d / n) / sum(b * c / n), 6) AS odds_ratio, count(*) AS n_strata FROM s""")
def matched_odds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir).selectExpr("gun", "cast(code = 'error' as int) as y", "cast(k >= 50 as int) as x")
    return rounded(S.matched_odds(ev, "gun", "y", "x"))


@query("""WITH c AS (SELECT code, quantile_cont(value, 0.5) AS location, stddev_samp(value) AS sd FROM ev GROUP BY 1)
SELECT code, round(min(location), 6) AS location, round(greatest(1.4826 * quantile_cont(abs(value - location), 0.5), 0.1 * min(sd)), 6) AS scale FROM ev JOIN c USING (code) GROUP BY 1""")
def robust_location_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.robust(readings(spark, sf_dir), "value", ["code"]))


_G = "(SELECT quantile_cont(value, 0.9) FROM ev)"


@query(f"SELECT gun, round(CASE WHEN count(CASE WHEN code <> 'error' THEN value END) >= 10 THEN greatest({_G}, quantile_cont(CASE WHEN code <> 'error' THEN value END, 0.99)) ELSE {_G} END, 6) AS threshold FROM ev GROUP BY 1")
def gun_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.key_threshold(readings(spark, sf_dir), "value", F.col("code") != "error"))


@query(f"""WITH e AS (SELECT *, t < min(t) OVER (PARTITION BY gun) + {5 * DAY} AS early FROM ev)
SELECT gun, count(value) FILTER (WHERE early) AS n, round(CASE WHEN count(value) FILTER (WHERE early) >= 5 THEN avg(value) FILTER (WHERE early) END, 6) AS mean,
round(CASE WHEN count(value) FILTER (WHERE early) >= 5 THEN greatest(stddev_pop(value) FILTER (WHERE early), 0.5) END, 6) AS std FROM e GROUP BY 1""")
def warm_up_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.warm_up_stats(readings(spark, sf_dir), "value", 5 * DAY, 5, 0.5))


_MODES = ("A", "N", "R")


@query("""SELECT coalesce(l_linestatus, 'all') AS l_linestatus, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 4) AS A, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 4) AS N,
round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS R FROM lineitem GROUP BY ROLLUP (l_linestatus)""")
def pivot_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.pivot_with_total(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", _MODES, "l_extendedprice"), 4)


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O", "P"))


@query("""SELECT l_returnflag, "column", count(x) AS n, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END), 4) AS zero_share, count(DISTINCT x) AS "distinct", round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS low,
round(quantile_cont(x, 0.01), 4) AS p01, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.99), 4) AS p99, round(max(x), 4) AS high FROM
(SELECT l_returnflag, unnest(['l_quantity', 'l_discount', 'l_tax']) AS "column", unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem) GROUP BY 1, 2""")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.column_statistics(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"]), 4)


_STEPS = "s AS (SELECT code, (t - lag(t) OVER (PARTITION BY gun ORDER BY t)) / 1000000.0 AS step FROM ev)"


@query(f"WITH {_STEPS} SELECT code, count(step) AS n, round(avg(step), 4) AS mean, round(stddev_samp(step), 4) AS std, round(min(step), 4) AS low, round(quantile_cont(step, 0.5), 4) AS p50, round(quantile_cont(step, 0.9), 4) AS p90, round(quantile_cont(step, 0.99), 4) AS p99, round(max(step), 4) AS high FROM s GROUP BY 1")
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    rows = ev.select("code", ((F.col("t") - F.lag("t").over(ordered("gun", "t"))) / 1e6).alias("step"))
    q = S.quantiles(rows, "step", [0.5, 0.9, 0.99], ["code"]).select("code", *[F.col("quantiles")[i].alias(p) for i, p in enumerate(("p50", "p90", "p99"))])
    out = rows.groupBy("code").agg(F.count("step").alias("n"), F.avg("step").alias("mean"), F.stddev_samp("step").alias("std"), F.min("step").alias("low"), F.max("step").alias("high"))
    return rounded(S.same_keys(out, q, ["code"], "left"), 4)


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("WITH n AS (SELECT gun, k, count(*) AS c FROM ev GROUP BY 1, 2) SELECT gun, min(k) AS mode FROM n WHERE c = (SELECT max(c) FROM n m WHERE m.gun = n.gun) GROUP BY 1")
def smallest_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.smallest_mode(readings(spark, sf_dir), "k", ["gun"])


@query("SELECT round((avg(value) FILTER (WHERE code = 'error') - avg(value) FILTER (WHERE code <> 'error')) / sqrt((var_samp(value) FILTER (WHERE code <> 'error') + var_samp(value) FILTER (WHERE code = 'error')) / 2), 6) AS effect FROM ev")
def effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.effect_size(readings(spark, sf_dir), "value", F.col("code") == "error"))


@query("SELECT code, round(quantile_cont(m, 0.5), 6) AS value FROM (SELECT code, gun, quantile_cont(value, 0.5) AS m FROM ev GROUP BY 1, 2) GROUP BY 1")
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.median_of_medians(readings(spark, sf_dir), "value", "code"))


@query("""WITH l AS (SELECT gun, p, avg(CASE WHEN code = b THEN 1.0 ELSE 0.0 END) AS match FROM (SELECT gun, code, unnest(range(1, 6)) AS p,
 unnest([lag(code, 1) OVER w, lag(code, 2) OVER w, lag(code, 3) OVER w, lag(code, 4) OVER w, lag(code, 5) OVER w]) AS b FROM ev WINDOW w AS (PARTITION BY gun ORDER BY t)) WHERE b IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, max(match) OVER (PARTITION BY gun) AS best FROM l) SELECT gun, round(arg_min(match, p), 6) AS match, CAST(min(p) AS INTEGER) AS period FROM c WHERE match >= best - 0.05 GROUP BY 1""")
def repeat_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.repeat_period(readings(spark, sf_dir), "code", 5))


@query("""SELECT identity, count(*) AS members, min(s_suppkey) AS first_member FROM (SELECT DISTINCT s_suppkey, s_nationkey || '|' || CAST(round(s_acctbal / 2000.0) AS INTEGER) AS identity FROM supplier) GROUP BY 1 HAVING count(*) >= 2""")
def physical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("b", F.round(F.col("s_acctbal") / 2000.0).cast("int"))
    return S.physical_identity(s, [("s_nationkey", 0), ("b", 0)], "s_suppkey")


_RANKS = "SELECT *, rank() OVER (PARTITION BY code ORDER BY value) + (count(*) OVER (PARTITION BY code, value) - 1) / 2.0 AS rk FROM (SELECT code, value, CASE WHEN k >= 50 THEN 1 ELSE 0 END AS y FROM ev)"


@query(f"""WITH r AS ({_RANKS}), u AS (SELECT code, sum(y) AS n, sum(1 - y) AS m, sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0 AS u FROM r GROUP BY 1)
SELECT code, round(u, 4) AS u, round((u - n * m / 2.0) / sqrt(n * m * (n + m + 1) / 12.0), 4) AS z FROM u""")
def rank_sum_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir).withColumn("y", (F.col("k") >= 50).cast("int"))
    return rounded(S.rank_sum(ev, "value", "y", ["code"]), 4)


@query("""WITH r AS (SELECT gun, rank() OVER (PARTITION BY gun ORDER BY value) + (count(*) OVER (PARTITION BY gun, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY gun ORDER BY k) + (count(*) OVER (PARTITION BY gun, k) - 1) / 2.0 AS b FROM ev)
SELECT gun, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.rank_correlation(readings(spark, sf_dir), "value", "k"))


_WEIGHT = " + ".join(f"CAST(u >= {p!r} AS INTEGER)" for p in S.POISSON)


@query(f"""WITH o AS (SELECT gun, avg(CASE WHEN code = 'error' THEN 1.0 ELSE 0.0 END) AS share FROM ev GROUP BY 1), u AS (SELECT i, share, {drawn("0", "gun", "i")} AS u FROM o, (SELECT unnest(range(1, 201)) AS i)),
m AS (SELECT i, sum(share * ({_WEIGHT})) / sum({_WEIGHT}) AS mean FROM u GROUP BY 1) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted resamples of guns."""
    own = readings(spark, sf_dir).groupBy("gun").agg(F.avg((F.col("code") == "error").cast("double")).alias("share"))
    return rounded(S.interval(S.resampled(own, "share", 200)))


@query(f"""WITH g AS (SELECT gun, arg_max(code, t) AS class FROM ev GROUP BY 1), f AS (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY {drawn("0", "gun")}, gun) - 1) % 4 AS fold FROM g)
SELECT gun, class, first_value(fold) OVER (PARTITION BY gun // 2 ORDER BY gun) AS fold FROM f""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    guns = readings(spark, sf_dir).groupBy("gun").agg(F.max_by("code", "t").alias("class"))
    folds = S.stratified_folds(guns, "gun", "class", 4).withColumn("physical", F.expr("gun div 2"))
    return S.joined_folds(folds, "gun", "physical").select("gun", "class", "fold")


@query("""WITH f AS (SELECT code, value AS a, lag(value) OVER (PARTITION BY gun ORDER BY t) AS f FROM ev)
SELECT code, round(avg(abs(a - f)), 6) AS mae, round(avg(CASE WHEN a <> 0 THEN abs(a - f) / abs(a) END), 6) AS mape, round(avg(abs(a - f)) / (max(a) - min(a)), 6) AS marre, round(avg((a - f) * (a - f)), 4) AS mse FROM f WHERE f IS NOT NULL GROUP BY 1""")
def forecast_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).withColumn("f", F.lag("value").over(ordered("gun", "t"))).where("f is not null")
    out = S.forecast_errors(rows, "value", "f", ["code"])
    return rounded(out.withColumn("mse", F.round("mse", 4)))


_CLAIMS = "c AS (SELECT code, count(*) FILTER (WHERE k >= 50 AND value >= 50) AS tp, count(*) FILTER (WHERE k >= 50 AND value < 50) AS fp, count(*) FILTER (WHERE k < 50 AND value >= 50) AS fn FROM ev GROUP BY 1)"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("k") >= 50, F.col("value") >= 50
    return readings(spark, sf_dir).groupBy("code").agg(F.count_if(k & v).alias("tp"), F.count_if(k & ~v).alias("fp"), F.count_if(~k & v).alias("fn"))


@query(f"WITH {_CLAIMS} SELECT round(sum(tp) / sum(tp + fp), 6) AS precision, round(sum(tp) / sum(tp + fn), 6) AS recall FROM c")
def micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.micro_average(_claims(spark, sf_dir)))


@query(f"WITH {_CLAIMS}, p AS (SELECT code, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM c) SELECT code, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-8), 6) AS f1 FROM p")
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.claim_scores(_claims(spark, sf_dir), ["code"]))


@query(f"""WITH m AS (SELECT arr.q AS q, e.code, sum(CASE WHEN value >= q THEN 1.0 ELSE 0.0 END) / count(*) AS hit, sum(CASE WHEN value >= q AND k < 50 THEN 1.0 ELSE 0.0 END) AS cost FROM ev e, (SELECT unnest([20.0, 40.0, 60.0, 80.0]) AS q) arr GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY hit DESC, q DESC) AS rn FROM m WHERE cost <= 600) SELECT code, CAST(q AS DOUBLE) AS q, round(hit, 6) AS hit, CAST(cost AS DOUBLE) AS cost FROM b WHERE rn = 1""")
def budgeted_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = readings(spark, sf_dir).withColumn("q", F.explode(F.array(*map(F.lit, (20.0, 40.0, 60.0, 80.0)))))
    m = grid.groupBy("q", "code").agg(F.avg((F.col("value") >= F.col("q")).cast("double")).alias("hit"), F.sum(((F.col("value") >= F.col("q")) & (F.col("k") < 50)).cast("double")).alias("cost"))
    return rounded(S.best_within(m, "hit", "cost", 600, ["q"], ["code"]))


_VERSION = "SELECT avg(CASE WHEN k % 2 = {p} THEN value END) / 100 AS auroc, count(*) FILTER (WHERE code = 'error' AND k % 2 = {p}) AS hits, count(*) FILTER (WHERE code = 'view' AND k % 2 = {p}) / 1000.0 AS fa FROM ev"


@query(f"""WITH a AS ({_VERSION.format(p=0)}), b AS ({_VERSION.format(p=1)}),
g AS (SELECT count(*) AS common, count(*) FILTER (WHERE y >= x) AS better FROM (SELECT gun, avg(CASE WHEN k % 2 = 0 THEN value END) AS x, avg(CASE WHEN k % 2 = 1 THEN value END) AS y FROM ev GROUP BY 1)),
c AS (SELECT b.auroc - a.auroc > 0 AS check1, better * 2 > common AS check2, b.hits >= a.hits AS check3, b.fa <= 1.2 * a.fa AS check4, b.fa <= 24 AS check5 FROM a, b, g)
SELECT *, check1 AND check3 AND check5 AS promote FROM c""")
def judge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)

    def version(p: int) -> DataFrame:
        own = F.col("k") % 2 == p
        return ev.agg((F.avg(F.when(own, F.col("value"))) / 100).alias("auroc"), F.count_if((F.col("code") == "error") & own).alias("hits"), (F.count_if((F.col("code") == "view") & own) / 1000.0).alias("fa"))

    own = ev.groupBy("gun").agg(F.avg(F.when(F.col("k") % 2 == 0, F.col("value"))).alias("x"), F.avg(F.when(F.col("k") % 2 == 1, F.col("value"))).alias("y"))
    files = own.agg(F.count("*").alias("common"), F.count_if(F.col("y") >= F.col("x")).alias("better"))
    return S.judged(version(0), version(1).crossJoin(files).withColumn("ew", F.lit(True)), noise=0.0)  # one row each


_VERDICT = f"""w AS (SELECT DISTINCT gun, t // {SIX} * {SIX} AS w_start FROM ev),
s AS (SELECT gun, t // {SIX} * {SIX} AS a, (t + {DAY}) // {SIX} * {SIX} AS b, CASE WHEN code = 'error' THEN 'confirmed' ELSE 'false_alarm' END AS outcome FROM ev WHERE code IN ('error', 'signup')),
v AS (SELECT w.gun, w_start, coalesce(bool_or(outcome = 'confirmed'), false) AS confirmed, coalesce(bool_or(outcome = 'false_alarm'), false) AS false_alarm FROM w LEFT JOIN s ON s.gun = w.gun AND w_start >= a AND w_start < b GROUP BY 1, 2)"""


def _verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    windows = ev.select("gun", (F.floor(F.col("t") / SIX) * SIX).alias("w_start")).distinct()
    spans = ev.where(F.col("code").isin("error", "signup")).selectExpr("gun", "t as start_t", f"t + {DAY} as end_t", "if(code = 'error', 'confirmed', 'false_alarm') as outcome")
    return S.verdicts(windows, spans, SIX)


@query(f"WITH {_VERDICT} SELECT * FROM v")
def span_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict(spark, sf_dir)


@query(f"WITH {_VERDICT} SELECT count(*) FILTER (WHERE confirmed AND NOT false_alarm) AS confirmed, count(*) FILTER (WHERE false_alarm AND NOT confirmed) AS false_alarm, count(*) FILTER (WHERE confirmed AND false_alarm) AS conflicts, count(*) FILTER (WHERE NOT confirmed AND NOT false_alarm) AS unmatched FROM v")
def feedback_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = F.col("confirmed"), F.col("false_alarm")
    return _verdict(spark, sf_dir).agg(F.count_if(c & ~f).alias("confirmed"), F.count_if(f & ~c).alias("false_alarm"), F.count_if(c & f).alias("conflicts"), F.count_if(~c & ~f).alias("unmatched"))


@query(f"""WITH e AS (SELECT gun, max(t) AS e FROM ev GROUP BY 1), b AS (SELECT ev.gun, (e - t) // {2 * DAY} AS bin, value FROM ev JOIN e USING (gun)),
l AS (SELECT gun, quantile_cont(value, 0.5) AS m, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS s FROM b WHERE bin >= 5 GROUP BY 1)
SELECT bin, count(*) AS n, round(quantile_cont((value - m) / s, 0.5), 6) AS median_z FROM b JOIN l USING (gun) WHERE s > 0 GROUP BY 1""")
def epoch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust z by time before each gun's end, against its own earlier rows."""
    rows = P.with_ttf(readings(spark, sf_dir), DAY).withColumn("bin", F.floor(F.col("ttf") / (2 * DAY)))
    q = F.col("quantiles")
    base = S.quantiles(rows.where("bin >= 5"), "value", [0.25, 0.5, 0.75], ["gun"]).select("gun", q[1].alias("m"), ((q[2] - q[0]) / 1.349).alias("s")).where("s > 0")
    z = rows.join(base, "gun").withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    return rounded(S.quantiles(z, "z", [0.5], ["bin"]).select("bin", "n", q[0].alias("median_z")))


@query(f"""SELECT code, CAST(b AS BIGINT) AS bin, round(avg(CASE WHEN k >= 50 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM (SELECT code, k, ((max(t) OVER (PARTITION BY gun)) - t) // {5 * DAY} AS b FROM ev) GROUP BY 1, 2""")
def code_share_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_ttf(readings(spark, sf_dir), DAY).withColumn("bin", F.floor(F.col("ttf") / (5 * DAY)))
    return rounded(rows.groupBy("code", "bin").agg(F.avg((F.col("k") >= 50).cast("double")).alias("share"), F.count("*").alias("n")))


@query("""SELECT CAST(hour(ts) * 6 + minute(ts) // 10 AS BIGINT) AS slot, CAST(isodow(ts) AS INTEGER) AS weekday, round(avg(value), 6) AS activity, count(*) AS n FROM events GROUP BY 1, 2""")
def rhythm_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean activity by ten minutes and weekday."""
    ev = readings(spark, sf_dir)
    slot = F.floor(F.expr(f"t % {DAY}") / (10 * 60_000_000))
    return rounded(ev.groupBy(slot.alias("slot"), (P.clock(F.col("t"))["dow"] + 1).alias("weekday")).agg(F.avg("value").alias("activity"), F.count("*").alias("n")))
