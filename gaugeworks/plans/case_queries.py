"""Queries on the case store, components and scores. Orders stand for cases: customer = gun, priority = group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import cases as C
from gaugeworks.operators import components, scoring
from gaugeworks.operators import loop as L
from gaugeworks.plans.registry import DAY, HOUR, query, readings, rounded, table

_GROUPED = """h AS (SELECT gun, t, code AS grp, event_id, k < 10 AS ignored FROM ev WHERE code IN ('error', 'signup')),
c AS (SELECT gun, t FROM ev WHERE code = 'purchase'),
n AS (SELECT h.*, (SELECT count(*) FROM c WHERE c.gun = h.gun AND c.t < h.t) AS case_no FROM h),
g AS (SELECT *, min(CASE WHEN NOT ignored THEN t END) OVER (PARTITION BY gun, grp, case_no) AS case_start FROM n)"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    handoffs = ev.where(F.col("code").isin("error", "signup")).select("gun", "t", F.col("code").alias("grp"), "event_id", "k")
    return C.grouped(handoffs, ev.where("code = 'purchase'"), F.col("k") < 10)


@query(f"WITH {_GROUPED} SELECT event_id, CAST(case_no AS BIGINT) AS case_no, case_start, CASE WHEN ignored THEN 'ignored' WHEN t = case_start THEN 'new' ELSE 'repeat' END AS outcome FROM g")
def case_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("event_id", "case_no", "case_start", "outcome")


@query(f"WITH {_GROUPED} SELECT gun, grp, CAST(case_no AS BIGINT) AS case_no, CASE WHEN bool_or(grp = 'error' AND ev.k > 80) THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n_events FROM g JOIN ev USING (event_id) GROUP BY g.gun, grp, case_no".replace("SELECT gun, grp", "SELECT g.gun AS gun, grp"))
def case_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.severity_of(_grouped(spark, sf_dir), ["gun", "grp", "case_no"], (F.col("grp") == "error") & (F.col("k") > 80))


@query("SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_open_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return C.latest(o, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place, arg_max(l_shipdate, (l_shipdate, l_linenumber)) AS last_action,
arg_max(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) AS last_result, count(*) AS actions FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey, o_custkey, o_orderdate""")
def case_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed cases, newest first for each gun, with their last action and its result."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("_l"), F.count("*").alias("actions"))
    rows = o.join(last, o["o_orderkey"] == last["l_orderkey"])
    place = F.row_number().over(C.Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return rows.select("o_orderkey", place.alias("place"), F.col("_l.l_shipdate").alias("last_action"), F.col("_l.l_returnflag").alias("last_result"), "actions")


@query("""WITH o AS (SELECT o_custkey AS gun, o_orderkey AS case_id, o_orderdate AS t, o_orderstatus = 'F' AS closed FROM orders)
SELECT a.gun, a.case_id, count(b.case_id) AS n_past, coalesce(list_slice(list(b.case_id ORDER BY b.t DESC, b.case_id DESC) FILTER (WHERE b.case_id IS NOT NULL), 1, 3), []) AS recent
FROM o a LEFT JOIN o b ON a.gun = b.gun AND b.closed AND (b.t, b.case_id) < (a.t, a.case_id) GROUP BY 1, 2""")
def alarm_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gun"), F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("t"), "o_orderstatus")
    return C.memory(o, F.col("o_orderstatus") == "F", "gun", "t")


@query(f"SELECT e.event_id, count(*) AS n, round(avg(p.value), 6) AS mean_value FROM (SELECT * FROM ev WHERE code = 'error') e JOIN ev p ON p.gun = e.gun AND p.t > e.t - {DAY} AND p.t <= e.t GROUP BY 1")
def score_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    found = C.trace_before(ev.select("gun", "t", "value"), ev.where("code = 'error'").select("gun", "event_id", "t"), DAY, 12 * HOUR)
    return rounded(found.groupBy("event_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query("SELECT gun AS case_id, coalesce(arg_max(event_id, (t, event_id)) FILTER (WHERE code IN ('error', 'signup')), arg_min(event_id, (t, event_id))) AS event_id FROM ev GROUP BY 1")
def preferred_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir).withColumn("e_code", F.when(F.col("code").isin("error", "signup"), F.col("code"))).withColumnRenamed("gun", "case_id")
    return C.preferred_event(ev, "case_id", "e_code", "t")


@query("SELECT conv_id, role, text FROM conversations WHERE turn >= 0 QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1")
def chat_feedback_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each (conversation, role) wins."""
    return C.latest(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text").select("conv_id", "role", "text")


@query("""WITH o AS (SELECT event_id, gun % 9 AS pattern_key, t AS next_attempt_at, k % 7 AS attempts, CASE WHEN code = 'view' THEN 'sent' ELSE 'pending' END AS status, CASE k % 6 WHEN 0 THEN 200 WHEN 1 THEN 500 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 408 ELSE 503 END AS http FROM ev)
SELECT event_id, outcome, CASE WHEN outcome = 'retry' THEN CASE greatest(attempts, 1) WHEN 1 THEN 10 WHEN 2 THEN 30 WHEN 3 THEN 120 ELSE 600 END END AS wait FROM
(SELECT *, CASE WHEN http BETWEEN 200 AND 299 THEN 'done' WHEN (http BETWEEN 400 AND 499 AND http NOT IN (408, 429)) OR attempts >= 5 THEN 'failed' ELSE 'retry' END AS outcome FROM o)""")
def outbox_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.delivery(_outbox(spark, sf_dir)).select("event_id", "outcome", "wait")


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    http = F.element_at(F.array(*map(F.lit, (200, 500, 404, 429, 408, 503))), F.expr("k % 6 + 1"))
    ev = readings(spark, sf_dir)
    return ev.select("event_id", F.expr("gun % 9").alias("pattern_key"), F.col("t").alias("next_attempt_at"), F.expr("k % 7").alias("attempts"), F.when(F.col("code") == "view", "sent").otherwise("pending").alias("status"), http.alias("http"))


@query("""SELECT event_id, CAST(rank() OVER (PARTITION BY pattern_key ORDER BY next_attempt_at, event_id) AS INTEGER) AS rank FROM (SELECT event_id, gun % 9 AS pattern_key, t AS next_attempt_at, k % 7 AS attempts, code FROM ev)
WHERE code <> 'view' AND attempts < 5 AND next_attempt_at <= 1705000000000000""")
def outbox_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.due(_outbox(spark, sf_dir), 1_705_000_000_000_000, 5).select("event_id", "rank")


@query("""SELECT gun, list_filter([CASE WHEN NOT n_error > 0 THEN 'has_error' END, CASE WHEN NOT last_value > 10 THEN 'high_enough' END, CASE WHEN NOT n > 30 THEN 'long_enough' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT gun, count(*) FILTER (WHERE code = 'error') AS n_error, arg_max(value, t) AS last_value, count(*) AS n FROM ev GROUP BY 1)""")
def resolution_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = readings(spark, sf_dir).groupBy("gun").agg(F.count_if(F.col("code") == "error").alias("n_error"), F.max_by("value", "t").alias("last_value"), F.count("*").alias("n"))
    return C.violations(g, {"has_error": F.col("n_error") > 0, "high_enough": F.col("last_value") > 10, "long_enough": F.col("n") > 30}).select("gun", "reasons")


@query("""SELECT doc_id, CAST(CASE WHEN a THEN 0 ELSE 1 END AS INTEGER) AS part, CASE WHEN a THEN n_chars ELSE -n_chars END AS position FROM (SELECT doc_id, n_chars, doc_id % 3 = 0 AS a FROM documents) WHERE a OR doc_id % 2 = 0""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of the table stand for the two tables that are put in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    first = d.where("doc_id % 3 = 0").select("doc_id", F.col("n_chars").alias("position"))
    return C.ordered_union(first, d.where("doc_id % 2 = 0").select("doc_id", (-F.col("n_chars")).alias("position")), key="doc_id", position="position")


_LINKS = "l AS (SELECT gun AS a, lead(gun) OVER (PARTITION BY value ORDER BY gun) AS b FROM (SELECT DISTINCT gun, value FROM ev WHERE code = 'error')), e AS (SELECT a, b FROM l WHERE b IS NOT NULL UNION SELECT b, a FROM l WHERE b IS NOT NULL)"


@query(f"WITH RECURSIVE {_LINKS}, r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guns that had an error of the same value are linked."""
    rows = readings(spark, sf_dir).where("code = 'error'").select("gun", "value").distinct()
    links = rows.select(F.col("gun").alias("a"), F.lead("gun").over(C.Window.partitionBy("value").orderBy("gun")).alias("b")).where("b is not null")
    return components.connected(links)


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def isolation_forest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_COLUMNS)
    forest = scoring.fit_forest(rows, _COLUMNS)
    return rounded(scoring.with_score(rows, forest, _COLUMNS).select("l_orderkey", "l_linenumber", "score"))


@query()
def ablation_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_COLUMNS)
    forest = scoring.fit_forest(rows, _COLUMNS)
    out = scoring.ablation(rows, forest, _COLUMNS, scoring.medians(rows, _COLUMNS), most=3)
    return out.select("l_orderkey", "l_linenumber", F.col("contributions.feature").alias("features"), F.round(F.col("contributions")[0]["share"], 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber, round((cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)) / 2, 6) AS score FROM lineitem")
def cdf_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")
    rows = scoring.exact_share(rows, "l_extendedprice", ["l_returnflag"]).withColumnRenamed("cdf", "a")
    rows = scoring.exact_share(rows, "l_quantity", ["l_returnflag"]).withColumnRenamed("cdf", "b")
    return rounded(rows.select("l_orderkey", "l_linenumber", scoring.combined([F.col("a"), F.col("b")]).alias("score")))


@query()
def loop_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model loop does at each tick of five days, guns' last readings standing for ended files."""
    files = readings(spark, sf_dir).groupBy("gun", F.floor(F.col("t") / DAY).alias("day")).agg(F.avg("value").alias("a"), F.avg("k").alias("b"))
    regs = L.what_if(files, "day", {"a": "a", "b": "b"}, [L.Schedule(), L.Schedule(first=30, new=10, shadow=10)], 5)
    rows = [(v, tick, "; ".join(done)) for v, r in enumerate(regs) for tick, done in r.log]
    return spark.createDataFrame(rows, "variant int, tick int, actions string")
