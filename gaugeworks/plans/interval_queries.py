"""Queries on gaps, runs, sessions, as-of lookups and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import intervals as I
from gaugeworks.plans.registry import DAY, HOUR, query, readings, rounded, table


@query(f"""WITH g AS (SELECT *, t - lag(t) OVER (PARTITION BY gun ORDER BY t) AS step FROM ev),
s AS (SELECT *, sum(CASE WHEN step > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS segment_id FROM g)
SELECT gun, CAST(segment_id AS BIGINT) AS segment_id, min(t) AS start_t, max(t) AS end_t, count(*) AS n_rows FROM s GROUP BY 1, 2""")
def segments_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.with_segments(readings(spark, sf_dir), DAY)
    return rows.groupBy("gun", "segment_id").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n_rows"))


_GAPS = """SELECT * FROM (SELECT gun, lag(t) OVER w AS gap_start, t AS gap_end, lag(code) OVER w AS code_before, lag(value) OVER w AS value_before,
 code AS code_after, value AS value_after, t - lag(t) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY gun ORDER BY t)) WHERE gap > {limit}"""


@query(_GAPS.format(limit=DAY))
def gap_list_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.gap_list(readings(spark, sf_dir), DAY, ["code", "value"])


@query(f"""WITH c AS (SELECT *, sum(k) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS counter FROM ev),
g AS (SELECT gun, lag(t) OVER w AS gap_start, t - lag(t) OVER w AS gap, counter - lag(counter) OVER w AS delta FROM c WINDOW w AS (PARTITION BY gun ORDER BY t)),
b AS (SELECT gun, quantile_cont(s, 0.5) AS baseline FROM (SELECT gun, t // {HOUR} AS h, sum(k) AS s FROM ev GROUP BY 1, 2 HAVING sum(k) > 0) GROUP BY 1)
SELECT g.gun, gap_start, gap, CAST(delta AS BIGINT) AS delta, round(delta / (gap / {HOUR}.0) / baseline, 6) AS ratio,
CASE WHEN delta <= 0 THEN 'frozen' WHEN delta / (gap / {HOUR}.0) / baseline >= 0.05 THEN 'logging_dropout' ELSE 'partial' END AS kind
FROM g JOIN b USING (gun) WHERE gap > {DAY}""")
def gap_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    counted = ev.withColumn("counter", F.sum("k").over(I.up_to_here(I.ordered("gun", "t"))))
    gaps = I.gap_list(counted, DAY, ["counter"]).withColumn("delta", F.col("counter_after") - F.col("counter_before"))
    hourly = ev.groupBy("gun", F.floor(F.col("t") / HOUR).alias("h")).agg(F.sum("k").alias("s")).where("s > 0")
    base = hourly.groupBy("gun").agg(F.percentile("s", F.lit(0.5)).alias("baseline"))
    rated = gaps.join(base, "gun").withColumn("rate", F.col("delta") / (F.col("gap") / float(HOUR)))
    out = I.gap_kind(rated, least=0.05).withColumn("ratio", F.col("rate") / F.col("baseline"))
    return rounded(out.select("gun", "gap_start", "gap", "delta", "ratio", "kind"))


_RUNS = """SELECT gun, CAST(run_id AS BIGINT) AS run_id, min(code) AS code, min(t) AS start_t, max(t) AS end_t, count(*) AS n_rows, max(t) - min(t) AS duration FROM
 (SELECT *, sum(n) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS run_id FROM
 (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR code <> lag(code) OVER w {more} THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY gun ORDER BY t))) GROUP BY 1, 2"""


@query(_RUNS.format(more=""))
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.runs(readings(spark, sf_dir), "code")


@query(_RUNS.format(more=f"OR t - lag(t) OVER w > {12 * HOUR}"))
def code_runs_gap_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.runs(readings(spark, sf_dir), "code", limit=12 * HOUR)


@query(_RUNS.format(more=f"OR t - lag(t) OVER w > {12 * HOUR}"))
def code_runs_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a gun's rows in spans of three days."""
    return I.runs(readings(spark, sf_dir), "code", limit=12 * HOUR, chunk=3 * DAY)


@query(f"WITH p AS (SELECT *, t - lag(t) OVER (PARTITION BY gun ORDER BY t, event_id) > {12 * HOUR} AS far FROM ev) SELECT event_id, count_if(coalesce(far, false)) OVER (PARTITION BY gun ORDER BY t, event_id) AS segment_id FROM p")
def segments_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, a gun's rows in spans of three days."""
    return I.with_segments(readings(spark, sf_dir), 12 * HOUR, tie=["event_id"], chunk=3 * DAY).select("event_id", "segment_id")


@query(f"""WITH d AS (SELECT gun, t // {6 * HOUR} AS slot, avg(CASE WHEN code = 'error' THEN 0.0 ELSE 1.0 END) AS share FROM ev GROUP BY 1, 2),
i AS (SELECT *, slot - row_number() OVER (PARTITION BY gun ORDER BY slot) AS island FROM d WHERE share >= 0.9)
SELECT gun, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n_slots FROM i GROUP BY gun, island HAVING count(*) >= 3""")
def idle_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = readings(spark, sf_dir).groupBy("gun", F.floor(F.col("t") / (6 * HOUR)).alias("slot")).agg(F.avg((F.col("code") != "error").cast("double")).alias("share"))
    return I.long_blocks(slots, "share", 0.9, 3)


@query(f"""SELECT gun, t, event_id FROM (SELECT *, t - lag(t) OVER (PARTITION BY gun ORDER BY t) AS step FROM ev WHERE code = 'error')
WHERE step IS NULL OR step > {DAY}""")
def merge_near_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_near(readings(spark, sf_dir).where("code = 'error'"), DAY).select("gun", "t", "event_id")


_SESSIONS = f"""s AS (SELECT *, sum(CASE WHEN step > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS session_id
FROM (SELECT *, t - lag(t) OVER (PARTITION BY gun ORDER BY t) AS step FROM ev))"""


@query(f"WITH {_SESSIONS} SELECT gun, CAST(session_id AS BIGINT) AS session_id, count(*) AS session_size, min(t) AS start_t, max(t) AS end_t FROM s GROUP BY 1, 2")
def session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.with_sessions(readings(spark, sf_dir), 12 * HOUR)
    return rows.groupBy("gun", "session_id").agg(F.max("session_size").alias("session_size"), F.min("t").alias("start_t"), F.max("t").alias("end_t"))


@query(f"WITH {_SESSIONS} SELECT event_id, count(*) OVER (PARTITION BY gun, session_id) > 1 AS simultaneous FROM s")
def simultaneous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_sessions(readings(spark, sf_dir), 12 * HOUR).select("event_id", "simultaneous")


@query("""SELECT a.event_id, a.gun, a.t, b.t AS last_t, b.value AS last_value FROM (SELECT * FROM ev WHERE code = 'error') a
ASOF LEFT JOIN (SELECT * FROM ev WHERE code = 'purchase') b ON a.gun = b.gun AND a.t > b.t""")
def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    other = ev.where("code = 'purchase'").select("gun", "t", F.col("value").alias("last_value"))
    return I.asof_before(ev.where("code = 'error'").select("event_id", "gun", "t"), other, ["last_value"])


@query("""SELECT a.event_id, a.gun, a.t, b.t AS last_t, b.value AS last_value FROM (SELECT * FROM ev WHERE code = 'error') a
ASOF LEFT JOIN (SELECT * FROM ev WHERE code = 'purchase') b ON a.gun = b.gun AND a.t > b.t""")
def asof_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a gun's rows in spans of three days."""
    ev = readings(spark, sf_dir)
    other = ev.where("code = 'purchase'").select("gun", "t", F.col("value").alias("last_value"))
    return I.asof_before(ev.where("code = 'error'").select("event_id", "gun", "t"), other, ["last_value"], chunk=3 * DAY)


@query("""SELECT event_id, t - max(CASE WHEN code = 'error' THEN t END) OVER (PARTITION BY gun ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since,
min(CASE WHEN code = 'error' THEN t END) OVER (PARTITION BY gun ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - t AS until FROM ev""")
def time_to_next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.since_and_until(readings(spark, sf_dir), F.col("code") == "error").select("event_id", "since", "until")


@query(f"""WITH s AS (SELECT event_id, t - max(CASE WHEN code = 'error' THEN t END) OVER (PARTITION BY gun ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
min(CASE WHEN code = 'error' THEN t END) OVER (PARTITION BY gun ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - t AS b FROM ev)
SELECT event_id, CASE WHEN least(a, b) <= {6 * HOUR} THEN least(a, b) END AS near FROM s""")
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nearest(readings(spark, sf_dir), F.col("code") == "error", 6 * HOUR).select("event_id", "near")


_SPANS = f"sp AS (SELECT DISTINCT gun, t AS start_t, t + {2 * DAY} AS end_t FROM ev WHERE code = 'error')"


def _error_spans(ev: DataFrame, length: int) -> DataFrame:
    return ev.where("code = 'error'").selectExpr("gun", "t as start_t", f"t + {length} as end_t").distinct()


@query(f"WITH {_SPANS} SELECT sp.gun, start_t, end_t, count(ev.t) AS n_points FROM sp LEFT JOIN ev ON ev.gun = sp.gun AND ev.t >= start_t AND ev.t < end_t GROUP BY 1, 2, 3")
def events_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    return I.count_in(ev, _error_spans(ev, 2 * DAY), DAY)


@query(f"""WITH {_SPANS} SELECT sp.gun, start_t, end_t, round(count(ev.t) / ((end_t - start_t) / {HOUR}.0), 6) AS coverage
FROM sp LEFT JOIN ev ON ev.gun = sp.gun AND ev.t >= start_t AND ev.t < end_t GROUP BY 1, 2, 3""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    n = I.count_in(ev, _error_spans(ev, 2 * DAY), DAY)
    return rounded(n.select("gun", "start_t", "end_t", (F.col("n_points") / ((F.col("end_t") - F.col("start_t")) / float(HOUR))).alias("coverage")))


@query(f"""WITH p AS (SELECT DISTINCT gun, t AS start_t, t + {HOUR} AS end_t FROM ev WHERE code = 'purchase'), e AS (SELECT gun, t AS s, t + {HOUR} AS e FROM ev WHERE code = 'error')
SELECT gun, start_t, end_t FROM p WHERE EXISTS (SELECT 1 FROM e WHERE e.gun = p.gun AND e.s < p.end_t AND e.e >= p.start_t)""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    spans = lambda code: ev.where(F.col("code") == code).selectExpr("gun", "t as start_t", f"t + {HOUR} as end_t")
    return I.overlapping(spans("purchase"), spans("error"), 6 * HOUR)


@query("""WITH r AS (SELECT gun, start_t, end_t FROM (SELECT gun, rid, min(code) AS code, min(t) AS start_t, max(t) AS end_t FROM
 (SELECT *, sum(n) OVER (PARTITION BY gun ORDER BY t ROWS UNBOUNDED PRECEDING) AS rid FROM
 (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR code <> lag(code) OVER w THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY gun ORDER BY t))) GROUP BY 1, 2) WHERE code = 'error'),
f AS (SELECT gun, min(t) AS t0 FROM ev GROUP BY 1)
SELECT ev.event_id, CAST(ev.t - min(t0) - coalesce(sum(greatest(least(ev.t, end_t) - start_t, 0)), 0) AS BIGINT) AS operating
FROM ev JOIN f USING (gun) LEFT JOIN r ON r.gun = ev.gun AND r.start_t < ev.t GROUP BY ev.event_id, ev.t""")
def operating_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    off = I.runs(ev, "code").where("code = 'error'").select("gun", "start_t", "end_t")
    return I.operating_clock(ev, off).select("event_id", "operating")


@query(f"""WITH m AS (SELECT gun, CAST((t % {DAY}) // 60000000 AS BIGINT) AS minute FROM ev WHERE code = 'error'),
g AS (SELECT gun, atan2(avg(sin(minute * 2 * pi() / 1440)), avg(cos(minute * 2 * pi() / 1440))) * 1440 / (2 * pi()) AS a FROM m GROUP BY 1),
c AS (SELECT gun, CASE WHEN a < 0 THEN a + 1440 ELSE a END AS mean_minute FROM g)
SELECT gun, round(mean_minute, 4) AS mean_minute, round(avg(least(abs(minute - mean_minute), 1440 - abs(minute - mean_minute))), 4) AS mean_distance FROM m JOIN c USING (gun) GROUP BY gun, mean_minute""")
def circular_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = readings(spark, sf_dir).where("code = 'error'").select("gun", F.floor(F.expr(f"t % {DAY}") / 60_000_000).alias("minute"))
    mean = m.groupBy("gun").agg(I.circular_mean(F.col("minute"), 1440).alias("mean_minute"))
    far = I.circular_distance(F.col("minute").cast("double"), F.col("mean_minute"), 1440)
    return rounded(m.join(mean, "gun").groupBy("gun", "mean_minute").agg(F.avg(far).alias("mean_distance")), 4)


@query("""WITH d AS (SELECT user_id AS gun, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT gun, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1)
SELECT c.gun, c.day, coalesce(d.n, 0) AS n FROM c LEFT JOIN d ON c.gun = d.gun AND c.day = d.day""")
def calendar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return I.daily_coverage(ev.groupBy(F.col("user_id").alias("gun"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n")))


@query("SELECT gun, t, code FROM ev")
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes encoded as change points and held again at every reading."""
    ev = readings(spark, sf_dir)
    return I.expand_changes(ev, I.change_points(ev, "code"), "code")


@query("""SELECT gun, t, code FROM (SELECT *, lag(code) OVER (PARTITION BY gun ORDER BY t) AS before FROM ev) WHERE before IS NULL OR before <> code""")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.change_points(readings(spark, sf_dir), "code").select("gun", "t", "code")


@query(f"""WITH f AS (SELECT gun, max(t) AS anchor FROM ev WHERE code = 'error' GROUP BY 1), z AS (SELECT gun, day, anchor - day * {DAY} AS a FROM f, range(0, 7) r(day))
SELECT z.gun, z.day, count(ev.t) AS n_rows, count(ev.t) FILTER (WHERE ev.code = 'click') AS n_clicks FROM z
LEFT JOIN ev ON ev.gun = z.gun AND ev.t >= a - {6 * HOUR} AND ev.t < a GROUP BY 1, 2""")
def case_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gun's last error against the same hours of the six days before."""
    ev = readings(spark, sf_dir)
    anchor = ev.where("code = 'error'").groupBy("gun").agg(F.max("t").alias("anchor"))
    zones = anchor.select("gun", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("day"), "anchor")
    zones = zones.selectExpr("gun", "day", f"anchor - day * {DAY} - {6 * HOUR} as start_t", f"anchor - day * {DAY} as end_t")
    found = I.interval_join(ev, zones, 6 * HOUR, how="left")
    return found.groupBy("gun", "day").agg(F.count("t").alias("n_rows"), F.count_if(F.col("code") == "click").alias("n_clicks"))
