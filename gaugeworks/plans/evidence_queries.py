"""Queries on sources, graph hops, evidence, validation and small predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import text as X
from gaugeworks.operators import evidence as E
from gaugeworks.operators import prep as P
from gaugeworks.operators import scoring
from gaugeworks.plans.registry import DAY, HOUR, query, readings, rounded, table
from gaugeworks.sources import readers

#: DuckDB's twin of ``functions.text.collapsed``.
_COLLAPSED = r"trim(regexp_replace(regexp_replace({}, '-[ \t]*\n[ \t]*', '', 'g'), '[\s\x0b]+', ' ', 'g'))"


# scans


@query("SELECT o_orderkey, o_totalprice FROM orders")
def parquet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    return readers.columns_of(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("SELECT 'region' AS file, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def tagged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: several files, each row with its file's name."""
    parts = [readers.tagged(table(spark, sf_dir, n).select("*", "_metadata")).select("file") for n in ("region", "nation")]
    return parts[0].unionByName(parts[1]).groupBy("file").agg(F.count("*").alias("n"))


_MANIFEST = "m AS (SELECT DISTINCT source AS file, CASE WHEN source < 's' THEN 'junk' WHEN source < 'site05' THEN '' END AS dropped, substr(source, 1, 3) AS class FROM documents)"


@query(f"WITH {_MANIFEST} SELECT source, class, count(*) AS n FROM documents JOIN m ON m.file = source WHERE dropped IS NULL OR trim(dropped) IN ('', 'false', '0') GROUP BY 1, 2")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the files that a manifest keeps."""
    d = table(spark, sf_dir, "documents").withColumn("file", F.col("source"))
    m = d.select("file").distinct().withColumn("dropped", F.when(F.col("file") < "s", "junk").when(F.col("file") < "site05", "")).withColumn("class", F.substring("file", 1, 3))
    return readers.of_kept(d, m).groupBy("source", "class").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT DISTINCT o_orderkey AS file, o_orderstatus <> 'P' AS readable, o_totalprice > 100000 AS fails FROM orders WHERE o_orderkey % 3 <> 0)
SELECT file, CASE WHEN NOT readable THEN 'unreadable' WHEN NOT fails THEN 'no failure' END AS reason FROM n""")
def append_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is added and what is skipped, told apart by the reason."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderstatus") != "P").alias("readable"), (F.col("o_totalprice") > 100000).alias("is_failure"))
    added, skipped = readers.appended(o.where("file % 3 = 0"), o)
    return added.select("file", F.lit(None).cast("string").alias("reason")).unionByName(skipped.select("file", "reason"))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS sha256, c_nationkey AS pages FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS sha256, CASE WHEN c_custkey % 11 = 0 THEN 99 ELSE c_nationkey END AS pages FROM customer WHERE c_custkey % 13 <> 0),
p AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'not listed' WHEN a.sha256 <> b.sha256 THEN 'changed' WHEN a.pages <> b.pages THEN 'page count' END AS problem FROM a FULL JOIN b ON a.id = b.id)
SELECT * FROM p WHERE problem IS NOT NULL""")
def manifest_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16, U5."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_mktsegment as sha256", "cast(c_nationkey as int) as pages")
    found = c.where("id % 13 <> 0").withColumn("sha256", F.expr("if(id % 5 = 0, 'x', sha256)")).withColumn("pages", F.expr("if(id % 11 = 0, 99, pages)"))
    return readers.integrity(c.where("id % 7 <> 0"), found)


# graph hops and evidence


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").selectExpr("concat('c', c_custkey) as source", "concat('n', c_nationkey) as target", "'lives' as type")
    n = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) as source", "concat('r', n_regionkey) as target", "'part_of' as type")
    return c.unionByName(n)


@query("SELECT DISTINCT 'n' || c_nationkey AS start, 'r' || n_regionkey AS \"end\" FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0")
def graph_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the nations in which customers live."""
    edges, nodes = _graph(spark, sf_dir), table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    nations = E.hop(nodes, edges, "lives").select(F.col("end").alias("id"))
    return E.hop(nations, edges, "part_of")


@query("SELECT 'c' || c_custkey AS start, CASE WHEN c_custkey % 3 <> 0 THEN 'n' || c_nationkey END AS \"end\" FROM customer")
def graph_optional_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return E.optional_hop(nodes, _graph(spark, sf_dir), "lives")


@query("SELECT lang AS code, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY source, n_chars % 10, doc_id) AS INTEGER) AS position FROM documents")
def complete_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks mapped to a code (here: a language)."""
    d = table(spark, sf_dir, "documents")
    edges = d.select(F.col("lang").alias("source"), F.col("doc_id").alias("target"), F.lit("RELEVANT_EVIDENCE").alias("type"))
    return E.complete_evidence(d.select(F.col("lang").alias("code")).distinct(), edges, d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), (F.col("n_chars") % 10).alias("page")))


@query("""WITH p AS (SELECT doc_id, unnest([n_chars % 3, doc_id % 3]) AS page, unnest([lang, source]) AS t FROM documents), g AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY t) AS text FROM p GROUP BY 1, 2),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM g) SELECT CASE WHEN n = 1 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || ':p' || page END AS id, page, text FROM n""")
def evidence_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13."""
    part = lambda page, text: F.struct(page.cast("long").alias("page"), F.col(text).alias("text"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(part(F.col("n_chars") % 3, "lang"), part(F.col("doc_id") % 3, "source")).alias("parts"))
    return E.by_page(d)


@query("""SELECT e.o_orderkey AS event_id, h.o_orderkey AS case_id, CAST(row_number() OVER (PARTITION BY e.o_orderkey ORDER BY h.o_orderdate DESC, h.o_orderkey DESC) AS INTEGER) AS place FROM orders e
JOIN orders h ON h.o_orderpriority = e.o_orderpriority AND h.o_orderstatus = e.o_orderstatus WHERE h.o_totalprice > 300000 AND h.o_custkey <> e.o_custkey AND h.o_orderdate <= e.o_orderdate QUALIFY place <= 5""")
def eligible_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest eligible cases of every order; dear orders of a class stand for its confirmed cases."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority as scope", "o_orderstatus as revision", "o_custkey as episode_id", "o_orderdate", "o_totalprice > 300000 as confirmed")
    events = o.selectExpr("o_orderkey as event_id", "scope", "revision", "episode_id", "o_orderdate as at")
    return E.latest_eligible(o.selectExpr("o_orderkey as case_id", "scope", "revision", "episode_id", "o_orderdate as closed_at", "confirmed"), events, 5)


@query("SELECT o_custkey AS event_id, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders WHERE round(o_totalprice / 500000, 6) >= 0.5 GROUP BY 1")
def case_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K22."""
    o = table(spark, sf_dir, "orders")
    scores = o.select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("past_id"), F.round(F.col("o_totalprice") / 500000, 6).alias("score"))
    return E.conflicts(scores, o.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("case_id")), 0.5)


@query("""WITH s AS (SELECT DISTINCT gun, code, CAST(t // 86400000000 % 20 AS INTEGER) AS o FROM ev), c AS (SELECT event_id, gun, code, k % 20 AS a, (k * 7) % 20 AS b FROM ev)
SELECT event_id AS claim_id, EXISTS (SELECT 1 FROM s WHERE s.gun = c.gun AND s.code = c.code AND o = a) AND EXISTS (SELECT 1 FROM s WHERE s.gun = c.gun AND s.code = c.code AND o = b) AS valid FROM c""")
def claim_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K25."""
    ev = readings(spark, sf_dir)
    series = ev.selectExpr("gun as event_id", "code as channel", "cast(t div 86400000000 % 20 as int) as offset")
    claims = ev.selectExpr("event_id as claim_id", "gun as event_id", "code as channel", "k % 20 as start", "(k * 7) % 20 as end")
    return E.endpoints_observed(claims, series).select("claim_id", "valid")


_QUOTES = "q AS (SELECT doc_id AS ref_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'not there' ELSE substr(text, 5, 30) END AS quote FROM documents)"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id as ref_id", "source as doc", "doc_id as page", "if(doc_id % 3 = 0, 'not there', substr(text, 5, 30)) as quote")


@query(f"WITH {_QUOTES} SELECT ref_id, contains({_COLLAPSED.format('d.text')}, {_COLLAPSED.format('quote')}) AND trim(quote) <> '' AS found FROM q JOIN documents d USING (doc_id)")
def quotes_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for pages."""
    pages = table(spark, sf_dir, "documents").selectExpr("source as doc", "doc_id as page", "text")
    return E.quotes_in_source(_quotes(spark, sf_dir), pages).select("ref_id", "found")


@query(f"""WITH {_QUOTES}, c AS (SELECT doc_id, doc_id || ':' || n AS chunk_id, substr(text, 1, n) AS text FROM documents, (SELECT unnest([20, 200, 5000]) AS n)),
m AS (SELECT ref_id, min(struct_pack(n := length(c.text), c := c.chunk_id)) FILTER (WHERE contains({_COLLAPSED.format('c.text')}, {_COLLAPSED.format('quote')})) AS b FROM q JOIN c USING (doc_id) GROUP BY 1) SELECT ref_id, b.c AS chunk_id FROM m""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest of three chunks of a page that holds a quote."""
    d = table(spark, sf_dir, "documents").withColumn("n", F.explode(F.array(F.lit(20), F.lit(200), F.lit(5000))))
    chunks = d.selectExpr("source as doc", "doc_id as page", "concat(doc_id, ':', n) as chunk_id", "substr(text, 1, n) as text")
    return E.resolved_references(_quotes(spark, sf_dir), chunks).select("ref_id", "chunk_id")


@query("WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS s FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN s = ['F'] THEN 'closed' WHEN s = ['F', 'O'] THEN 'both' END AS scope FROM g")
def scope_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K28."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return g.select("o_custkey", E.scope(F.col("s"), {"closed": ["F"], "both": ["O", "F"]}).alias("scope"))


_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""WITH g AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN 'no such line' ELSE split_part(text, chr(10), 1) END AS line FROM documents)
SELECT g.source AS doc, round(avg(CASE WHEN contains({_LETTERS.format('d.text')}, {_LETTERS.format('line')}) THEN 1.0 ELSE 0.0 END), 6) AS recall,
round(avg(CASE WHEN list_contains(list_transform(string_split(d.text, chr(10)), lambda x: {_LETTERS.format('x')}), {_LETTERS.format('line')}) THEN 1.0 ELSE 0.0 END), 6) AS exact FROM g JOIN documents d USING (doc_id) GROUP BY 1""")
def parse_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents stand for golden lines."""
    d = table(spark, sf_dir, "documents")
    golden = d.selectExpr("source as doc", "doc_id as page", "if(doc_id % 4 = 0, 'no such line', split(text, '\\n')[0]) as line")
    return rounded(E.parse_audit(d.selectExpr("source as doc", "doc_id as page", "text"), golden))


@query("SELECT conv_id, turn, substr(text, 1, 60) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X41, O7, O9."""
    return E.recent_turns(table(spark, sf_dir, "conversations"), 3, 60).select("conv_id", "turn", "text")


@query("SELECT event_id, CASE WHEN k % 3 = 0 THEN 'E' || (100 + k) WHEN k % 3 = 1 THEN 'E' || (200 + k) END AS code FROM ev")
def observed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X34."""
    ev = readings(spark, sf_dir)
    explicit = F.expr("if(k % 3 = 0, concat('E', 100 + k), 'E12')")
    trigger = F.expr("if(k % 3 = 1, concat('E', 200 + k), code)")
    return ev.select("event_id", E.observed_code(explicit, trigger).alias("code"))


@query(f"SELECT gun, (max(t) - min(t)) // {HOUR} + 1 AS active_min FROM ev GROUP BY 1")
def warning_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour stands for a minute."""
    return E.warning_block(readings(spark, sf_dir).groupBy("gun").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t")), HOUR).select("gun", "active_min")


@query("SELECT gun, max(t) AS t, arg_max(event_id, t) AS event_id FROM ev WHERE code <> 'view' GROUP BY 1")
def latest_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X33."""
    ev = readings(spark, sf_dir).withColumn("severity", F.when(F.col("code") == "view", "normal").otherwise("warning"))
    return E.latest_focus(ev).select("gun", "t", "event_id")


@query("SELECT o_orderkey AS event_id, coalesce(o_orderstatus IN ('F', 'O') AND (o_custkey % 4 = 0 OR o_custkey % 4 IN (1, 2)), false) AS ok FROM orders")
def replay_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X38."""
    o = table(spark, sf_dir, "orders")
    actual = o.selectExpr("o_orderkey as event_id", "o_orderstatus as status", "if(o_custkey % 4 = 0, null, cast(o_custkey % 4 as int)) as chosen_id")
    return E.replay_check(actual, o.selectExpr("o_orderkey as event_id", "array('F', 'O') as acceptable", "array(1, 2) as applicable")).select("event_id", "ok")


@query("""SELECT o_orderkey AS id, coalesce(c_mktsegment = CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AND o_orderkey % 30 BETWEEN 1 AND c_nationkey, false) AS current
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def current_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X39."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as doc", "c_mktsegment as sha256", "c_nationkey as pages")
    rows = table(spark, sf_dir, "orders").join(c.withColumnRenamed("doc", "o_custkey"), "o_custkey").selectExpr("o_orderkey as id", "array(named_struct('doc', o_custkey, 'sha256', if(o_orderkey % 5 = 0, 'x', sha256), 'page', o_orderkey % 30)) as refs")
    return E.current_sources(rows, c)


# predicates and text


@query("SELECT event_id, round(value * 2 + 3 * k, 6) AS x FROM ev WHERE code <> 'error' AND k >= 50")
def unscaled_normal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, P11."""
    ev = readings(spark, sf_dir).withColumn("label", (F.col("k") < 50).cast("int")).withColumn("error_active", (F.col("code") == "error").cast("int"))
    return rounded(P.normal_rows(ev).select("event_id", P.unscale(F.col("value"), F.lit(2.0), F.col("k"), 3).alias("x")))


@query(f"SELECT gun, t // {DAY} AS slot, coalesce(stddev_pop(value), 0) > 1e-6 AS switched FROM ev GROUP BY 1, 2 HAVING count(*) FILTER (WHERE code = 'error') = 0 AND avg(CASE WHEN code = 'view' THEN 1.0 ELSE 0.0 END) <= 0.5")
def clean_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P14."""
    w = readings(spark, sf_dir).groupBy("gun", F.floor(F.col("t") / DAY).alias("slot")).agg(F.max((F.col("code") == "error").cast("int")).alias("error_active"), F.avg((F.col("code") == "view").cast("double")).alias("non_welding"), F.stddev_pop("value").alias("s"))
    return P.clean_windows(w).select("gun", "slot", P.switched(F.col("s"), F.lit(0.0)).alias("switched"))


@query("SELECT DISTINCT split_part(code || '_' || source, '_', 1) AS sensor, source AS statistic FROM (SELECT code, CASE WHEN k >= 50 THEN 'mean' ELSE 'std' END AS source FROM ev)")
def feature_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, P19."""
    ev = readings(spark, sf_dir).select(F.concat_ws("_", "code", F.when(F.col("k") >= 50, "mean").otherwise("std")).alias("name"), F.lit(1).alias("c19_x"))
    sensor, statistic = P.feature_parts(F.col("name"))
    return P.without_prefix(ev, "c19_").select(sensor.alias("sensor"), statistic.alias("statistic")).distinct()


@query(f"SELECT event_id, CASE WHEN k < 10 THEN t WHEN code = 'error' THEN t + 5 ELSE t + {HOUR} - 7 END AS at, CASE WHEN k BETWEEN 3 AND 60 THEN k END AS n FROM ev")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X29, X36."""
    ev = readings(spark, sf_dir)
    at = P.sample_time(F.expr("if(k < 10, t, null)"), F.expr("if(code = 'error', t + 5, null)"), F.col("t") + HOUR, F.lit(7))
    slots = P.clock_slots(F.col("t"), F.col("t") + F.col("k") * 60, 60)
    return ev.select("event_id", at.alias("at"), F.when(slots.isNotNull(), F.size(slots)).alias("n"))


@query(f"SELECT event_id, CAST(t // {DAY} - max(t // {DAY}) OVER (PARTITION BY gun) AS INTEGER) AS \"offset\" FROM ev")
def end_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T28."""
    ev = readings(spark, sf_dir).withColumn("slot", F.floor(F.col("t") / DAY))
    return P.offsets(ev, "slot", "gun").select("event_id", "offset")


@query("""SELECT event_id, sha256('{"code":"' || code || '","gun":' || gun || ',"k":' || k || '}') AS key FROM ev""")
def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache key from canonical JSON."""
    return readings(spark, sf_dir).select("event_id", F.sha2(X.canonical_json(k=F.col("k"), gun=F.col("gun"), code=F.col("code")), 256).alias("key"))


@query("SELECT event_id, CASE WHEN k % 3 = 0 THEN 'E101' WHEN k % 3 = 1 THEN 'E' || (300 + k) END AS code FROM ev")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: one supported code, none, several."""
    text = F.expr("case when k % 3 = 0 then concat('see E', 300 + k, ' or E101') when k % 3 = 1 then concat('E', 300 + k, ' XE101') else 'E101 and E102' end")
    return readings(spark, sf_dir).select("event_id", X.error_code(text, ["E101", "E102"]).alias("code"))


@query(f"SELECT doc_id, contains({_COLLAPSED.format('text')}, {_COLLAPSED.format('substr(text, 3, 9)')}) AS holds FROM documents")
def quote_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    return table(spark, sf_dir, "documents").select("doc_id", X.holds(F.col("text"), F.substring("text", 3, 9)).alias("holds"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT d.doc_id, (SELECT line FROM l WHERE l.doc_id = d.doc_id AND contains(line, 'a') ORDER BY length(line), i LIMIT 1) AS line FROM documents d""")
def shortest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return table(spark, sf_dir, "documents").select("doc_id", X.shortest_line(F.col("text"), F.lit("a")).alias("line"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'name: ' || c_name ELSE 'name: ' || c_name || ' | segment: ' || c_mktsegment END AS text FROM customer")
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1."""
    c = table(spark, sf_dir, "customer")
    cells = F.array("c_name", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")), F.lit(None).cast("string"))
    return c.select("c_custkey", X.row_text(F.array(F.lit("name"), F.lit("segment"), F.lit("none")), cells).alias("text"))


@query("""SELECT event_id, CASE WHEN k >= 55 THEN 'a_mean:high' WHEN k <= 45 THEN 'a_mean:low' ELSE '' END AS found, CASE WHEN k > 20 THEN 'a_mean' ELSE '' END AS top,
round((SELECT quantile_cont(value, 0.99) FROM ev WHERE code <> 'error'), 6) AS threshold FROM ev""")
def findings_of_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature's contribution and deviation, the clock's left out."""
    ev = readings(spark, sf_dir).withColumn("a_mean", F.col("k") / 10.0).withColumn("dow_x", F.lit(9.0))
    part = lambda name, c: F.struct(F.lit(name).alias("feature"), c.cast("double").alias("contribution"), F.lit(0.5).alias("share"))
    # deviations from 5: 0.5 up from k = 55 on, down from k = 45 on
    ev = ev.withColumn("c", F.array(part("dow_x", F.lit(9.0)), part("a_mean", F.col("k") - 20))).withColumn("d", scoring.deviations(["a_mean", "dow_x"], [5.0, 0.0]))
    found = scoring.findings(F.array(part("dow_x", F.lit(9.0)), part("a_mean", F.lit(1.0))), F.col("d"))
    line = F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["feature"], f["direction"])), ",")
    top = F.array_join(F.transform(scoring.top_contributors(F.col("c")), lambda f: f["feature"]), ",")
    limit = scoring.threshold_of(ev, "value", F.col("code") != "error")
    return rounded(ev.crossJoin(F.broadcast(limit)).select("event_id", line.alias("found"), top.alias("top"), "threshold"))  # one row
