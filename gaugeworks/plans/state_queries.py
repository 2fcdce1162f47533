"""Queries on streams, files written and read back, case state, cards, answers and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import text as X
from gaugeworks.functions import vectors
from gaugeworks.operators import cases as C
from gaugeworks.operators import evidence as E
from gaugeworks.operators import experiments
from gaugeworks.operators import features as W
from gaugeworks.operators import prep as P
from gaugeworks.operators import retrieval as R
from gaugeworks.operators import stats as S
from gaugeworks.operators.staging import scratch
from gaugeworks.plans.registry import DAY, drawn, micros, query, readings, rounded, table
from gaugeworks.sources import readers, writers
from gaugeworks.streaming import alarms

HOURS6, HOURS2 = 21_600_000_000, 7_200_000_000

# streams: what the watermark has passed, one hour behind the newest row


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = readers.stream_of(spark, f"{sf_dir}/events*.parquet", schema, files=10_000)  # a pattern finds a file as well as a folder
    return rows.select(F.col("user_id").alias("gun_id"), F.expr(f"timestamp_micros({micros('ts')})").alias("time"), "value")


def _run(windows: DataFrame, name: str) -> DataFrame:
    """All that the stream gives until its input ends, from a table in the shared folder."""
    spark = windows.sparkSession
    out = scratch(spark, name)
    checkpoint = alarms.state_folder(scratch(spark, f"{name}-state"), name)
    q = windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(windows.schema).parquet(out)
    times = {n: F.unix_micros(n) for n, kind in found.dtypes if kind == "timestamp"}
    return rounded(found.withColumns(times))


_PASSED = "(SELECT max(t) - 3600000000 FROM ev)"


@query(f"""WITH w AS (SELECT gun AS gun_id, t // {HOURS6} * {HOURS6} AS w_start, count(*) AS n, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std FROM ev GROUP BY 1, 2)
SELECT gun_id, w_start, w_start + {HOURS6} AS w_end, n, value_mean, value_std FROM w WHERE w_start + {HOURS6} <= {_PASSED}""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R3, S7, S8."""
    return _run(alarms.complete_windows(_stream(spark, sf_dir), "6 hours", "1 hour", ["value"]), "tumbling")


@query(f"""WITH w AS (SELECT gun AS gun_id, t // {HOURS2} * {HOURS2} - i * {HOURS2} AS w_start, count(*) AS n, round(avg(value), 6) AS mean FROM ev, (SELECT unnest([0, 1, 2]) AS i) GROUP BY 1, 2)
SELECT gun_id, w_start, w_start + {HOURS6} AS w_end, n, mean FROM w WHERE w_start + {HOURS6} <= {_PASSED}""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R29."""
    return _run(alarms.sliding_windows(_stream(spark, sf_dir), "6 hours", "2 hours", "1 hour", "value"), "sliding")


@query(f"""WITH p AS (SELECT *, t - lag(t) OVER (PARTITION BY gun ORDER BY t, event_id) AS step FROM ev),
s AS (SELECT *, count_if(step IS NULL OR step > {HOURS6}) OVER (PARTITION BY gun ORDER BY t, event_id) AS session FROM p),
w AS (SELECT gun AS gun_id, min(t) AS s_start, max(t) + {HOURS6} AS s_end, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY gun, session)
SELECT * FROM w WHERE s_end // 1000 <= {_PASSED} // 1000""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R29."""
    return _run(alarms.session_windows(_stream(spark, sf_dir), "6 hours", "1 hour", "value"), "sessions")


# files


@query("SELECT CAST(c_custkey AS VARCHAR) AS gun_id, epoch_us(TIMESTAMP '2021-09-01') + c_custkey * 1000000 AS t, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS c10, c_acctbal AS c11 FROM customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written as CSV, one folder of files, and read with their types."""
    c = table(spark, sf_dir, "customer").where("c_custkey is not null")
    values = {f"c{i}": F.lit(0.0) for i in range(1, 20)} | {"c10": F.when(F.col("c_custkey") % 2 == 0, "on").otherwise("off"), "c11": F.col("c_acctbal")}
    values["c19"] = F.col("c_custkey").cast("double")
    at = F.date_format(F.expr("timestamp_ntz'2021-09-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = c.select(at.alias("time"), *[v.alias(n) for n, v in values.items()], F.lit(None).cast("string").alias("error"))
    path = scratch(spark, "readings")
    writers.save(rows, path, "csv")
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = readers.readings_csv(spark, path, ["time", "c10", "c11", "c19"])
    shift = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', to_utc_timestamp(time, '{zone}'))")
    return found.select(F.col("c19").cast("long").cast("string").alias("gun_id"), shift.alias("t"), "c10", "c11")


_LINE = "CASE WHEN c_custkey % 11 = 0 THEN '{\"id\": ' WHEN c_custkey % 7 = 0 THEN '{\"n\": ' || c_nationkey || '}' ELSE '{\"id\": ' || c_custkey || ', \"n\": ' || c_nationkey || '}' END"


@query("""SELECT c_custkey AS id, c_nationkey AS n, NULL AS error, 1::BIGINT AS lines FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0
UNION ALL SELECT NULL, NULL, CASE WHEN c_custkey % 11 = 0 THEN 'not JSON of this schema' ELSE 'missing id' END, count(*) FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 7 = 0 GROUP BY 3""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines, and how many are bad for which reason."""
    path = scratch(spark, "lines")
    table(spark, sf_dir, "customer").select(F.expr(_LINE).alias("value")).write.text(path)
    good, bad = readers.json_lines(spark, path, "id bigint, n int", ["id"])
    wrong = bad.groupBy("error").agg(F.count("*").alias("lines"))
    return good.select("id", "n", F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("lines")).unionByName(wrong, allowMissingColumns=True)


@query("SELECT r_regionkey, r_name FROM region")
def json_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON and read by their schema."""
    path, r = scratch(spark, "folder"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    r.write.option("maxRecordsPerFile", 1).json(path)
    return readers.json_folder(spark, path, "r_regionkey int, r_name string")


@query("""SELECT n_nationkey AS id, count(c_custkey) AS edges FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1""")
def graph_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written, and one label's part of it restored after a check of the counts."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    label = F.col("n_regionkey").cast("string").alias("label")
    nodes = n.select(F.col("n_nationkey").cast("long").alias("id"), label).unionByName(c.select((F.col("c_custkey") + 1000).alias("id"), label))
    edges = c.select((F.col("c_custkey") + 1000).alias("source"), F.col("n_nationkey").cast("long").alias("target"), F.lit("in").alias("type"))
    path = scratch(spark, "graph")
    own, inside = writers.restore_graph(spark, path, "1", writers.backup_graph(nodes, edges, path))
    held = inside.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("edges"))
    return own.where("id < 1000").select("id").join(held, "id", "left").fillna(0, ["edges"])


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE n_chars END AS size FROM documents")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only chunks without an embedding of the model get one."""
    d = table(spark, sf_dir, "documents")
    have = F.expr("case when doc_id % 3 <> 2 then array(-1L) end").alias("embedding")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "text", have, F.expr("if(doc_id % 3 = 0, 'm2', 'm1')").alias("model"))
    made = writers.indexed(chunks, lambda rows: rows.select("chunk_id", F.array(F.length("text").cast("long")).alias("embedding")), "m2")
    return made.select("chunk_id", F.col("embedding")[0].alias("size"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'new' FROM orders WHERE o_orderkey % 5 = 0")
def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12, C2."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    fresh = o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("new"))
    return writers.upserted(o, fresh.unionByName(fresh.withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)), "o_orderkey")


# case state


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as event_id", "o_orderpriority as pattern_key", "case o_orderstatus when 'O' then 'pending' when 'F' then 'done' else 'failed' end as status",
        "cast(o_orderkey % 4 as int) as attempts", f"{micros('o_orderdate')} as next_attempt_at",
    )


_OUTBOX = "b AS (SELECT o_orderkey AS event_id, o_orderpriority AS pattern_key, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, CAST(o_orderkey % 4 AS INTEGER) AS attempts, epoch_us(o_orderdate) AS next_attempt_at FROM orders)"
_NOW = 900_000_000_000_000


@query(f"WITH {_OUTBOX} SELECT event_id, pattern_key, status, attempts + 1 AS attempts, {_NOW + 60}::BIGINT AS next_attempt_at FROM (SELECT * FROM b WHERE status = 'pending' AND next_attempt_at <= {_NOW} ORDER BY b.next_attempt_at, event_id LIMIT 20)")
def claimed_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty that have been due longest."""
    return C.claimed(_outbox(spark, sf_dir), _NOW, _NOW + 60, 20)


@query(f"WITH {_OUTBOX} SELECT event_id, pattern_key, CASE WHEN status = 'pending' AND attempts < 2 THEN 'done' ELSE status END AS status, attempts, CASE WHEN status = 'pending' AND attempts < 2 THEN 0 ELSE next_attempt_at END AS next_attempt_at FROM b")
def finished_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to an attempt that is not the last one change nothing."""
    b = _outbox(spark, sf_dir)
    answers = b.select("event_id", F.least("attempts", F.lit(1)).alias("attempts"), F.lit("done").alias("status"), F.lit(0).alias("next_attempt_at"))
    return C.finished(b, answers)


@query(f"WITH {_OUTBOX} SELECT pattern_key, bool_or(status IN ('pending', 'failed')) AS pending FROM b GROUP BY 1")
def pending_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    return C.pending_patterns(_outbox(spark, sf_dir))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'P' AND epoch_us(o_orderdate) <= 900000000000000),
m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC) AS place FROM k WHERE n = 1)
SELECT o_custkey, o_orderpriority AS case_id, o_orderkey, substr(o_orderpriority || o_orderkey, 1, 9) AS note FROM m WHERE place <= 3""")
def bounded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's newest three, the last of each priority."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderpriority as case_id", "o_orderkey as position", f"{micros('o_orderdate')} as closed_at", "o_orderstatus as outcome", "concat(o_orderpriority, o_orderkey) as note")
    found = E.bounded_context(o, _NOW, ["o_custkey"], ["O", "F"], 3, 9)
    return found.select("o_custkey", "case_id", F.col("position").alias("o_orderkey"), "note")


@query("""SELECT o_custkey AS card_id, max(o_orderkey) AS position FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0) GROUP BY 1""")
def latest_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("card_id"), F.col("o_orderkey").alias("position"))
    return C.cards(rows, table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("card_id")))


@query("""WITH l AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT o_custkey, coalesce(string_agg(p, ',' ORDER BY k) FILTER (WHERE p <> '1-URGENT'), '') AS kept FROM l GROUP BY 1""")
def rejected_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of cards, each once at its first place, without a rejected one."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("card_id")))).alias("items"))
    kept = C.without_rejected(C.distinct_in_order(F.col("items"), "card_id"), F.array(F.lit("1-URGENT")))
    return o.select("o_custkey", F.array_join(F.transform(kept, lambda x: x["card_id"]), ",").alias("kept"))


_SEEN = "s AS (SELECT o_custkey, o_orderpriority AS p, arg_max(o_totalprice, (o_orderstatus = 'O', o_orderkey)) AS price FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2)"


@query(f"WITH {_SEEN} SELECT o_custkey, count(*) AS cards, round(sum(price), 2) AS price FROM s GROUP BY 1")
def seen_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards shown in open orders replace those of closed ones."""

    def shown(status: str, name: str) -> DataFrame:
        own = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
        return own.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "price"))).alias(name))

    both = shown("F", "old").join(shown("O", "new"), "o_custkey", "full_outer")
    prices = F.map_values(C.seen_cards(F.col("old"), F.col("new")))
    return both.select("o_custkey", F.size(prices).cast("long").alias("cards"), F.round(F.aggregate(prices, F.lit(0.0), lambda a, x: a + x), 2).alias("price"))


@query("SELECT c_custkey, count(*) AS times FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 15 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1 HAVING count(*) > 1")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3."""
    c = table(spark, sf_dir, "customer")
    return C.disjoint(c.where("c_nationkey < 15"), c.where("c_acctbal > 0"), key="c_custkey")


@query("SELECT event_id, CASE WHEN k < 20 THEN 'episode:' || k WHEN code = 'error' THEN 'early_warning' ELSE code END AS grp FROM ev")
def handoff_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    kind = F.when(F.col("code") == "error", "early_warning")
    return readings(spark, sf_dir).select("event_id", C.group_key(F.when(F.col("k") < 20, F.col("k").cast("string")), kind, F.col("code")).alias("grp"))


# documents and answers


@query("""WITH l AS (SELECT o_custkey AS doc_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'section' WHEN 'O' THEN 'prose' ELSE 'table_marker' END AS kind, o_orderpriority || o_orderkey AS line FROM orders),
r AS (SELECT *, count_if(line LIKE '5-%') OVER (PARTITION BY doc_id ORDER BY o_orderkey) AS block FROM l)
SELECT doc_id, o_orderkey, last_value(CASE WHEN kind = 'section' THEN line END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN kind = 'table_marker' THEN line END IGNORE NULLS) OVER w AS table_title
FROM r WINDOW w AS (PARTITION BY doc_id, block ORDER BY o_orderkey)""")
def carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of their customer's document."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey as doc_id", "o_orderkey", "case o_orderstatus when 'F' then 'section' when 'O' then 'prose' else 'table_marker' end as kind", "concat(o_orderpriority, o_orderkey) as line")
    found = E.carried_headings(o, F.col("kind"), order="o_orderkey", reset=F.startswith("line", F.lit("5-")))
    return found.select("doc_id", "o_orderkey", "section", "table_title")


@query("""SELECT doc_id, CAST(1 AS INTEGER) AS page, CASE WHEN doc_id % 7 = 0 THEN 'no blocks' WHEN doc_id % 5 = 0 THEN 'an id repeats' WHEN doc_id % 3 = 0 THEN 'order has gaps' ELSE 'text differs' END AS problem
FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0 OR doc_id % 11 = 0""")
def reconciled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: documents as pages of two blocks, some with faults."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("head\n"), F.coalesce("text", F.lit(""))).alias("text"))
    blocks = d.where("doc_id % 7 <> 0").withColumn("order", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(
        "doc_id", "page", "if(order = 1 and doc_id % 3 = 0, 2, order) as order", "if(order = 1 and doc_id % 5 <> 0, 'b', 'a') as block_id",
        "if(order = 0, 'head', concat(substring(text, 6), if(doc_id % 11 = 0, ' and more', ''))) as text",
    )
    return E.reconciled(blocks, d)


@query("""WITH a AS (SELECT o_custkey, o_orderkey % 10 AS c, o_orderkey % 6 AS page FROM orders),
n AS (SELECT o_custkey, count_if(c > 6) AS unknown, count(c) - count(DISTINCT c) AS repeated, count_if(page > 4) AS outside FROM a GROUP BY 1)
SELECT o_custkey AS answer_id, concat_ws(',', CASE WHEN unknown > 0 THEN 'unknown:' || unknown END, CASE WHEN repeated > 0 THEN 'repeated:' || repeated END, CASE WHEN outside > 0 THEN 'outside:' || outside END) AS problems FROM n""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K30, X40."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("answer_id")).agg(
        F.collect_list((F.col("o_orderkey") % 10).cast("string")).alias("check_ids"), F.collect_list(F.struct(F.lit("d").alias("doc"), (F.col("o_orderkey") % 6).alias("page"))).alias("citations")
    )
    checks = spark.range(7).select(F.col("id").cast("string").alias("check_id"))
    found = E.valid_citations(a, checks, spark.range(5).select(F.lit("d").alias("doc"), F.col("id").alias("page")))
    return found.select("answer_id", F.array_join("problems", ",").alias("problems"))


@query("""WITH q AS (SELECT doc_id, doc_id % 3 = 0 AS coded, doc_id % 4 = 0 AS names, doc_id % 5 = 0 AS false_quote, doc_id % 7 = 0 AS silent, coalesce(text, '') AS text FROM documents)
SELECT doc_id AS question_id, concat_ws(',', CASE WHEN silent THEN 'no reference or source' END, CASE WHEN coded AND NOT names THEN 'code not named' END, CASE WHEN NOT coded AND names THEN 'a code named' END, CASE WHEN false_quote THEN 'quote not on its page' END) AS problems FROM q WHERE length(text) > 40""")
def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on documents, with their quotes and packs."""
    d = table(spark, sf_dir, "documents").where("length(text) > 40")
    questions = d.selectExpr("doc_id as question_id", "doc_id as pack_id", "if(doc_id % 3 = 0, 'E012', null) as code", "if(doc_id % 4 = 0, 'what of E012', 'what') as question", "if(doc_id % 7 = 0, ' ', 'so') as reference")
    quotes = d.selectExpr("doc_id as question_id", "source as doc", "1 as page", "if(doc_id % 5 = 0, 'words of no document', trim(substring(text, 1, 30))) as quote").withColumn("quote", F.expr("if(length(trim(quote)) < 12, 'words of no document', quote)"))
    return E.valid_questions(questions, quotes, d.selectExpr("doc_id as pack_id", "source as doc", "1 as page", "text")).select("question_id", F.array_join("problems", ",").alias("problems"))


@query("""WITH o AS (SELECT gun, code, count(*) AS n, arg_min(value, t) AS a, arg_max(value, t) AS b FROM ev GROUP BY 1, 2)
SELECT gun AS event_id, string_agg(concat_ws(' ', CASE code WHEN 'click' THEN 'tip' WHEN 'view' THEN 'flow' ELSE 'fault' END, CASE WHEN n > 4 THEN 'transition' ELSE 'constant' END, CASE WHEN a < b THEN 'increase' WHEN a > b THEN 'decrease' END), chr(10) ORDER BY code) AS query
FROM o WHERE code IN ('click', 'view', 'error') GROUP BY 1""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a gun's codes did, in words; codes without a name are left out."""
    o = readings(spark, sf_dir).groupBy(F.col("gun").alias("event_id"), F.col("code").alias("channel")).agg(
        F.greatest(F.count("*") - 4, F.lit(0)).alias("change_count"), F.min_by("value", "t").alias("first"), F.max_by("value", "t").alias("last")
    )
    return E.search_text(o, {"click": "tip", "view": "flow", "error": "fault", "signup": "left"}, ["signup"])


@query("""WITH p AS (SELECT *, lag(o_totalprice) OVER w AS edge, lag(o_orderstatus) OVER w AS head, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey))
SELECT o_orderkey, coalesce(o_orderkey = before + 1 AND head = o_orderstatus AND abs(edge - o_totalprice) < 50000, false) AS continues FROM p""")
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: orders as pages, a hundred a document."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey div 100 as doc_id", "o_orderkey", "o_orderstatus", "o_totalprice")
    return R.continued(o, page="o_orderkey", headers="o_orderstatus", edge="o_totalprice", most=50000.0).select("o_orderkey", "continues")


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS letters FROM documents WHERE regexp_full_match(text, '[\x00-\x7f]*')")
def letters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, of texts whose letters both engines lower alike."""
    return table(spark, sf_dir, "documents").where(r"text rlike '^[\\x00-\\x7f]*$'").select("doc_id", F.md5(X.letters_only(F.col("text"))).alias("letters"))


@query("SELECT event_id FROM ev WHERE code <> 'none'")
def version_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are of the version, or the query fails."""
    return E.same_version(readings(spark, sf_dir).where("code <> 'none'").withColumn("version", F.lit("v1")), F.col("version"), "v1").select("event_id")


@query("SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS likeness FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each vector against that of the next id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rounded(e.join(nxt, "vec_id").select("vec_id", vectors.cosine(F.col("a"), F.col("b")).alias("likeness")))


# comparisons and samples

_WEIGHT = " + ".join(f"CAST(u >= {p!r} AS INTEGER)" for p in S.POISSON)


@query(f"""WITH o AS (SELECT gun, avg(value) - avg(k) AS d FROM ev GROUP BY 1), u AS (SELECT i, d, {drawn("0", "gun", "i")} AS u FROM o, (SELECT unnest(range(1, 101)) AS i)),
m AS (SELECT i, sum(d * ({_WEIGHT})) / sum({_WEIGHT}) AS mean FROM u GROUP BY 1) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4."""
    return rounded(S.paired_difference(readings(spark, sf_dir), "value", "k", 100))


@query("SELECT c_custkey AS file FROM customer WHERE c_nationkey NOT IN (1, 2, 3) AND c_acctbal <= 5000")
def shadow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), "c_nationkey", "c_acctbal")
    return S.shadow_files(c.select("file"), c.where("c_nationkey in (1, 2, 3)"), c.where("c_acctbal > 5000"))


@query("""WITH p AS (SELECT gun, max(value) AS r, max(k * 2.0) AS p, count(k) AS n FROM ev GROUP BY 1 HAVING count(k) >= 8)
SELECT count(*) AS keys, count_if(r > p) AS better, round(sum(1 / (n + 1)), 6) AS expected FROM p""")
def beats_placebos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11."""
    return rounded(experiments.beats_placebos(readings(spark, sf_dir).withColumn("p", F.col("k") * 2.0), "value", "p"))


@query("""WITH m AS (SELECT gun, t, code, max(t) OVER (PARTITION BY gun) - t AS ttf FROM ev), f AS (SELECT gun, max(ttf) AS f FROM m WHERE code = 'error' GROUP BY 1)
SELECT count(*) AS keys, round(quantile_cont(f, 0.1), 3) AS low, round(quantile_cont(f, 0.5), 3) AS median, round(quantile_cont(f, 0.9), 3) AS high FROM f""")
def onset_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13."""
    found = experiments.onset_quantiles(P.with_ttf(readings(spark, sf_dir), DAY), F.col("code") == "error")
    return rounded(found.select("keys", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("low", "median", "high"))]), 3)


@query("""WITH g AS (SELECT o_custkey, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
p AS (SELECT o_custkey, o_orderkey, o_orderpriority AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders QUALIFY place <= 5),
h AS (SELECT p.o_custkey, count(*) AS n, count(g.label) AS r, count(DISTINCT g.label) AS c FROM p LEFT JOIN g USING (o_custkey, label) GROUP BY 1)
SELECT o_custkey AS case_id, round(any_value(r) / any_value(n), 6) AS precision, round(any_value(c) / count(*), 6) AS recall FROM g JOIN h USING (o_custkey) GROUP BY 1""")
def card_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X37, E36."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey", F.col("o_orderpriority").alias("label"), "o_orderstatus")
    place = F.row_number().over(C.Window.partitionBy("case_id").orderBy("o_orderkey"))
    return rounded(experiments.card_scores(o.select("case_id", place.alias("place"), F.array("label").alias("labels")), o.where("o_orderstatus = 'F'")))


@query(f"SELECT event_id, CAST(floor((max(e - t) OVER (PARTITION BY gun) - (e - t)) / {DAY}) AS BIGINT) AS day FROM (SELECT *, max(t) OVER (PARTITION BY gun) AS e FROM ev)")
def day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return P.with_ttf(readings(spark, sf_dir), DAY).select("event_id", W.day_index(F.col("ttf")).alias("day"))


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 40 ORDER BY {drawn('7', 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber LIMIT 500")
def hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample is the feature."""
    return W.hashed_sample(table(spark, sf_dir, "lineitem").where("l_quantity < 40").select("l_orderkey", "l_linenumber"), 500, ["l_orderkey", "l_linenumber"], 7)
