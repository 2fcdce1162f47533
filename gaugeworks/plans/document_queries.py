"""Queries on documents, search, evidence and waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import text as X
from gaugeworks.operators import retrieval as R
from gaugeworks.operators import waveforms
from gaugeworks.plans.registry import DAY, HOUR, query, readings, rounded, table

_STOP = "('" + "', '".join(X.STOPWORDS) + "')"

_TERMS = f"""terms AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(list_slice(list_distinct_ordered, 1, 24)) AS term FROM
 (SELECT item_id, list_transform(list_filter(list_zip(ts, range(len(ts))), lambda p: list_position(ts, p[1]) = p[2] + 1), lambda p: p[1]) AS list_distinct_ordered FROM
 (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]+'), lambda x: lower(x)), lambda x: x NOT IN {_STOP}) AS ts FROM benchmark))))"""

_BM25 = f"""{_TERMS}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT count(*) AS docs, avg(len(ws)) AS mean_length FROM w), h AS (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM w),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM h WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), s GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 8)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.explode(X.query_terms(F.col("text"))).alias("term"))


def keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_top_k(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), F.col("text"), 8)


@query("WITH " + _TERMS + " SELECT query_id, term FROM terms")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 3) AS score FROM k")
def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir).select("query_id", "doc_id", F.round("score", 3).alias("score"))


_CONTAINS = "g AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {_BM25}, {_CONTAINS}, m AS (SELECT g.query_id, count(*) AS n, count(rank) AS got, min(rank) AS first FROM g LEFT JOIN k ON k.query_id = g.query_id AND k.doc_id = g.doc_id GROUP BY 1), z AS (SELECT query_id, count(*) AS size FROM k GROUP BY 1) SELECT round(avg(got / n), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(got / size, 0)), 6) AS precision FROM m LEFT JOIN z USING (query_id)")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and precision at 8 of the keyword search; gold: documents that hold an item whole."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    gold = R.holders(docs, items).withColumnRenamed("item_id", "query_id")
    return rounded(R.retrieval_metrics(keyword(spark, sf_dir), gold, 8))


_VEC = """v AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))), 6) AS score
FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v QUALIFY rank <= {k})"""


def vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return R.vector_top_k(rows, rows.where("vec_id % 50 = 0").select("vec_id", "embedding"), k)


@query(f"WITH {_VEC.format(k=8)} SELECT query_id, vec_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM t")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, 8).withColumn("score", F.round("score", 4))


@query(f"""WITH {_VEC.format(k=20)}, l AS (SELECT q.vec_id AS query_id, r.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY r.vec_id) AS rank FROM embeddings q JOIN embeddings r USING (label) WHERE q.vec_id % 50 = 0 QUALIFY rank <= 20),
f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, vec_id, rank FROM t UNION ALL SELECT query_id, vec_id, rank FROM l) GROUP BY 1, 2)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 8""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search fused with the first rows of a query's label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    first = rows.withColumn("_n", F.row_number().over(R.Window.partitionBy("label").orderBy("vec_id"))).where("_n <= 20")
    listed = queries.join(first, "label").select("query_id", "vec_id", F.col("_n").alias("rank"))
    out = R.fused_ranks([vectors(spark, sf_dir, 20).select("query_id", "vec_id", "rank"), listed], 8, id_col="vec_id")
    return out.withColumn("score", F.round("score", 6))


_CHUNKS = "c AS (SELECT doc_id AS chunk_id, source AS doc, lang AS section, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chunk_index FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), F.col("lang").alias("section"))
    return d.withColumn("chunk_index", F.row_number().over(R.Window.partitionBy("doc").orderBy("chunk_id")))


@query(f"""WITH {_CHUNKS}, s AS (SELECT chunk_id // 100 AS query_id, * FROM c WHERE chunk_id % 50 = 0)
SELECT query_id, seed, chunk_id, CAST(distance AS INTEGER) AS distance FROM (SELECT s.query_id, s.chunk_id AS seed, c.chunk_id, abs(c.chunk_index - s.chunk_index) AS distance,
row_number() OVER (PARTITION BY s.query_id, s.chunk_id ORDER BY abs(c.chunk_index - s.chunk_index), c.chunk_id) AS n FROM s JOIN c ON c.doc = s.doc AND c.section = s.section AND abs(c.chunk_index - s.chunk_index) BETWEEN 1 AND 2) WHERE n <= 3""")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    seeds = c.where("chunk_id % 50 = 0").select(F.floor(F.col("chunk_id") / 100).alias("query_id"), "chunk_id")
    return R.neighbours(seeds, c)


@query("""WITH RECURSIVE r AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97, doc_id) AS rank, n_chars AS size, doc_id % 25 = 0 AS required FROM documents),
f AS (SELECT query_id, rank, size AS used, true AS kept FROM (SELECT *, required OR size <= 18000 AS ok FROM r WHERE rank = 1) WHERE ok
 UNION ALL SELECT query_id, rank, 0, false FROM (SELECT *, required OR size <= 18000 AS ok FROM r WHERE rank = 1) WHERE NOT ok
 UNION ALL SELECT r.query_id, r.rank, CASE WHEN r.required OR f.used + r.size <= 18000 THEN f.used + r.size ELSE f.used END, r.required OR f.used + r.size <= 18000 FROM f JOIN r ON r.query_id = f.query_id AND r.rank = f.rank + 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank FROM f WHERE kept""")
def budget_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query_id"), F.col("n_chars").alias("size"))
    ranked = d.withColumn("rank", F.row_number().over(R.Window.partitionBy("query_id").orderBy(F.expr("size % 97"), "doc_id"))).withColumn("required", F.expr("doc_id % 25 = 0"))
    return R.within_budget(ranked, 18000)


_LINES = r"""u AS (SELECT doc_id, CAST(i AS INTEGER) AS position, line, length(line) AS size, CASE WHEN contains(line, ' | ') THEN 'table_row' ELSE 'prose' END AS group_key FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    kind = F.when(F.contains("line", F.lit(" | ")), "table_row").otherwise("prose")
    return d.select("doc_id", "position", "line", F.length("line").alias("size"), kind.alias("group_key"))


@query(f"""WITH RECURSIVE {_LINES}, f AS (SELECT doc_id, position, size AS n, group_key AS g, 0 AS chunk FROM u WHERE position = 0
 UNION ALL SELECT u.doc_id, u.position, CASE WHEN u.group_key <> f.g OR f.n + 1 + u.size > 1200 THEN u.size ELSE f.n + 1 + u.size END, u.group_key,
 CASE WHEN u.group_key <> f.g OR f.n + 1 + u.size > 1200 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN u ON u.doc_id = f.doc_id AND u.position = f.position + 1)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, min(position) AS first_unit, count(*) AS n_units FROM f GROUP BY 1, 2""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = R.packed_chunks(units(spark, sf_dir).drop("line"), 1200)
    return packed.groupBy("doc_id", "chunk").agg(F.min("position").alias("first_unit"), F.count("*").alias("n_units"))


@query(rf"""WITH {_LINES} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(line, '^Error number:\s*(\d+)\s*\|') THEN 'error_row' WHEN regexp_matches(line, '^Cause:\s*.+\s\|\sRemedy:\s*.+') THEN 'cause_remedy'
WHEN regexp_matches(line, '^\[Table(?:\s|;)') THEN 'table_marker' WHEN regexp_matches(line, '^\[(?:Figure|Fig\.|Uncaptioned image)') THEN 'figure' WHEN regexp_matches(line, '^\d+(?:\.\d+)*\s+\S') THEN 'section'
WHEN contains(line, ' | ') THEN 'table_row' ELSE 'prose' END AS kind FROM u) GROUP BY 1""")
def unit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).groupBy(X.unit_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '(?m)^\d+(?:\.\d+)*\s+\S.*$', '', 'g'), '[^A-Za-z가-힣]', '', 'g')) >= 20 AS searchable FROM documents")
def searchable_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.searchable(F.col("text")).alias("searchable"))


@query(r"SELECT doc_id, substr(sha256(source || '|' || lang || '|' || n_chars), 1, 20) AS chunk_id, trim(regexp_replace(regexp_replace(text, '-[ \t]*\n[ \t]*', '', 'g'), '[\s\x0b]+', ' ', 'g')) AS text FROM documents")
def normalised_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.hash_id(F.col("source"), F.col("lang"), F.col("n_chars"), length=20).alias("chunk_id"), X.collapsed(F.col("text")).alias("text"))


@query("""WITH p AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lu FROM conversations),
b AS (SELECT p.*, c.text AS before FROM p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.lu AND c.role = 'user' WHERE p.role = 'user')
SELECT conv_id, turn, max(CASE WHEN regexp_matches(text, 'that|this') AND before <> '' THEN before || chr(10) || text ELSE text END) AS query FROM b GROUP BY 1, 2""")
def followup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn with the user's turn before it, where it refers back (here: that, this)."""
    c = table(spark, sf_dir, "conversations")
    w = R.Window.partitionBy("conv_id").orderBy("turn")
    before = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w.rowsBetween(R.Window.unboundedPreceding, -1))
    rows = c.withColumn("before", before).where("role = 'user'")
    return rows.groupBy("conv_id", "turn").agg(F.max(X.follow_up_query(F.col("text"), F.col("before"), "that|this")).alias("query"))


_SERIES = f"""x AS (SELECT gun * 1000 + t // {10 * DAY} AS event_id, unnest(['value', 'k']) AS channel, CAST((t % {10 * DAY}) // {8 * HOUR} AS INTEGER) AS o, unnest([value, CAST(k AS DOUBLE)]) AS v, t FROM ev),
s AS (SELECT event_id, channel, o AS "offset", arg_max(v, t) AS value FROM x GROUP BY 1, 2, 3)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days of a gun are an event; its channels are value and k, each offset eight hours."""
    ev = readings(spark, sf_dir).withColumn("event_id", F.col("gun") * 1000 + F.floor(F.col("t") / (10 * DAY))).withColumn("offset", F.floor(F.expr(f"t % {10 * DAY}") / (8 * HOUR)).cast("int"))
    long = ev.select("event_id", "offset", "t", "value", F.col("k").cast("double").alias("k")).unpivot(["event_id", "offset", "t"], ["value", "k"], "channel", "v")
    return long.groupBy("event_id", "channel", "offset").agg(F.max_by("v", "t").alias("value"))


_DIRECTION = f"""{_SERIES}, d AS (SELECT event_id, channel, quantile_cont(CASE WHEN "offset" < 10 THEN value END, 0.5) AS a, quantile_cont(CASE WHEN "offset" >= 20 THEN value END, 0.5) AS b,
 count(CASE WHEN "offset" < 10 THEN value END) AS na, count(CASE WHEN "offset" >= 20 THEN value END) AS nb FROM s GROUP BY 1, 2), e AS (SELECT event_id, channel, CASE WHEN na * 2 >= 10 AND nb * 2 >= 10 THEN CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' END END AS direction FROM d)"""


@query(f"WITH {_DIRECTION} SELECT * FROM e")
def channel_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.directions(series(spark, sf_dir), 30)


@query(f"WITH {_DIRECTION} SELECT event_id, CASE WHEN count(direction) = 2 THEN 'direction-v1:' || string_agg(channel || ':' || direction, '|' ORDER BY channel) END AS pattern_key FROM e GROUP BY 1")
def pattern_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pattern_keys(R.directions(series(spark, sf_dir), 30), channels=2)


_WAVE = f"""{_SERIES}, n AS (SELECT event_id, channel, count(*) AS n FROM s GROUP BY 1, 2), w AS (SELECT event_id, count(*) AS width FROM n GROUP BY 1),
g AS (SELECT a.event_id, b.event_id AS past_id, a.channel, count(*) AS shared, max(greatest(abs(a.value), abs(b.value))) AS sc, sum(abs(a.value - b.value)) AS d FROM s a JOIN s b ON a.channel = b.channel AND a."offset" = b."offset" AND a.event_id <> b.event_id WHERE a.event_id % 50 = 0 GROUP BY 1, 2, 3),
c AS (SELECT g.event_id, past_id, sum(shared / n * (1 - d / CASE WHEN sc = 0 THEN 1 ELSE sc END / 2 / shared)) AS total, count(*) AS channels FROM g JOIN n USING (event_id, channel) WHERE n >= 3 AND shared >= greatest(3, ceil(n / 2)) GROUP BY 1, 2),
z AS (SELECT event_id, past_id, round(total / width, 6) AS score, channels FROM c JOIN w USING (event_id))"""


@query(f"WITH {_WAVE} SELECT event_id, past_id, score, channels FROM z")
def waveform_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose id is divisible by 50 against all others."""
    s = series(spark, sf_dir)
    return rounded(R.waveform_scores(s.where("event_id % 50 = 0"), s))


@query(f"WITH {_WAVE} SELECT event_id, past_id, score, channels, CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, past_id) AS INTEGER) AS rank FROM z QUALIFY rank <= 8")
def waveform_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight events most like each, found by bounds on their scores."""
    s = series(spark, sf_dir)
    return waveforms.waveform_top_k(s.where("event_id % 50 = 0"), s, 8, ["k", "value"], 30)


@query(f"""WITH {_SERIES}, b AS (SELECT *, lag(value) OVER (PARTITION BY event_id, channel ORDER BY "offset") AS p FROM s)
SELECT event_id, channel, count(*) AS observed, arg_min(value, "offset") AS first, arg_max(value, "offset") AS last, min(value) AS low, max(value) AS high, count(*) FILTER (WHERE value <> p) AS change_count FROM b GROUP BY 1, 2""")
def observation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.observation_summary(series(spark, sf_dir)).drop("changes")


@query("SELECT source AS key, count(*) AS copies, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY 1")
def upsert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conflicting_upserts(table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "lang"), "key", ["lang"])


@query("""WITH e AS (SELECT gun, max(CASE WHEN code = 'error' THEN 1 ELSE 0 END) = 1 AS has_code, count(*) AS n, round(avg(value) / 100, 6) AS score FROM ev GROUP BY 1)
SELECT gun, CASE WHEN has_code AND gun % 2 = 0 THEN 'guidance' WHEN has_code THEN 'unsupported_code' WHEN score IS NULL THEN 'unseen' WHEN score < 0.5 THEN 'uncertain' ELSE 'seen' END AS route,
CASE WHEN n < 3 THEN 'insufficient' WHEN gun % 7 = 0 THEN 'pending' WHEN gun % 5 = 0 THEN 'counterexample' WHEN n > 70 THEN 'conflict' WHEN n > 60 THEN 'automatic' ELSE 'new_pattern' END AS status FROM e""")
def event_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readings(spark, sf_dir).groupBy("gun").agg(F.bool_or(F.col("code") == "error").alias("has_code"), F.count("*").alias("n"), F.round(F.avg("value") / 100, 6).alias("score"))
    eligible = F.when(F.col("n") > 70, 2).when(F.col("n") > 60, 1).otherwise(0)
    where = R.route(F.col("has_code"), F.expr("gun % 2 = 0"), F.col("score"), F.lit(False), 0.5)
    status = R.reuse_status(eligible, F.expr("int(gun % 7 = 0)"), F.expr("int(gun % 5 = 0)"), F.lit(2), F.col("n"))
    return e.select("gun", where.alias("route"), status.alias("status"))
