"""Search and evidence: BM25, vectors, rank fusion, neighbours, budgets, waveforms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gaugeworks.operators.blocks import searched
from gaugeworks.operators.staging import staged


def word_counts(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, length): each distinct lower-case word of a text, and the text's number of words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(id_col, words.alias("_w")).select(id_col, F.size("_w").alias("length"), F.explode("_w").alias("term"))
    return rows.groupBy(id_col, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, terms: DataFrame, text: Column, id_col: str = "doc_id", query: str = "query_id", k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(query_id, id, score) of every document that has a term of a query (K9); terms has (query_id, term).

    Words are filtered to the queries' terms before anything is counted, so the shuffle carries matches
    and not the corpus.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sized = docs.select(id_col, words.alias("_w")).select(id_col, F.size("_w").alias("length"), "_w")
    whole = sized.agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))
    wanted = terms.select("term").distinct()
    hits = sized.select(id_col, "length", F.explode("_w").alias("term")).join(wanted, "term", "left_semi")
    tf = hits.groupBy(id_col, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(df, "term").crossJoin(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = rows.select(id_col, "term", weight.alias("_w")).join(terms.select(query, "term").distinct(), "term")
    return scored.groupBy(query, id_col).agg(F.round(F.sum("_w"), digits).alias("score"))


#: Wanted terms up to which they are broadcast; beyond it words meet them in a shuffled join.
BROADCAST_TERMS = 1_000_000
#: Pairs of document and term that one task scores against one block of queries.
TASK_HITS = 1_000_000


def keyword_hits(docs: DataFrame, terms: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, length, term, tf), written once: the words of each text that ``terms`` has, and one row of term "" for each text.

    Every text is read and split once; words are filtered before the first shuffle. The length of a null
    text is null.
    """
    wanted = terms.select("term").distinct().union(docs.sparkSession.createDataFrame([("",)], "term string"))
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = docs.select(F.col(id_col).cast("long").alias(id_col), words.alias("_w"))
    rows = split.select(id_col, F.size("_w").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("_w", F.array().cast("array<string>")))).alias("term"))
    kept = rows.join(wanted, "term", "left_semi")
    return staged(kept.groupBy(id_col, "length", "term").agg(F.count("*").alias("tf")), "hits")


def keyword_top_k(docs: DataFrame, terms: DataFrame, text: Column, k: int, id_col: str = "doc_id", k1: float = 1.2, b: float = 0.75, digits: int = 6, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query by BM25.

    The same scores as ``bm25``, but pairs of query and document exist only inside a task: it scores one
    range of documents against one block of queries and keeps the k best of each query. Ranges are made
    by a hash of the ids, as many as the hits need; blocks are dealt out by a hash of the queries' ids.
    Only three numbers come to the driver. Null ids and null texts have no results.
    """
    hits = keyword_hits(docs.where(F.col(id_col).isNotNull()), terms, text, id_col)
    sizes = hits.where("term = ''").agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
    found = hits.where("term <> ''")
    asked = terms.select(F.col("query_id").cast("long").alias("query_id"), "term").where("query_id is not null and term <> ''").distinct()
    df = found.groupBy("term").agg(F.count("*").alias("_df"))
    ranges, blocks = (max(1, -(-x // n)) for x, n in ((found.count(), TASK_HITS), (asked.select("query_id").distinct().count(), block)))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    idf = F.log(1 + (sizes["docs"] - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    queries = asked.join(df, "term").select(F.explode(number(ranges)).alias("_range"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block"), "query_id", "term", idf.alias("idf"))
    own = k1 * (1 - b + b * F.col("length") / (sizes["mean"] or 1.0))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + own)
    dealt = found.select(F.pmod(F.xxhash64(id_col), F.lit(ranges)).cast("int").alias("_range"), F.explode(number(blocks)).alias("_block"), F.col(id_col).alias("doc"), "term", gain.alias("gain"))
    schema = pa.schema([("query_id", pa.int64()), (id_col, pa.int64()), ("score", pa.float64())])

    def score(own: pa.Table, asked: pa.Table) -> pa.Table:
        return _scored(own, asked, k, digits, schema)

    best = dealt.groupBy("_range", "_block").cogroup(queries.groupBy("_range", "_block")).applyInArrow(score, f"query_id long, {id_col} long, score double")
    return top_k(best, k, "query_id", id_col)


def _scored(hits: pa.Table, asked: pa.Table, k: int, digits: int, schema: pa.Schema) -> pa.Table:
    """The k best documents of each query of a block among those of a range."""
    if not (hits.num_rows and asked.num_rows):
        return schema.empty_table()
    query, q = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
    doc, d = np.unique(hits["doc"].to_numpy(), return_inverse=True)
    terms, t = np.unique(np.array(asked["term"].to_pylist()), return_inverse=True)
    # queries of a term lie next to each other: from ``start`` on, ``size`` of them
    order = np.argsort(t, kind="stable")
    q, idf = q[order], asked["idf"].to_numpy()[order]
    size = np.bincount(t, minlength=len(terms))
    start = np.cumsum(size) - size
    # Arrow finds a hit's term: a NumPy array of texts pads each to the longest
    of = pc.index_in(hits["term"], value_set=pa.array(terms.tolist(), hits["term"].type))
    known = of.is_valid().to_numpy()
    d, gain, of = d[known], hits["gain"].to_numpy()[known], of.fill_null(0).to_numpy()[known]
    order = np.argsort(d, kind="stable")
    d, gain, of = d[order], gain[order], of[order]
    best = np.zeros((len(query), 0))
    best_doc = np.zeros((len(query), 0), np.int64)
    step = max(1, 4_000_000 // len(query))  # documents at a time: bounds the table of scores
    for low in range(0, len(doc), step):
        s, e = np.searchsorted(d, [low, low + step])
        times = size[of[s:e]]
        hit = np.repeat(np.arange(s, e), times)
        at = start[of[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)
        width = min(step, len(doc) - low)
        scores = np.bincount(q[at] * width + d[hit] - low, idf[at] * gain[hit], len(query) * width).reshape(len(query), width)
        best = np.concatenate((best, np.round(scores, digits)), axis=1)
        best_doc = np.concatenate((best_doc, np.broadcast_to(doc[low : low + width], scores.shape)), axis=1)
        top = np.lexsort((best_doc, -best), axis=1)[:, :k]
        best, best_doc = np.take_along_axis(best, top, 1), np.take_along_axis(best_doc, top, 1)
    keep = (best > 0).ravel()
    columns = [np.repeat(query, best.shape[1])[keep], best_doc.ravel()[keep], best.ravel()[keep]]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)


#: Is no key of a row, null included.
_NO_KEY = object()

#: Words of the seed by which a whole passage is looked for.
SEED_WORDS = 5


def holders(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id", block: int = 100_000, span: int = 20_000) -> DataFrame:
    """(item_id, id): documents whose text holds an item's text whole, as it stands.

    An item's first words but one, which are whole words wherever it stands, seed the search; documents
    that have the seed are compared with the item itself. Candidates are written once, so that texts are
    shuffled only if these are too many to be sent to them. Items of too few words for a seed are looked for
    by one automaton for each block of them, in time in proportion to a text's length and its hits; an
    empty item is in every document, a null one or one in a null text nowhere.
    """
    own = items.select(F.col(item_col).alias("item_id"), F.col(text).alias("_item"), F.size(F.split(text, r"\s+")).alias("_n")).where("_item is not null")
    whole = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("_text")).where("_text is not null")
    seeded = _seeded(own.where(F.col("_n") >= SEED_WORDS + 2), "_item", ["item_id", "_item"], inner=True)
    hit = staged(_seeded(whole, "_text", [id_col]).join(seeded, "_seed").select(id_col, "item_id", "_item").distinct(), "candidates")
    found = hit.join(whole, id_col).where(F.contains("_text", F.col("_item"))).select("item_id", id_col)
    short = own.where(F.col("_n") < SEED_WORDS + 2).select(F.col("item_id").alias("_item_id"), "_item")
    if short.isEmpty():
        return found.distinct()
    texts = whole.withColumnRenamed(id_col, "_doc_id")
    kinds = [StructField("item_id", short.schema["_item_id"].dataType), StructField(id_col, texts.schema["_doc_id"].dataType)]

    def search(asked: pa.Table, known: pa.Table) -> pa.Table:
        of: dict[str, list] = {}
        for item, found in zip(asked["_item_id"].to_pylist(), asked["_item"].to_pylist()):
            of.setdefault(found, []).append(item)
        everywhere = of.pop("", [])
        automaton = ahocorasick.Automaton()
        for found in of:
            automaton.add_word(found, found)
        automaton.make_automaton()
        hits = []
        for of_doc, body in zip(known["_doc_id"].to_pylist(), known["_text"].to_pylist()):
            seen = {found for _, found in automaton.iter(body)} if of else set()
            hits += [(item, of_doc) for found in seen for item in of[found]] + [(item, of_doc) for item in everywhere]
        return pa.table([pa.array([h[i] for h in hits], known["_doc_id"].type if i else asked["_item_id"].type) for i in (0, 1)], names=["item_id", id_col])

    rest = searched(short, texts, search, StructType(kinds), "_item_id", "_doc_id", block, span)
    return found.unionByName(rest).distinct()


def _seeded(df: DataFrame, text: str, kept: Sequence[str], inner: bool = False) -> DataFrame:
    """(kept, _seed): hashes of every ``SEED_WORDS`` words of a text that stand together, or of the first within it."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.large_string())
            for row, seed in _word_seeds(texts, inner):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in kept], pa.array(seed)], names=[*kept, "_seed"])

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(seeds, StructType([*[df.schema[c] for c in kept], StructField("_seed", LongType())]))


#: Bytes of text whose words are hashed at once; a longer text is taken whole.
SEED_BYTES = 4_000_000
#: Java's white space, by which words are split.
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
#: Keeps a word's own bytes of the eight from its first on.
_OWN_BYTES = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)


def _word_seeds(texts: pa.LargeStringArray, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, seeds) of non-null texts, some rows at a time; ``inner``: of each text the first after a blank.

    A word counts by its length and its first and last eight bytes, so longer ones may have equal seeds.
    """
    n, mix = SEED_WORDS, np.uint64(0x9E3779B97F4A7C15)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SEED_BYTES, "right")) - 1)
        begin = bounds[low : high + 1]
        size = int(begin[-1] - begin[0])
        raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(begin[0])) if size else np.zeros(0, np.uint8)
        begin, low, at = begin - begin[0], high, low
        edge = np.zeros(size + 1, bool)
        edge[begin] = True
        blank = _BLANK[raw]
        after, before = edge[:-1].copy(), edge[1:].copy()
        after[1:] |= blank[:-1]
        before[:-1] |= blank[1:]
        first, end = np.flatnonzero(~blank & after), np.flatnonzero(~blank & before) + 1
        if len(first) < n:
            continue
        padded = np.concatenate((np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)))
        eight = np.ndarray(size + 9, "<u8", padded, strides=(1,))
        length = end - first
        word = (eight[first + 8] & _OWN_BYTES[np.minimum(length, 8)]) * mix
        word ^= word >> np.uint64(29)
        word += np.where(length > 8, eight[end], 0) + length.astype(np.uint64)
        word *= mix
        word ^= word >> np.uint64(32)
        seed = np.zeros(len(word) - n + 1, np.uint64)
        for i in range(n):
            seed = seed * mix + word[i : len(seed) + i]
        row = np.searchsorted(begin, first, "right") - 1
        within = row[: len(seed)] == row[n - 1 :]
        if inner:
            within &= first[: len(seed)] > begin[row[: len(seed)]]
        row, seed = row[: len(seed)][within], seed[within].view(np.int64)
        if inner:
            row, one = np.unique(row, return_index=True)
            seed = seed[one]
        yield row + at, seed


def top_k(scores: DataFrame, k: int, query: str = "query_id", id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query, with rank; equal scores by id."""
    w = Window.partitionBy(query).orderBy(F.desc(score), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_top_k(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block: int = 8192, digits: int = 6, id_col: str = "vec_id", vector: str = "embedding", span: int = 65536) -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows of each query by cosine, ``least`` or more.

    ``queries`` has an id and a vector. Blocks of queries meet ranges of rows inside tasks
    (``blocks.searched``), each of which gives the k best of its range. Vectors that are null, hold nulls or
    have no length have no results.
    """
    names = queries.columns
    schema = pa.schema([("query_id", pa.int64()), (id_col, pa.int64()), ("score", pa.float64())])
    whole = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull())
    asked = queries.where(whole(names[1])).select(F.col(names[0]).cast("long").alias("query_id"), F.col(names[1]).cast("array<double>").alias("_v"))
    known = rows.where(whole(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("_v"))

    def unit(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        x = t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        size = np.linalg.norm(x, axis=1)
        return t[name].to_numpy()[size > 0], x[size > 0] / size[size > 0][:, None]

    def search(own: pa.Table, near: pa.Table) -> pa.Table:
        if not (own.num_rows and near.num_rows):
            return schema.empty_table()
        (query, q), (ids, x) = unit(own, "query_id"), unit(near, "id")
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out = []
        for at in range(0, len(query), 512):
            part = q[at : at + 512]
            best_id, best = np.zeros((len(part), 0), np.int64), np.zeros((len(part), 0))
            for low in range(0, len(ids), 8192):
                best = np.concatenate((best, np.round(part @ x[low : low + 8192].T, digits)), axis=1)
                best_id = np.concatenate((best_id, np.broadcast_to(ids[low : low + 8192], (len(part), len(ids[low : low + 8192])))), axis=1)
                # ids ascend, so equal scores keep the order of their ids
                top = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, best_id = np.take_along_axis(best, top, 1), np.take_along_axis(best_id, top, 1)
            keep = (best >= least).ravel()
            out.append(pa.Table.from_arrays([pa.array(np.repeat(query[at : at + 512], best.shape[1])[keep]), pa.array(best_id.ravel()[keep]), pa.array(best.ravel()[keep])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = searched(asked, known, search, f"query_id long, {id_col} long, score double", "query_id", "id", block, span)
    return top_k(found, k, "query_id", id_col)


def fused_ranks(branches: Sequence[DataFrame], limit: int, k: int = 60, query: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of ranked branches (query, id, rank): score, rank."""
    first = [b.groupBy(query, id_col).agg(F.min("rank").alias("rank")) for b in branches]
    rows = first[0].withColumn("_branch", F.lit(0))
    for i, b in enumerate(first[1:], 1):
        rows = rows.unionByName(b.withColumn("_branch", F.lit(i)))
    again = F.row_number().over(Window.partitionBy(query, "_branch").orderBy("rank", id_col))
    scores = rows.withColumn("_r", again).groupBy(query, id_col).agg(F.round(F.sum(1 / (k + F.col("_r"))), 9).alias("score"))
    return top_k(scores, limit, query, id_col)


def neighbours(seeds: DataFrame, chunks: DataFrame, hops: int = 2, most: int = 3, usable: Column | None = None) -> DataFrame:
    """(query_id, seed, chunk_id, distance): chunks of a seed's document and section close to it.

    ``seeds`` has (query_id, chunk_id), ``chunks`` (chunk_id, doc, section, chunk_index). An equi-join on
    each possible index, so a long document's chunks are never compared with each other.
    """
    c = chunks.where(usable) if usable is not None else chunks
    s = seeds.join(chunks, "chunk_id").select("query_id", F.col("chunk_id").alias("seed"), "doc", "section", F.col("chunk_index").alias("_at"))
    offsets = F.array(*[F.lit(d) for d in range(-hops, hops + 1) if d])
    s = s.withColumn("_d", F.explode(offsets)).withColumn("chunk_index", F.col("_at") + F.col("_d"))
    found = s.join(c.select("chunk_id", "doc", "section", "chunk_index"), ["doc", "section", "chunk_index"])
    w = Window.partitionBy("query_id", "seed").orderBy(F.abs("_d"), "chunk_id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("query_id", "seed", "chunk_id", F.abs("_d").alias("distance"))


def within_budget(ranked: DataFrame, budget: int, size: str = "size", required: str = "required", query: str = "query_id", order: str = "rank") -> DataFrame:
    """(query_id, rank): walks each ranked list, skips what overflows the budget; required rows always stay.

    Lists are sorted by the shuffle and walked as they stream by: a task holds one batch and the sum so far.
    A null size counts as 0 for a required row and never fits otherwise; a null flag is false.
    """
    rows = ranked.select(query, order, F.col(size).cast("long").alias("_size"), F.coalesce(F.col(required), F.lit(False)).alias("_must"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = _NO_KEY, 0
        for b in batches:
            kept = []
            for key, n, must in zip(b.column(0).to_pylist(), b.column("_size").to_pylist(), b.column("_must").to_pylist()):
                if key != last:
                    last, used = key, 0
                fits = must or (n is not None and used + n <= budget)
                used += (n or 0) if fits else 0
                kept.append(fits)
            yield b.select([query, order]).filter(pa.array(kept, pa.bool_()))

    return rows.repartition(query).sortWithinPartitions(query, order, "_size", "_must").mapInArrow(walk, rows.select(query, order).schema)


def packed_chunks(units: DataFrame, most: int, doc: str = "doc_id", order: str = "position", group: str = "group_key", size: str = "size") -> DataFrame:
    """Adds chunk: units of a document in order; a new one begins where the group changes or the text would exceed ``most`` (K6).

    Texts of a chunk are joined by one character. A unit larger than ``most`` is a chunk of its own, as it
    is never split; a null size is 0. One shuffle sorts the units, which are numbered as they stream by: a
    task holds one batch and where the last chunk stands.
    """
    schema = StructType([*units.schema.fields, StructField("chunk", LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of, used, number = _NO_KEY, None, 0, -1
        for b in batches:
            numbers = []
            for key, kind, n in zip(*(b.column(c).to_pylist() for c in (doc, group, size))):
                n = n or 0
                if key != last:
                    last, of, used, number = key, None, 0, -1
                if number < 0 or kind != of or used + 1 + n > most:
                    of, used, number = kind, n, number + 1
                else:
                    used += 1 + n
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=[*b.schema.names, "chunk"])

    return units.repartition(doc).sortWithinPartitions(doc, order, group, size).mapInArrow(walk, schema)


def retrieval_metrics(results: DataFrame, gold: DataFrame, k: int, query: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """(recall, mrr, precision) at k over the queries of ``gold`` (query_id, id)."""
    top = results.where(F.col("rank") <= k)
    hit = gold.distinct().join(top.select(query, id_col, "rank"), [query, id_col], "left")
    size = top.groupBy(query).agg(F.count("*").alias("_size"))
    per = hit.groupBy(query).agg(F.count("*").alias("n"), F.count("rank").alias("got"), F.min("rank").alias("first")).join(size, query, "left")
    return per.agg(F.avg(F.col("got") / F.col("n")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(F.col("got") / F.col("_size"), F.lit(0.0))).alias("precision"))


def directions(series: DataFrame, length: int, binary: Sequence[str] = ()) -> DataFrame:
    """(event_id, channel, direction): medians of the last third of offsets against the first.

    ``series`` has (event_id, channel, offset 0..length-1, value). A third with fewer than half its
    offsets observed gives none; binary channels move only between 0 and 1.
    """
    third = length // 3
    first = F.when(F.col("offset") < third, F.col("value"))
    last = F.when(F.col("offset") >= length - third, F.col("value"))
    m = series.groupBy("event_id", "channel").agg(F.percentile(first, F.lit(0.5)).alias("a"), F.percentile(last, F.lit(0.5)).alias("b"), F.count(first).alias("na"), F.count(last).alias("nb"))
    seen = (F.col("na") * 2 >= third) & (F.col("nb") * 2 >= third)
    clean = ~F.col("channel").isin(*binary) | (F.col("a").isin(0, 1) & F.col("b").isin(0, 1)) if binary else F.lit(True)
    move = F.when(F.col("b") > F.col("a"), "up").when(F.col("b") < F.col("a"), "down")
    return m.select("event_id", "channel", F.when(seen & clean, move).alias("direction"))


def pattern_keys(found: DataFrame, channels: int = 3, version: str = "direction-v1") -> DataFrame:
    """(event_id, pattern_key): channels in order of their names, if exactly ``channels`` have a direction."""
    pairs = F.sort_array(F.collect_list(F.when(F.col("direction").isNotNull(), F.concat_ws(":", "channel", "direction"))))
    rows = found.groupBy("event_id").agg(pairs.alias("_p"))
    return rows.select("event_id", F.when(F.size("_p") == channels, F.concat(F.lit(f"{version}:"), F.array_join("_p", "|"))).alias("pattern_key"))


def waveform_scores(current: DataFrame, history: DataFrame, binary: Sequence[str] = (), least: int = 3) -> DataFrame:
    """(event_id, past_id, score, channels): aligned likeness of current events to past ones.

    Both have (event_id, channel, offset, value). A channel needs ``least`` offsets observed, and shared
    with the past at least max(least, half of them); its distance is the share of differing values if
    binary, else the mean of |x/s - y/s| / 2 with s the greatest magnitude or 1. Score: coverage times
    likeness, summed over channels and divided by the number of the event's channels.
    """
    size = current.groupBy("event_id", "channel").agg(F.count("*").alias("n"))
    width = size.groupBy("event_id").agg(F.count("*").alias("width"))
    past = history.select(F.col("event_id").alias("past_id"), "channel", "offset", F.col("value").alias("past"))
    pairs = current.join(past, ["channel", "offset"]).where("event_id <> past_id")
    scale = F.max(F.greatest(F.abs("value"), F.abs("past")))
    g = pairs.groupBy("event_id", "past_id", "channel").agg(F.count("*").alias("shared"), scale.alias("_s"), F.sum(F.abs(F.col("value") - F.col("past"))).alias("_d"), F.avg((F.col("value") != F.col("past")).cast("double")).alias("_m"))
    scale = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    numeric = F.col("_d") / scale / 2 / F.col("shared")
    distance = F.when(F.col("channel").isin(*binary), F.col("_m")).otherwise(numeric) if binary else numeric
    g = g.join(size, ["event_id", "channel"]).where((F.col("n") >= least) & (F.col("shared") >= F.greatest(F.lit(least), F.ceil(F.col("n") / 2))))
    part = (F.col("shared") / F.col("n")) * (1 - distance)
    out = g.groupBy("event_id", "past_id").agg(F.sum(part).alias("_sum"), F.count("*").alias("channels")).join(width, "event_id")
    return out.select("event_id", "past_id", (F.col("_sum") / F.col("width")).alias("score"), "channels")


def observation_summary(series: DataFrame) -> DataFrame:
    """(event_id, channel): observed, first, last, low, high, change_count, and the first three changes."""
    w = Window.partitionBy("event_id", "channel").orderBy("offset")
    before = F.lag(F.struct("offset", "value")).over(w)
    rows = series.withColumn("_b", before).withColumn("_change", F.when(F.col("value") != F.col("_b.value"), F.struct(F.col("offset").alias("after"), F.col("_b.value").alias("was"), F.col("value").alias("became"))))
    return rows.groupBy("event_id", "channel").agg(
        F.count("*").alias("observed"),
        F.min_by("value", "offset").alias("first"),
        F.max_by("value", "offset").alias("last"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("_change").alias("change_count"),
        F.slice(F.sort_array(F.collect_list("_change")), 1, 3).alias("changes"),
    )


def route(has_code: Column, supported: Column, score: Column, conflict: Column, least: float = 0.8) -> Column:
    """Where an event goes: by its code, else by its likeness to confirmed history."""
    return F.when(has_code & supported, "guidance").when(has_code, "unsupported_code").when(score.isNull(), "unseen").when(conflict | (score < least), "uncertain").otherwise("seen")


def reuse_status(eligible: Column, pending: Column, counter: Column, cases: Column, channels: Column) -> Column:
    """Whether a pattern's past action may be used again."""
    return (
        F.when(channels < 3, "insufficient").when(pending > 0, "pending").when(counter > 0, "counterexample").when(eligible > 1, "conflict")
        .when((eligible == 1) & (cases >= 2), "automatic").when(eligible == 1, "candidates").otherwise("new_pattern")
    )


def continued(rows: DataFrame, doc: str = "doc_id", page: str = "page", headers: str = "headers", edge: str = "left_edge", most: float = 18.0) -> DataFrame:
    """Adds continues: a table goes on from the page before: next page, same headers, aligned within ``most`` (K3)."""
    w = Window.partitionBy(doc).orderBy(page)
    aligned = F.abs(F.col(edge) - F.lag(edge).over(w)) < most
    on = (F.col(page) == F.lag(page).over(w) + 1) & F.col(headers).eqNullSafe(F.lag(headers).over(w)) & aligned
    return rows.withColumn("continues", F.coalesce(on, F.lit(False)))


def conflicting_upserts(rows: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """(key, copies, conflict): whether rows of one key carry different payloads."""
    return rows.groupBy(key).agg(F.count("*").alias("copies"), (F.count_distinct(F.hash(*payload), F.xxhash64(*payload)) > 1).alias("conflict"))
