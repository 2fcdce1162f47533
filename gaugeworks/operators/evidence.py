"""Documents, evidence and validation around search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from gaugeworks.functions.text import collapsed
from gaugeworks.operators.staging import staged


def hop(nodes: DataFrame, edges: DataFrame, kind: str, node: str = "id") -> DataFrame:
    """(start, end) of the edges of one kind that leave ``nodes``; follow it by another for more hops."""
    e = edges.where(F.col("type") == kind).select(F.col("source").alias(node), F.col("target").alias("end"))
    return nodes.select(node).distinct().join(e, node).select(F.col(node).alias("start"), "end")


def optional_hop(nodes: DataFrame, edges: DataFrame, kind: str, node: str = "id") -> DataFrame:
    """The same, with a null end for nodes that no such edge leaves."""
    return nodes.select(F.col(node).alias("start")).distinct().join(hop(nodes, edges, kind, node), "start", "left")


def reconciled(blocks: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, page, problem): pages whose blocks are not in order, not unique, or don't make up the page's text (K4)."""
    b = blocks.groupBy(doc, page).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n").alias("_made"),
        F.count("*").alias("_n"),
        F.count_distinct("block_id").alias("_ids"),
        (F.max("order") - F.min("order") + 1 == F.count("*")).alias("_whole"),
        F.count_distinct("order").alias("_orders"),
    )
    j = pages.select(doc, page, F.col("text").alias("_text")).join(b, [doc, page], "left")
    problem = (
        F.when(F.col("_n").isNull(), "no blocks").when(F.col("_ids") < F.col("_n"), "an id repeats")
        .when(~F.col("_whole") | (F.col("_orders") < F.col("_n")), "order has gaps").when(collapsed(F.col("_made")) != collapsed(F.col("_text")), "text differs")
    )
    return j.select(doc, page, problem.alias("problem")).where("problem is not null")


def carried_headings(lines: DataFrame, kind: Column, doc: str = "doc_id", order: str = "position", line: str = "line", reset: Column | None = None) -> DataFrame:
    """Adds section and table_title: the last heading of either kind before a line, until ``reset`` holds."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = lines.withColumn("_kind", kind).withColumn("_reset", F.sum((reset if reset is not None else F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    block = Window.partitionBy(doc, "_reset").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(F.when(F.col("_kind") == k, F.col(line)), ignorenulls=True).over(block)
    return rows.withColumn("section", last("section")).withColumn("table_title", last("table_marker")).drop("_kind", "_reset")


def by_page(rows: DataFrame, parts: str = "parts", id_col: str = "id") -> DataFrame:
    """One piece of evidence for each page of a row's parts (array of (page, text)); one page keeps the id."""
    p = rows.select(id_col, F.explode(parts).alias("_p")).groupBy(id_col, F.col("_p.page").alias("page")).agg(F.sort_array(F.collect_list("_p.text")).alias("_t"))
    n = F.count("*").over(Window.partitionBy(id_col))
    return p.withColumn("_n", n).select(F.when(F.col("_n") == 1, F.col(id_col)).otherwise(F.concat(id_col, F.lit(":p"), "page")).alias(id_col), "page", F.array_join("_t", "\n").alias("text"))


def complete_evidence(codes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(code, chunk_id, position): all mapped chunks of exact codes, by document, page and id."""
    found = hop(codes, edges, "RELEVANT_EVIDENCE", "code").withColumnRenamed("start", "code").withColumnRenamed("end", "chunk_id")
    rows = found.join(chunks.select("chunk_id", "doc", "page"), "chunk_id")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("code").orderBy("doc", "page", "chunk_id"))).select("code", "chunk_id", "position")


def same_version(df: DataFrame, version: Column, expected: str) -> DataFrame:
    """``df``, or an error where a row's version is another."""
    return df.where(F.when(version.eqNullSafe(F.lit(expected)), True).otherwise(F.raise_error(F.lit("the index is of another version")).cast("boolean")))


def eligible(history: DataFrame, events: DataFrame, on: str = "scope") -> DataFrame:
    """Confirmed cases of an event's scope and revision, of another episode, closed by then."""
    e = events.select("event_id", on, "revision", F.col("episode_id").alias("_episode"), F.col("at").alias("_at"))
    ok = (F.col("confirmed")) & ~F.col("episode_id").eqNullSafe(F.col("_episode")) & (F.col("closed_at") <= F.col("_at"))
    return e.join(history, [on, "revision"]).where(ok).drop("_episode", "_at")


def latest_eligible(history: DataFrame, events: DataFrame, k: int, on: str = "scope") -> DataFrame:
    """(event_id, case_id, place): the ``k`` eligible cases of each event that were closed last, the latest first.

    Of cases closed at once the greater case_id is later. Cases and events of a class are sorted by time
    together, in ranges that split a class of any size, and each range is walked once: an event looks back
    from the last case before it and jumps over a run of cases of its own episode, so no event meets more
    than 2 * k cases. Events near a range's beginning that miss some look on in what the ranges before have
    left: of each range the few last cases that can still be among anyone's k last. Rows without scope,
    revision or time are never eligible; null episodes are the same one, and a case given twice counts once.
    """
    of = [on, "revision"]
    known = F.col(on).isNotNull() & F.col("revision").isNotNull()
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    cases = history.where(F.col("confirmed") & known & F.col("closed_at").isNotNull()).select(*of, F.col("closed_at").alias("at"), F.lit(0).alias("_kind"), "case_id", "episode_id", null(events, "event_id"))
    asked = events.where(known & F.col("at").isNotNull()).select(*of, "at", F.lit(1).alias("_kind"), null(history, "case_id"), "episode_id", "event_id")
    rows = cases.unionByName(asked)
    order = [*of, "at", "_kind", "case_id", "episode_id", "event_id"]
    kinds = {f.name: f for f in rows.schema}
    schema = StructType([StructField("_what", StringType()), StructField("_range", IntegerType()), *[StructField(c, kinds[c].dataType) for c in (*of, "event_id", "case_id", "episode_id")], StructField("place", IntegerType())])
    walked = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _walked(batches, of, k), schema)
    # written once: events and what ranges leave must be of the same ranges
    walked = staged(walked, "latest")
    before = StructType([f for f in schema if f.name in ("_range", "case_id", "episode_id", "place")])
    left = walked.where("_what in ('range', 'last')").groupBy(*of).applyInArrow(lambda t: _before(t, k), before)
    left = left.groupBy("_range").agg(F.sort_array(F.collect_list(F.struct("place", "case_id", "episode_id")), asc=False).alias("_before"))
    short = walked.where("_what = 'short'").select("_range", "event_id", F.col("episode_id").alias("_episode"), F.col("place").alias("_place"))
    more = F.filter("_before", lambda x: ~x["episode_id"].eqNullSafe(F.col("_episode")))
    short = short.join(left, "_range").select("event_id", "_place", F.posexplode(F.slice(more, F.lit(1), k - F.col("_place"))).alias("_at", "_case"))
    found = walked.where("_what = 'found'").select("event_id", "case_id", "place")
    return found.unionByName(short.select("event_id", F.col("_case.case_id").alias("case_id"), (F.col("_place") + F.col("_at") + 1).alias("place")))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value of a column, null included: equal numbers, equal values."""
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the run of equal rows that a row lies in begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _last_cases(episode: np.ndarray, k: int) -> np.ndarray:
    """Places of the cases that can be among the k last of other episodes: k of each of the last 2 * k runs.

    Of two runs side by side one at least is of another episode than an event's own.
    """
    if not len(episode):
        return np.zeros(0, np.int64)
    start = _runs(episode)
    first = np.unique(start)
    run = np.searchsorted(first, start)
    end = np.append(first[1:], len(episode))[run]
    return np.flatnonzero((end - np.arange(len(episode)) <= k) & (run >= len(first) - 2 * k))


def _walked(batches: Iterator[pa.RecordBatch], of: Sequence[str], k: int) -> Iterator[pa.RecordBatch]:
    """A range's found pairs, its first class and that class's events that lack some, and its last class's last cases."""
    at = TaskContext.get().partitionId()

    def told(what: str, rows: pa.Table, place: np.ndarray) -> list[pa.RecordBatch]:
        ids = {c: rows[c] if c in rows.column_names else pa.nulls(len(rows), kinds.field(c).type) for c in (*of, "event_id", "case_id", "episode_id")}
        told = {"_what": pa.repeat(what, len(rows)), "_range": pa.repeat(pa.scalar(at, pa.int32()), len(rows)), **ids, "place": pa.array(place, pa.int32())}
        return pa.table(told).combine_chunks().to_batches()

    first = kept = kinds = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if first is None:
            first, kept, kinds = rows.select(of).slice(0, 1), rows.slice(0, 0), rows.schema
            yield from told("range", first, np.zeros(1))
        rows = pa.concat_tables([kept, rows])
        group = _runs(*[_codes(rows[c]) for c in of])
        episode, is_case = _codes(rows["episode_id"]), rows["_kind"].to_numpy() == 0
        # a case given twice stands beside itself
        is_case &= _runs(group, episode, is_case, *[_codes(rows[c]) for c in ("at", "case_id")]) == np.arange(len(rows))
        case, event = np.flatnonzero(is_case), np.flatnonzero(rows["_kind"].to_numpy() == 1)
        # the last place, which -1 means too, is no case
        of_class, own = np.append(group[case], -1), np.append(episode[case], -1)
        other = np.append(_runs(of_class[:-1], own[:-1]) - 1, -1) if len(case) else np.array([-1])
        place, n = np.cumsum(is_case)[event] - 1, np.zeros(len(event), np.int64)
        for _ in range(k):
            place = np.where(own[place] == episode[event], other[place], place)
            hit = of_class[place] == group[event]
            n += hit
            if hit.any():
                yield from told("found", pa.table({"event_id": rows["event_id"].take(event[hit]), "case_id": rows["case_id"].take(case[place[hit]])}), n[hit])
            place = np.where(hit, place - 1, -1)
        if rows.slice(int(group[0]), 1).select(of) == first:
            lacking = (n < k) & (group[event] == group[0])
            yield from told("short", rows.take(event[lacking]).select([*of, "event_id", "episode_id"]), n[lacking])
        last = case[group[case] == group[-1]]
        kept = rows.take(last[_last_cases(episode[last], k)])
    if kept is not None:
        yield from told("last", kept, np.arange(len(kept)))


def _before(rows: pa.Table, k: int) -> pa.Table:
    """A class's last cases before each range that begins in it, numbered from the oldest."""
    rows = rows.sort_by([("_range", "ascending"), ("place", "ascending")])
    number, begins = rows["_range"].to_numpy(), np.array(rows["_what"].to_pylist()) == "range"
    kept, out = rows.slice(0, 0), []
    for n in np.unique(number):
        if begins[number == n].any() and len(kept):
            out.append(pa.table({"_range": pa.repeat(pa.scalar(int(n), pa.int32()), len(kept)), "case_id": kept["case_id"], "episode_id": kept["episode_id"], "place": pa.array(np.arange(len(kept)), pa.int32())}))
        kept = pa.concat_tables([kept, rows.take(np.flatnonzero((number == n) & ~begins))])
        kept = kept.take(_last_cases(_codes(kept["episode_id"]), k))
    return pa.concat_tables(out) if out else rows.slice(0, 0).select(["_range", "case_id", "episode_id", "place"])


def conflicts(scores: DataFrame, cases: DataFrame, same: float = 1.0) -> DataFrame:
    """(event_id, conflict): whether past events with identical samples point to different cases."""
    hit = scores.where(F.col("score") >= same).join(cases.select(F.col("event_id").alias("past_id"), "case_id"), "past_id")
    return hit.groupBy("event_id").agg((F.count_distinct("case_id") > 1).alias("conflict"))


def endpoints_observed(claims: DataFrame, series: DataFrame) -> DataFrame:
    """Claims (claim_id, event_id, channel, start, end) with valid: both ends were observed."""
    seen = series.select("event_id", "channel", "offset").distinct()
    j = claims.join(seen.withColumnRenamed("offset", "start").withColumn("_s", F.lit(True)), ["event_id", "channel", "start"], "left")
    j = j.join(seen.withColumnRenamed("offset", "end").withColumn("_e", F.lit(True)), ["event_id", "channel", "end"], "left")
    return j.withColumn("valid", F.coalesce(F.col("_s") & F.col("_e"), F.lit(False))).drop("_s", "_e")


def quotes_in_source(quotes: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """Quotes (ref_id, doc, page, quote) with found: on their page, and no more than ``most`` of a reference."""
    n = F.count("*").over(Window.partitionBy("ref_id"))
    j = quotes.withColumn("_n", n).join(pages.select("doc", "page", F.col("text").alias("_text")), ["doc", "page"], "left")
    inside = F.contains(collapsed(F.col("_text")), collapsed(F.col("quote"))) & (F.trim("quote") != "")
    return j.withColumn("found", F.coalesce(inside, F.lit(False)) & (F.col("_n") <= most)).drop("_n", "_text")


def resolved_references(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ref_id, doc, page, chunk_id): the shortest chunk of a quote's page that contains it, else null."""
    c = chunks.select("doc", "page", "chunk_id", F.col("text").alias("_text"))
    j = quotes.join(c, ["doc", "page"], "left")
    fits = F.contains(collapsed(F.col("_text")), collapsed(F.col("quote")))
    best = F.min(F.when(fits, F.struct(F.length("_text").alias("n"), F.col("chunk_id"))))
    return j.groupBy("ref_id", "doc", "page").agg(best.alias("_b")).select("ref_id", "doc", "page", F.col("_b.chunk_id").alias("chunk_id"))


def scope(docs: Column, scopes: dict[str, Sequence[str]]) -> Column:
    """The scope whose documents are exactly those of a set, or null."""
    out = F.lit(None).cast("string")
    for name, members in scopes.items():
        out = F.when(F.sort_array(F.array_distinct(docs)) == F.array(*[F.lit(m) for m in sorted(members)]), name).otherwise(out)
    return out


def valid_citations(answers: DataFrame, checks: DataFrame, pages: DataFrame) -> DataFrame:
    """(answer_id, problems): unknown checks, repeated checks and pages that are no evidence.

    ``answers`` has arrays check_ids and citations of (doc, page).
    """
    c = answers.select("answer_id", F.explode_outer("check_ids").alias("check_id"))
    known = checks.select("check_id").distinct().withColumn("_k", F.lit(True))
    a = c.join(known, "check_id", "left").groupBy("answer_id").agg(F.count_if(F.col("check_id").isNotNull() & F.col("_k").isNull()).alias("unknown"), (F.count("check_id") - F.count_distinct("check_id")).alias("repeated"))
    p = answers.select("answer_id", F.explode("citations").alias("_c")).select("answer_id", "_c.doc", "_c.page")
    b = p.join(pages.select("doc", "page").distinct(), ["doc", "page"], "left_anti").groupBy("answer_id").agg(F.count("*").alias("outside"))
    j = a.join(b, "answer_id", "left").fillna(0, ["outside"])
    named = [F.when(F.col(n) > 0, F.concat_ws(":", F.lit(n), F.col(n))) for n in ("unknown", "repeated", "outside")]
    return j.select("answer_id", F.array_compact(F.array(*named)).alias("problems"))


def parse_audit(found: DataFrame, golden: DataFrame) -> DataFrame:
    """(doc, recall, exact): golden lines that parsed pages hold, letters only, and those held as a line."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    pages = found.select("doc", "page", norm(F.col("text")).alias("_p"), F.transform(F.split("text", "\n"), norm).alias("_lines"))
    j = golden.join(pages, ["doc", "page"], "left")
    g = norm(F.col("line"))
    return j.groupBy("doc").agg(F.avg(F.coalesce(F.contains("_p", g), F.lit(False)).cast("double")).alias("recall"), F.avg(F.coalesce(F.array_contains("_lines", g), F.lit(False)).cast("double")).alias("exact"))


def search_text(observed: DataFrame, names: dict[str, str], left_out: Sequence[str] = ()) -> DataFrame:
    """(event_id, query): name, transition or constant, and increase or decrease, of each known channel."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    name = F.try_element_at(table, F.col("channel"))
    change = F.when(F.col("change_count") > 0, "transition").otherwise("constant")
    way = F.when(F.col("first") < F.col("last"), "increase").when(F.col("first") > F.col("last"), "decrease")
    rows = observed.where(~F.col("channel").isin(*left_out)) if left_out else observed
    lines = rows.withColumn("_line", F.concat_ws(" ", name, change, way)).where(name.isNotNull())
    return lines.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("channel", "_line"))).alias("_l")).select("event_id", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("query"))


def observed_code(explicit: Column, trigger: Column) -> Column:
    """The explicit code if it has the form of one, else the trigger's."""
    form = r"^E\d{3}$"
    return F.coalesce(F.when(explicit.rlike(form), explicit), F.when(trigger.rlike(form), trigger))


def recent_turns(turns: DataFrame, most: int = 8, chars: int = 1500, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last turns of a conversation, each cut to so many characters."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    rows = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return rows.withColumn("text", F.left(F.col("text"), F.lit(chars)))


def bounded_context(records: DataFrame, now: int, keys: Sequence[str], outcomes: Sequence[str], most: int = 5, chars: int = 1200, case: str = "case_id", order: str = "position") -> DataFrame:
    """Each key's newest past records, at most ``most``: of one case the last counts, notes are cut.

    Records (keys, case_id, position, closed_at, outcome, note) with a null case or time, a time after
    ``now`` or another outcome are left out before. A null note is empty.
    """
    ok = F.col(case).isNotNull() & (F.col("closed_at") <= now) & F.col("outcome").isin(*outcomes)
    last = Window.partitionBy(*keys, case).orderBy(F.desc(order))
    newest = Window.partitionBy(*keys).orderBy(F.desc("closed_at"), F.desc(case))
    rows = records.where(ok).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")
    return rows.withColumn("note", F.left(F.coalesce("note", F.lit("")), F.lit(chars)))


def valid_questions(questions: DataFrame, quotes: DataFrame, pages: DataFrame, least: int = 12, code: str = r"E\d{3}") -> DataFrame:
    """(question_id, problems) of a question set (X49): (question_id, pack_id, code, question, reference).

    A question of a code's pack names the code, any other names none; it has a reference and at least one
    quote (question_id, doc, page, quote), each of ``least`` characters or more and on a page of its pack
    (pack_id, doc, page, text).
    """
    p = pages.select("pack_id", "doc", "page", collapsed(F.col("text")).alias("_text"))
    own = quotes.join(questions.select("question_id", "pack_id"), "question_id")
    inside = (F.length(F.trim("quote")) >= least) & F.contains(F.col("_text"), collapsed(F.col("quote")))
    held = own.join(p, ["pack_id", "doc", "page"], "left").groupBy("question_id").agg(F.bool_and(F.coalesce(inside, F.lit(False))).alias("_held"))
    j = questions.join(held, "question_id", "left")
    text = F.coalesce("question", F.lit(""))
    problems = F.array_compact(F.array(
        F.when(F.col("_held").isNull() | (F.trim(F.coalesce("reference", F.lit(""))) == ""), F.lit("no reference or source")),
        F.when(F.col("code").isNotNull() & ~F.contains(text, F.col("code")), F.lit("code not named")),
        F.when(F.col("code").isNull() & text.rlike(code), F.lit("a code named")),
        F.when(~F.col("_held"), F.lit("quote not on its page")),
    ))
    return j.select("question_id", problems.alias("problems"))


def warning_block(runs: DataFrame, minute: int) -> DataFrame:
    """Adds active_min of an early warning's run: started minutes, the first one included."""
    return runs.withColumn("active_min", F.floor((F.col("end_t") - F.col("start_t")) / minute) + 1)


def latest_focus(rows: DataFrame, key: str = "gun", time: str = "t") -> DataFrame:
    """(key, ...): the last row that is not normal."""
    names = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*names), F.when(F.col("severity") != "normal", F.col(time)))
    return rows.where(F.col("severity") != "normal").groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def replay_check(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds ok: status among those acceptable, and the chosen id among those applicable or none."""
    j = expected.join(actual, "event_id", "left")
    status = F.array_contains("acceptable", F.col("status"))
    chosen = F.col("chosen_id").isNull() | F.array_contains("applicable", F.col("chosen_id"))
    return j.withColumn("ok", F.coalesce(status & chosen, F.lit(False)))


def current_sources(rows: DataFrame, manifest: DataFrame, refs: str = "refs", id_col: str = "id") -> DataFrame:
    """(id, current): whether every reference of a row has a listed document's hash and a page it has."""
    r = rows.select(id_col, F.explode_outer(refs).alias("_r")).select(id_col, "_r.doc", F.col("_r.sha256").alias("_sha"), F.col("_r.page").alias("_page"))
    j = r.join(manifest.select("doc", "sha256", "pages"), "doc", "left")
    ok = F.col("_sha").eqNullSafe(F.col("sha256")) & F.col("_page").between(1, F.col("pages"))
    return j.groupBy(id_col).agg(F.bool_and(F.coalesce(ok, F.lit(False)) | F.col("doc").isNull()).alias("current"))
