"""Evidence and validation on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text as X
from gaugeworks.operators import evidence as E


def test_hops(spark):
    edges = spark.createDataFrame([("e1", "w1", "HAS"), ("w1", "c1", "CASE"), ("e2", "w2", "HAS")], "source string, target string, type string")
    nodes = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "id string")
    first = E.hop(nodes, edges, "HAS")
    second = E.optional_hop(first.withColumnRenamed("end", "id"), edges, "CASE")
    assert {tuple(r) for r in first.collect()} == {("e1", "w1"), ("e2", "w2")}
    assert {tuple(r) for r in second.collect()} == {("w1", "c1"), ("w2", None)}


def test_reconciled(spark):
    pages = spark.createDataFrame([("d", 1, "a\nb"), ("d", 2, "c"), ("d", 3, "x"), ("d", 4, "y")], "doc_id string, page int, text string")
    blocks = spark.createDataFrame([("d", 1, 0, "i", "a"), ("d", 1, 1, "j", "b"), ("d", 2, 0, "k", "other"), ("d", 3, 0, "l", "x"), ("d", 3, 2, "m", "")], "doc_id string, page int, order int, block_id string, text string")
    assert {(r["page"], r["problem"]) for r in E.reconciled(blocks, pages).collect()} == {(2, "text differs"), (3, "order has gaps"), (4, "no blocks")}


def test_headings(spark):
    lines = ["1.2 Safety", "Read this.", "[Table 3]", "a | b", "2 Setup", "go"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, position int, line string")
    got = E.carried_headings(df, X.unit_kind(F.col("line"))).orderBy("position").collect()
    assert [r["section"] for r in got] == ["1.2 Safety"] * 4 + ["2 Setup"] * 2 and got[3]["table_title"] == "[Table 3]"


def test_quotes_and_references(spark):
    pages = spark.createDataFrame([("d", 1, "The pres-\nsure is  low here.")], "doc string, page int, text string")
    quotes = spark.createDataFrame([("r", "d", 1, "pressure is low"), ("s", "d", 1, "high"), ("t", "d", 2, "x")], "ref_id string, doc string, page int, quote string")
    assert {r["ref_id"]: r["found"] for r in E.quotes_in_source(quotes, pages).collect()} == {"r": True, "s": False, "t": False}
    chunks = spark.createDataFrame([("d", 1, "long", "the pressure is low and more"), ("d", 1, "short", "pressure is low")], "doc string, page int, chunk_id string, text string")
    assert {r["ref_id"]: r["chunk_id"] for r in E.resolved_references(quotes, chunks).collect()} == {"r": "short", "s": None, "t": None}


def test_citations(spark):
    answers = spark.createDataFrame([("a", ["k1", "k1", "k9"], [("d", 1), ("d", 7)]), ("b", ["k2"], [("d", 1)])], "answer_id string, check_ids array<string>, citations array<struct<doc:string,page:int>>")
    checks = spark.createDataFrame([("k1",), ("k2",)], "check_id string")
    pages = spark.createDataFrame([("d", 1)], "doc string, page int")
    assert {r["answer_id"]: r["problems"] for r in E.valid_citations(answers, checks, pages).collect()} == {"a": ["unknown:1", "repeated:1", "outside:1"], "b": []}


def test_eligible_and_conflicts(spark):
    events = spark.createDataFrame([("e", "A", 1, "p1", 100)], "event_id string, scope string, revision int, episode_id string, at int")
    history = spark.createDataFrame([("c1", "A", 1, "p2", 50, True), ("c2", "A", 1, "p1", 50, True), ("c3", "A", 1, "p3", 150, True), ("c4", "A", 2, "p4", 50, True), ("c5", "A", 1, "p5", 50, False)], "case_id string, scope string, revision int, episode_id string, closed_at int, confirmed boolean")
    assert [r["case_id"] for r in E.eligible(history, events).collect()] == ["c1"]
    scores = spark.createDataFrame([("e", "x", 1.0), ("e", "y", 1.0), ("f", "x", 1.0)], "event_id string, past_id string, score double")
    cases = spark.createDataFrame([("x", "c1"), ("y", "c2")], "event_id string, case_id string")
    assert {r["event_id"]: r["conflict"] for r in E.conflicts(scores, cases).collect()} == {"e": True, "f": False}


def test_bounded_context(spark):
    made = [("g", "c1", 1, 10, "resolved", "first"), ("g", "c1", 2, 5, "resolved", "second"), ("g", "c2", 3, 20, "resolved", None), ("g", "c3", 4, 99, "resolved", "later"), ("g", "c4", 5, 7, "open", "x"), ("g", None, 6, 7, "resolved", "x"), ("g", "c5", 7, None, "resolved", "x"), ("g", "c6", 8, 1, "resolved", "old")]
    df = spark.createDataFrame(made, "gun string, case_id string, position int, closed_at int, outcome string, note string")
    got = E.bounded_context(df, 50, ["gun"], ["resolved", "false_alarm"], 2, 3).orderBy("case_id").collect()
    assert [(r["case_id"], r["note"]) for r in got] == [("c1", "sec"), ("c2", "")]
    assert E.bounded_context(df.where("false"), 50, ["gun"], ["resolved"]).count() == 0


def test_questions(spark):
    pages = spark.createDataFrame([("p", "d", 1, "the pres-\nsure is  too low")], "pack_id string, doc string, page int, text string")
    q = spark.createDataFrame([("a", "p", "E012", "what of E012", "x"), ("b", "p", "E012", None, "x"), ("c", "p", None, "E016 there", "x"), ("e", "p", None, "short", "x"), ("f", "p", None, "no quote", "x"), ("g", "p", None, "other", " ")], "question_id string, pack_id string, code string, question string, reference string")
    quotes = spark.createDataFrame([(i, "d", 1, "pressure is too low") for i in "abcg"] + [("e", "d", 1, "too low"), ("a", "d", 1, "the pressure is")], "question_id string, doc string, page int, quote string")
    want = {"a": [], "b": ["code not named"], "c": ["a code named"], "e": ["quote not on its page"], "f": ["no reference or source"], "g": ["no reference or source"]}
    assert {r["question_id"]: r["problems"] for r in E.valid_questions(q, quotes, pages).collect()} == want


def test_version_guard(spark):
    df = spark.createDataFrame([("v1",)], "version string")
    assert E.same_version(df, F.col("version"), "v1").count() == 1
    with pytest.raises(Exception, match="another version"):
        E.same_version(df, F.col("version"), "v2").collect()


def test_text_functions(spark):
    df = spark.createDataFrame([("Wear of the 캡 and E012 or E999", "E1234 E028")], "a string, b string")
    r = df.select(X.query_terms(F.col("a")).alias("t"), X.error_code(F.col("a"), ["E012"]).alias("c"), X.error_code(F.col("b"), ["E012"]).alias("d"), X.row_text(F.array(F.lit("h"), F.lit("g")), F.array(F.lit("v"), F.lit(" "))).alias("r"), X.letters_only(F.col("b")).alias("l")).first()
    assert r["t"] == ["wear", "of", "e012", "e999", "cap", "caps"] and r["c"] == "E012" and r["d"] == "E028" and r["r"] == "h: v" and r["l"] == "e1234e028"


def test_small_helpers(spark):
    docs = spark.createDataFrame([(["m"],), (["m", "n"],)], "docs array<string>")
    assert [r[0] for r in docs.select(E.scope(F.col("docs"), {"A": ["m"]})).collect()] == ["A", None]
    turns = spark.createDataFrame([("c", i, "x" * 20) for i in range(12)], "conv_id string, turn int, text string")
    got = E.recent_turns(turns, 3, 5).collect()
    assert sorted(r["turn"] for r in got) == [9, 10, 11] and {r["text"] for r in got} == {"xxxxx"}
    rows = spark.createDataFrame([("g", 1, "warning"), ("g", 2, "critical"), ("g", 3, "normal")], "gun string, t int, severity string")
    assert E.latest_focus(rows).first()["t"] == 2
    seen = spark.createDataFrame([("e", "c1", 1.0, 2.0, 1), ("e", "c2", 1.0, 1.0, 0), ("e", "c19", 1.0, 2.0, 1)], "event_id string, channel string, first double, last double, change_count int")
    assert E.search_text(seen, {"c1": "pressure", "c2": "flow", "c19": "x"}, ["c19"]).first()["query"] == "pressure transition increase\nflow constant"
    claims = spark.createDataFrame([(1, "e", "c", 0, 5), (2, "e", "c", 0, 6)], "claim_id int, event_id string, channel string, start int, end int")
    series = spark.createDataFrame([("e", "c", 0), ("e", "c", 5)], "event_id string, channel string, offset int")
    assert {r["claim_id"]: r["valid"] for r in E.endpoints_observed(claims, series).collect()} == {1: True, 2: False}
    parts = spark.createDataFrame([("a", [(1, "x")]), ("b", [(1, "y"), (2, "z")])], "id string, parts array<struct<page:int,text:string>>")
    assert {r["id"] for r in E.by_page(parts).collect()} == {"a", "b:p1", "b:p2"}
