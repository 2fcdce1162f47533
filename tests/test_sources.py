"""Scans and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import readers as R
from gaugeworks.sources import writers as W


def test_readings_csv(spark, tmp_path):
    names = ["time", *[f"c{i}" for i in range(1, 20)], "error"]
    row = ["2021-09-01T00:00:00Z", *["1.5"] * 9, "on", *["2"] * 9, "E012"]
    (tmp_path / "gun_1.csv").write_text(",".join(names) + "\n" + ",".join(row) + "\n" + ",".join([*row[:10], "off", *row[11:]]) + "\n")
    got = R.readings_csv(spark, str(tmp_path), ["time", "c10", "c11", "error"]).orderBy("c10").collect()
    assert [r["c10"] for r in got] == [0.0, 1.0] and got[0]["error"] == "E012" and str(got[0]["time"]) == "2021-09-01 00:00:00"


def test_on_off_refuses(spark):
    with pytest.raises(Exception, match="not on or off"):
        spark.createDataFrame([("maybe",)], "c string").select(R.on_off(F.col("c"))).collect()


def test_manifest_and_tags(spark, tmp_path):
    for n in ("a", "b"):
        spark.range(2).write.parquet(f"{tmp_path}/in/{n}.parquet")
    rows = R.tagged(spark.read.parquet(f"{tmp_path}/in/a.parquet", f"{tmp_path}/in/b.parquet"))
    assert rows.count() == 4
    manifest = spark.createDataFrame([("a", "E01", None), ("b", "E02", "short")], "file string, class string, dropped string")
    assert [r["file"] for r in R.kept_files(manifest).collect()] == ["a"]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "file string, x int")
    assert [(r["x"], r["class"]) for r in R.of_kept(rows, manifest).collect()] == [(1, "E01")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n{"n": 2}\n\n{"id": "b", "n": 3}\n')
    good, bad = R.json_lines(spark, str(tmp_path / "x.jsonl"), "id string, n int", ["id"])
    assert sorted((r["id"], r["n"]) for r in good.collect()) == [("a", 1), ("b", 3)]
    assert sorted(r["error"] for r in bad.collect()) == ["missing id", "not JSON of this schema"]


def test_json_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a"}))
    (tmp_path / "b.json").write_text('{"id": ')
    assert [r["id"] for r in R.json_folder(spark, str(tmp_path), "id string").collect()] == ["a"]


def test_append_and_integrity(spark):
    known = spark.createDataFrame([("a",)], "file string")
    new = spark.createDataFrame([("a", True, True), ("b", True, True), ("c", False, True), ("d", True, False), ("b", True, True)], "file string, is_failure boolean, readable boolean")
    added, skipped = R.appended(known, new)
    assert [r["file"] for r in added.collect()] == ["b"]
    assert {r["file"]: r["reason"] for r in skipped.collect()} == {"c": "no failure", "d": "unreadable"}
    a = spark.createDataFrame([("m", "x", 3), ("n", "y", 4), ("o", "z", 5)], "id string, sha256 string, pages int")
    b = spark.createDataFrame([("m", "x", 3), ("n", "q", 4), ("p", "z", 5)], "id string, sha256 string, pages int")
    assert {r["id"]: r["problem"] for r in R.integrity(a, b).collect()} == {"n": "changed", "o": "missing", "p": "not listed"}


def test_graph_backup(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "rag"), (2, "rag"), (3, "other")], "id int, label string")
    edges = spark.createDataFrame([(1, 2, "next")], "source int, target int, type string")
    counts = W.backup_graph(nodes, edges, str(tmp_path / "g"))
    assert counts == {"nodes": 3, "edges": 1}
    own, inside = W.restore_graph(spark, str(tmp_path / "g"), "rag", counts)
    assert own.count() == 2 and inside.count() == 1
    W.backup_graph(nodes, edges.unionByName(spark.createDataFrame([(2, 3, "x")], edges.schema)), str(tmp_path / "h"))
    with pytest.raises(ValueError, match="leads out"):
        W.restore_graph(spark, str(tmp_path / "h"), "rag")


def test_incremental_index(spark):
    chunks = spark.createDataFrame([("a", "x", [1.0], "m1"), ("b", "yy", None, None), ("c", "zzz", [2.0], "m0")], "chunk_id string, text string, embedding array<float>, model string")
    asked = []

    def embed(rows):
        asked.extend(r["chunk_id"] for r in rows.collect())
        return rows.select("chunk_id", F.array(F.length("text").cast("float")).alias("embedding"))

    got = {r["chunk_id"]: (r["embedding"], r["model"]) for r in W.indexed(chunks, embed, "m1").collect()}
    assert sorted(asked) == ["b", "c"] and got == {"a": ([1.0], "m1"), "b": ([2.0], "m1"), "c": ([3.0], "m1")}
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in W.upserted(table, rows, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
