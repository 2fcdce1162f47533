"""The pipeline's near-duplicate stage finds what pigeonring chains find besides what word sets find; slices are dealt out once."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gaugeworks.llm import simhash, substring  # noqa: E402


def _words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_stage_keeps_one_of_what_either_method_links(spark, sf_dir):
    """1 and 2 are near by SimHash only (a sentence repeated), 2 and 3 by shingle sets only; one document stays."""
    said = " ".join([_words("said", 8)] * 60)
    texts = {1: f"{said} {_words('a', 12)}", 2: f"{said} {_words('b', 60)}", 3: f"{_words('said', 8)} {_words('said', 8)} {_words('b', 60)}", 4: _words("other", 40)}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    by_sets = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    by_chains = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert by_sets == {1: 1, 2: 2, 3: 2, 4: 4} and by_chains == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == {1, 4}


def test_slices_of_words_are_not_dealt_out_again(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x y z")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (2, 0, 3), (1, 0, 4)], "doc_id long, from long, to long")
    got = substring._slices(docs, asked)
    assert sorted((r["doc_id"], r["from"], r["to"], len(r["words"])) for r in got.collect()) == [(1, 0, 4, 16), (1, 2, 6, 16), (2, 0, 3, 12)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join") and "Aggregate" not in plan[: plan.index("MapInArrow")]
