"""Repeated passages against brute force, and the corpus pipeline stage by stage."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from words import prose

import corpus_pipeline as pipeline
from gaugeworks.llm import substring



def rows_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def covered(found):
    out = {}
    for r in found:
        out.setdefault(r["doc_id"], set()).update(range(r["passage_start"], r["passage_end"]))
    return out


def brute(texts, n=50):
    """Words of exact runs of n words that a document of a smaller number has too."""
    first, need = {}, {}
    for i, t in enumerate(texts):
        w = substring.words_of(t)
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            if first.setdefault(g, i) != i:
                need.setdefault(i, set()).update(range(j, j + n))
    return need


def test_passages_in_unrelated_documents(spark):
    shared = [prose(900 + i, 60) for i in range(3)]
    texts = [prose(i, 150) + " " + shared[i % 3] + " " + prose(500 + i, 120) for i in range(9)] + [prose(50, 400), prose(51, 30)]
    found = substring.repeated_passages(rows_of(spark, texts)).collect()
    got, need = covered(found), brute(texts)
    assert set(got) == set(need) == {3, 4, 5, 6, 7, 8}
    assert all(need[i] <= got[i] and len(got[i] - need[i]) <= 4 for i in need)
    assert {0, 1, 2} <= {r["partner_id"] for r in found} <= set(range(8))


def test_fuzzy_passage_with_an_edit_and_an_insertion(spark):
    a = prose(1, 120).split()
    b = a[:40] + ["changed"] + a[41:70] + ["put", "in"] + a[70:]
    texts = [prose(2, 80) + " " + " ".join(a), " ".join(b) + " " + prose(3, 80)]
    found = substring.repeated_passages(rows_of(spark, texts)).collect()
    got = covered(found)[1]
    assert set(range(122)) <= got and len(got) <= 126
    assert max(r["equal_words"] for r in found) >= 115


def test_short_repeats_are_left_alone(spark):
    line = prose(7, 30)
    texts = [prose(i, 100) + " " + line + " " + prose(100 + i, 100) for i in range(6)]
    assert substring.repeated_passages(rows_of(spark, texts)).count() == 0


def test_hot_passage_makes_rows_in_proportion(spark):
    line = prose(8, 70)
    texts = [prose(i, 40) + " " + line for i in range(300)]
    found = substring.repeated_passages(rows_of(spark, texts))
    assert found.select("doc_id").distinct().count() == 299 and found.count() <= 2 * 299


def test_smallest_scale(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts)
    need = brute([texts[i] for i in order])
    got = covered(substring.repeated_passages(docs).collect())
    total = sum(map(len, need.values()))
    missed = sum(len(v - got.get(order[i], set())) for i, v in need.items())
    assert missed <= 0.005 * total


def test_odd(odd, empty):
    found = substring.repeated_passages(odd)
    ids = {r["doc_id"] for r in found.collect()}
    assert 12 in ids and 15 in ids and 13 in ids and not ids & {1, 2, 3, 4, 5, 11, 14, 16, None}
    assert substring.repeated_passages(empty).count() == 0
    left = substring.without_passages(odd, found)
    assert left.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert 12 not in texts and texts[2] is None and texts[1] == "" and texts[13] == prose(13, 120)
    assert left.where("doc_id is null").count() == 1 and left.where("doc_id = 16").count() == 2


def test_without_keeps_other_white_space():
    assert substring._without("a  b\nc d\te", [(1, 3)]) == "a d\te"
    assert substring._without("a b c", [(0, 3)]) == ""
    assert substring._without("é ü x", [(0, 1), (2, 9)]) == " ü"


def test_chain_by_brute_force():
    """The best chain's score equals that of the best of all chains of few matches."""
    rng = random.Random(5)

    def score(c):
        s = float(substring.K)
        for (p, a), (q, b) in zip(c, c[1:], strict=False):
            s += min(substring.K, q - p, b - a) - substring.SHIFT * abs((q - p) - (b - a)) - substring.GAP * ((q - p) + (b - a))
        return s

    for _ in range(40):
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(7)})
        along = [(p, p + 3) for p in range(0, 30, 5)]
        assert substring.chain([p for p, _ in along], [a for _, a in along]) == [along]
        chains = substring.chain([p for p, _ in points], [a for _, a in points])
        assert sorted(x for c in chains for x in c) == points
        assert all(p < q and a < b for c in chains for (p, a), (q, b) in zip(c, c[1:], strict=False))
        assert all(score(c) >= substring.K for c in chains if len(c) == 2)


def test_seeds_of_shared_runs_meet():
    run = prose(4, substring.K + substring.WINDOW - 1)
    for i in range(20):
        a, b = prose(100 + i, 37) + " " + run, run + " " + prose(200 + i, 51)
        assert set(substring.seeds(a)[0].tolist()) & set(substring.seeds(b)[0].tolist())


def test_one_word_over_and_over_gives_few_seeds():
    h, at = substring.seeds("word " * 5000)
    assert len(set(h.tolist())) == 1 and len(at) < 5000 / (substring.WINDOW // 2) + 2
    assert np.all(np.diff(at) >= substring.WINDOW // 2)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage of the pipeline gives over planted documents, and the input of each."""
    from pyspark.sql import Row

    sf = str(tmp_path_factory.mktemp("planted"))
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = base.agg(F.max("doc_id")).first()[0] + 1
    long = prose(77, 400)
    planted = [
        Row(doc_id=n, text=long), Row(doc_id=n + 1, text=long), Row(doc_id=n + 2, text=long + " more"),
        Row(doc_id=n + 3, text=prose(78, 200) + " password=hunter22secret end"), Row(doc_id=n + 4, text=prose(79, 150) + " " + prose(78, 90)),
    ]
    extra = spark.createDataFrame(planted).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    base.unionByName(extra).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").join(base.select("doc_id"), "doc_id").write.parquet(f"{sf}/labels.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, f) in enumerate(pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"{sf}/out{i}")
        made = spark.read.parquet(f"{sf}/out{i}")
        out.append((name, docs, made))
        docs = made
    return sf, n, out


def test_stages(spark, stages):
    sf, n, out = stages
    names = [x for x, *_ in out]
    assert len(names) == 5 and all(made.columns == docs.columns for _, docs, made in out[:-1])
    kept = [{r["doc_id"]: r["text"] for r in made.select("doc_id", "text").collect()} for _, _, made in out[:-1]]
    assert n in kept[1] and n + 1 not in kept[1]
    before, after = kept[1], kept[2]
    assert after[n + 4] == prose(79, 150) and after[n + 3] == before[n + 3]
    assert "[assign]" in kept[3][n + 3] and "hunter22" not in kept[3][n + 3]
    secret = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    assert not any(secret.search(t) for t in kept[3].values())
    pieces = out[4][2]
    per = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert per.where("n <> m").count() == 0 and per.count() == len(kept[3])


def test_run_gives_the_last_stage(spark, stages):
    sf, _, out = stages
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def counted(df):
        return Counter(tuple(r) for r in df.select(*columns).withColumn("ids", F.hex("ids")).collect())

    assert counted(pipeline.run(spark, sf)) == counted(out[4][2])


@pytest.mark.parametrize("sizes", [(40, 40), (45, 45), (30, 30), (30, 30, 30), (25, 25, 25, 25), (45, 20)])
def test_passages_whose_parts_were_first_seen_apart(spark, sizes):
    """Earlier documents hold the parts, two later ones the whole, and a third whole comes after them: none is lost."""
    rows, whole = [], []
    for n in range(40):
        words = prose(31_000 + 97 * n + len(sizes) * 7 + sizes[0], sum(sizes)).split()
        base, at = 10 * n, 0
        for i, size in enumerate(sizes):
            rows.append((base + i, f"{prose(base + i + 50_000, 40)} {' '.join(words[at : at + size])} {prose(base + i + 60_000, 40)}"))
            at += size
        for i in (7, 8, 9):
            rows.append((base + i, f"{prose(base + i + 70_000, 45)} {' '.join(words)} {prose(base + i + 80_000, 45)}"))
        whole.append((base, sum(sizes)))
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "passage_start", "passage_end").distinct().collect()
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["passage_start"], r["passage_end"]))
    for base, size in whole:
        for i in (8, 9):
            assert sum(min(e, 45 + size) - max(s, 45) for s, e in spans.get(base + i, [])) >= min(size, 50), (base, i, spans.get(base + i))
    # the first whole has no partner that holds 50 words of it, unless a part does
    assert not any(base + 7 in spans for base, _ in whole)


def test_passages_by_brute_force(spark):
    """Documents made of fragments of a few sources: every document that shares a run of 50 words with one before it has a passage there."""
    rng = np.random.default_rng(17)
    sources = [prose(90_000 + i, 160).split() for i in range(6)]
    rows = []
    for d in range(70):
        words = prose(91_000 + d, 20).split()
        for _ in range(int(rng.integers(1, 4))):
            source = sources[rng.integers(0, 6)]
            size = int(rng.choice([20, 30, 45, 80, 120]))
            at = int(rng.integers(0, 160 - size))
            words += source[at : at + size] + prose(int(rng.integers(1, 10**6)), 15).split()
        rows.append((d, " ".join(words)))
    split = [t.split() for _, t in rows]
    runs = [{tuple(w[i : i + 50]): i for i in range(len(w) - 49)} for w in split]
    want = {d: {i for r, i in runs[d].items() if any(r in runs[e] for e in range(d))} for d in range(70)}
    found = {}
    for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["passage_start"], r["passage_end"]))
    lost = [(d, i) for d, at in want.items() for i in at if len(found.get(d, set()) & set(range(i, i + 50))) < 45]
    total = sum(map(len, want.values()))
    assert total > 500 and len(lost) <= 0.01 * total, (len(lost), total)
