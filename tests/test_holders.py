"""Items in documents: seeds of words against a loop, and texts that are neither shuffled nor sent on."""

import random

import pyarrow as pa

from gaugeworks.operators import retrieval as R


def test_seeds_against_a_loop(monkeypatch):
    monkeypatch.setattr(R, "SEED_BYTES", 40)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aé한") for _ in range(rng.choice([1, 1, 2, 7, 9])))
    texts = ["", " ", "a b c d", *["".join(word() + rng.choice([" ", "\n", " \t ", "\x0b"]) for _ in range(rng.randint(0, 12))) for _ in range(60)], "\u00a0a b c d e f"]
    texts += [" " + t for t in texts]
    of, seen = {}, []
    array = pa.array(["left out", *texts], pa.large_string()).slice(1)
    for rows, seeds in R._word_seeds(array, False):
        seen += zip(rows.tolist(), seeds.tolist())
    places = [(i, tuple(w[j : j + 5])) for i, t in enumerate(texts) for w in [t.replace("\x0b", " ").translate({9: 32, 10: 32}).split(" ")] for w in [[x for x in w if x]] for j in range(len(w) - 4)]
    assert [i for i, _ in seen] == [i for i, _ in places]
    for (_, seed), (_, words) in zip(seen, places):
        assert of.setdefault(words, seed) == seed
    assert len(set(of.values())) == len(of)
    inner = {i: s for rows, seeds in R._word_seeds(array, True) for i, s in zip(rows.tolist(), seeds.tolist())}
    for i, t in enumerate(texts):
        of_text = [s for j, s in seen if j == i][0 if t[:1].isspace() and t[:1] != "\u00a0" else 1 :]
        assert inner.get(i) == (of_text[0] if of_text else None)


def test_long_words_are_compared(spark):
    docs = spark.createDataFrame([(1, "x aaaaaaaaaaaa1bbbbbbbbbb c d e f g h"), (2, "x aaaaaaaaaaaa2bbbbbbbbbb c d e f g h"), (None, "x aaaaaaaaaaaa1bbbbbbbbbb c d e f g h"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "x aaaaaaaaaaaa1bbbbbbbbbb c d e f g"), ("j", "x  aaaaaaaaaaaa1bbbbbbbbbb c d e f g")], "item_id string, text string")
    assert [tuple(r) for r in R.holders(docs, items).collect()] == [("i", 1)]


def test_texts_stay_where_they_are(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "concat('one two three four five six seven ', id, ' eight') as text")
    items = spark.createDataFrame([(1, "two three four five six seven 7 ei"), (2, "two three four five six seven 70 ei")], "item_id long, text string")
    found = R.holders(docs, items)
    assert [tuple(r) for r in found.collect()] == [(1, 7)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
