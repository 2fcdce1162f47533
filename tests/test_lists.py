"""Streamed folds, items in documents and the latest eligible cases, against plain loops."""

import random

from gaugeworks.operators import evidence as E
from gaugeworks.operators import retrieval as R


def test_budget_and_chunks_against_loops(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.choice([None, 0, 1, 30, 90, 200]), rng.choice([True, False, False, None]), rng.choice(["a", "b", None]), "é" * 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "query_id int, rank int, size int, required boolean, group_key string, extra string").repartition(7)
    kept, chunk, state = [], {}, {}
    for q, r, n, must, g, _ in sorted(rows, key=lambda x: x[1]):
        used = state.get(q, 0)
        if must or (n is not None and used + n <= 2000):
            state[q] = used + (n or 0)
            kept.append((q, r))
    assert sorted(map(repr, map(tuple, R.within_budget(df, 2000).collect()))) == sorted(map(repr, kept))
    state = {}
    for q, r, n, _, g, _ in sorted(rows, key=lambda x: x[1]):
        n = n or 0
        number, of, used = state.get(q, (-1, None, 0))
        state[q] = (number + 1, g, n) if number < 0 or g != of or used + 1 + n > 100 else (number, g, used + 1 + n)
        chunk[q, r] = state[q][0]
    found = R.packed_chunks(df, 100, "query_id", "rank").collect()
    assert {(r["query_id"], r["rank"]): r["chunk"] for r in found} == chunk and len(found) == 3000 and found[0]["extra"] == "ééé"
    assert R.within_budget(df.limit(0), 5).count() == R.packed_chunks(df.limit(0), 5, "query_id", "rank").count() == 0


def test_holders_against_loops(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "")]
    items = []
    for i in range(80):
        body = rng.choice(docs[:60])[1]
        at = rng.randint(0, max(0, len(body) - 1))
        items.append((i, body[at : at + rng.randint(1, 50)]))
    items += [(90, ""), (91, None), (92, "not there at all"), (93, items[0][1])]
    want = {(i, d) for i, t in items for d, body in docs if t is not None and body is not None and t in body}
    frames = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    for block, span in ((100_000, 20_000), (16, 9)):
        assert {tuple(r) for r in R.holders(*frames, block=block, span=span).collect()} == want
    assert R.holders(frames[0].limit(0), frames[1]).count() == R.holders(frames[0], frames[1].limit(0)).count() == 0


def test_latest_eligible_against_loops(spark):
    rng = random.Random(6)
    one = lambda: (rng.choice(["A", "A", "A", "B", None]), rng.choice([1, 1, 2]), rng.choice(["p", "p", "p", "q", "r", None]), rng.choice([None, *range(40)]))
    history = [(f"c{i}", *one(), rng.random() < 0.8) for i in range(400)]
    history.append(history[0])
    events = [(i, *one()) for i in range(150)]
    want = set()
    for e, scope, revision, episode, at in events:
        fit = {(closed, c) for c, s, r, p, closed, ok in history if ok and scope is not None and s == scope and r == revision and p != episode and closed is not None and at is not None and closed <= at}
        want |= {(e, c, i) for i, (_, c) in enumerate(sorted(fit, reverse=True)[:4], 1)}
    h = spark.createDataFrame(history, "case_id string, scope string, revision int, episode_id string, closed_at int, confirmed boolean")
    ev = spark.createDataFrame(events, "event_id int, scope string, revision int, episode_id string, at int")
    found = [tuple(r) for r in E.latest_eligible(h, ev, 4).collect()]
    assert len(found) == len(want) and set(found) == want
    assert E.latest_eligible(h.limit(0), ev, 4).count() == E.latest_eligible(h, ev.limit(0), 4).count() == 0
