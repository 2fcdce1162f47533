"""The latest eligible cases over many ranges, long runs of one episode and one table written."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import evidence as E
from gaugeworks.operators import stats

CASES, EVENTS = "case_id long, scope string, revision int, episode_id string, closed_at int, confirmed boolean", "event_id long, scope string, revision int, episode_id string, at int"


@pytest.fixture
def many_ranges(spark):
    held = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def tables(spark, seed):
    rng = random.Random(seed)
    # a run of one episode that fills several ranges, null episodes too, and events of its own at its end
    episode = lambda t: rng.choice(["p", "q", "r", None]) if t < 60 or t > 340 else None if t < 200 else "q"
    one = lambda t: ("A" if rng.random() < 0.8 else "B", 1, episode(t), t)
    history = [(i, *one(rng.randrange(400)), rng.random() < 0.9) for i in range(500)]
    events = [(i, *one(rng.randrange(400))) for i in range(500)] + [(1000 + i, "C", 1, "p", i) for i in range(40)]
    return history, events, spark.createDataFrame(history, CASES), spark.createDataFrame(events, EVENTS)


@pytest.mark.parametrize("seed", range(3))
def test_runs_over_several_ranges(spark, many_ranges, seed):
    history, events, h, e = tables(spark, seed)
    want = set()
    for event, scope, revision, episode, at in events:
        fit = sorted(((closed, c) for c, s, r, p, closed, ok in history if ok and (s, r) == (scope, revision) and p != episode and closed <= at), reverse=True)
        want |= {(event, c, i) for i, (_, c) in enumerate(fit[:4], 1)}
    found = [tuple(r) for r in E.latest_eligible(h, e, 4).collect()]
    assert len(found) == len(want) and set(found) == want


def test_rows_are_sorted_once(spark, monkeypatch):
    written = []
    for module in (E, stats):
        monkeypatch.setattr(module, "staged", lambda df, name, f=module.staged: written.append(name) or f(df, name))
    _, _, h, e = tables(spark, 0)
    E.latest_eligible(h.repartition(3), e.withColumn("event_id", F.col("event_id")), 5).count()
    assert len(written) == 1
