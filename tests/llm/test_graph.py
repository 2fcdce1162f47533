"""Components against a plain union-find."""

import random

import pytest

from gaugeworks.llm.graph import components


def brute(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {x: root(x) for x in up}


RNG = random.Random(1)
CASES = [
    [(i, i + 1) for i in range(60)],
    [(i + 1, i) for i in range(60)] + [(200, 100), (100, 300)],
    [(0, i) for i in range(1, 50)],
    [(RNG.randrange(200), RNG.randrange(200)) for _ in range(150)],
    [(-5, 3), (3, -9), (7, 7), (None, 1), (2, None), (-9, -5), (-5, 3)],
    [],
]


@pytest.mark.parametrize("links", CASES)
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in components(df).collect()} == brute(links)
