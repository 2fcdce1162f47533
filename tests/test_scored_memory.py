"""Scoring a range of documents against a block of queries doesn't pad its hits' terms to the longest."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gaugeworks.operators import retrieval as R

SCHEMA = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def test_one_long_term_costs_no_memory():
    n, terms = 100_000, [f"t{i}" for i in range(50)]
    rng = np.random.default_rng(0)
    term = [terms[i] for i in rng.integers(0, 50, n)]
    term[0], term[1] = "x" * 2000, "unknown"
    hits = pa.table({"doc": rng.integers(0, 3000, n), "term": term, "gain": rng.uniform(1, 2, n)})
    asked = pa.table({"query_id": np.arange(50) // 5, "term": terms, "idf": np.ones(50)})
    tracemalloc.start()
    got = R._scored(hits, asked, 8, 6, SCHEMA)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {}
    for d, t, g in zip(*(hits[c].to_pylist() for c in ("doc", "term", "gain")), strict=True):
        if t in terms:
            q = terms.index(t) // 5
            want[q, d] = want.get((q, d), 0.0) + g
    for q in range(10):
        best = sorted(((-round(s, 6), d) for (p, d), s in want.items() if p == q))[:8]
        mine = [(-r["score"], r["doc_id"]) for r in got.to_pylist() if r["query_id"] == q]
        assert [d for _, d in mine] == [d for _, d in best] and np.allclose([s for s, _ in mine], [s for s, _ in best])
    assert peak < 60_000_000
