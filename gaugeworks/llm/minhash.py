"""MinHash near-duplicates by fast similarity sketching (operator 13).

A sketch has ``SIZE`` coordinates. In round i every shingle is put into a bin of the sketch by a hash of
that round, with the value i + (a fraction of the same hash), and a coordinate keeps its smallest value;
the first rounds that fill all coordinates end it. After ``SIZE`` such rounds, round ``SIZE`` + j puts all
shingles into bin j, so every coordinate fills, whatever the set. Two sets agree in a coordinate with the
chance of their Jaccard similarity, and the number of coordinates in which they agree is concentrated about
its mean as if they were independent, while a set of n shingles costs about n + SIZE * log(SIZE) hashes and
not n * SIZE.

Bands of coordinates give candidates; every candidate is decided by its whole sets (``simhash.sketched_groups``,
which holds the joins).
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.simhash import sketched_groups

#: Coordinates of a sketch: BANDS bands of ROWS. Two sets of similarity s share no band with the chance
#: (1 - s ** ROWS) ** BANDS: 5e-7 at 0.85, below 1e-9 at 0.9.
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
_FULL = np.uint64((1 << 64) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that all depend on each bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROUNDS = _mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(own: np.ndarray) -> np.ndarray:
    """The sketch of a set of distinct hashes, which must not be empty: in each coordinate the round and its fraction."""
    low = np.full(SIZE, _FULL)
    at_once = min(SIZE, max(1, ceil(SIZE * (log(SIZE) + 2) / len(own))))
    for first in range(0, SIZE, at_once):
        rounds = np.arange(first, min(first + at_once, SIZE), dtype=np.uint64)
        h = _mixed(own ^ _ROUNDS[rounds.astype(int)][:, None])
        place = ((h >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)
        np.minimum.at(low, place.ravel().astype(np.intp), ((rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        if not (low == _FULL).any():
            return low
    for j in np.flatnonzero(low == _FULL).tolist():
        h = _mixed(own ^ _ROUNDS[SIZE + j])
        low[j] = (np.uint64(SIZE + j) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
    return low


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set's sketch; an empty set has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in sketch(own).reshape(BANDS, ROWS).T:
        keys = _mixed((keys ^ column) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    Sets of distinct shingles of ``shingle`` words are linked at a Jaccard similarity of ``similarity`` or
    more, confirmed on whole sets; component_id is the smallest doc_id that links reach, itself included,
    and kept says that it is the row's own. A text of fewer words is one shingle; a null text or one without
    words has none and links with nothing. Rows that repeat keep one row each. A null doc_id stays null and
    is never a component_id, unless its component has no other; it is kept only then. An empty table gives
    an empty one.
    """
    found = sketched_groups(docs, bands, id_col, text_col, shingle, similarity, kept=8)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
