"""The k past events most like each current one, by aligned waveforms.

The score is that of ``retrieval.waveform_scores``, but pairs of events exist only inside a task, and most
are pruned before their offsets are compared: a channel is summed up by the number, the least and the
greatest value of each of a few stretches of offsets, which bound its part of the score from above.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.blocks import searched
from gaugeworks.operators.retrieval import top_k

#: Offsets of a stretch, current events of a block and past ones of a range.
STRETCH, BLOCK, SPAN = 5, 2048, 8192
#: Past events that are compared offset by offset at once.
STEP = 64


def packed(series: DataFrame, channels: Sequence[str], length: int) -> DataFrame:
    """(event_id, values): an event's channels one after the other, ``length`` offsets each, null where nothing was seen."""
    place = F.array_position(F.array(*map(F.lit, channels)), F.col("channel")) - 1
    cells = series.where(F.col("channel").isin(*channels) & F.col("value").isNotNull() & F.col("offset").between(0, length - 1))
    found = cells.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct((place * length + F.col("offset")).cast("int").alias("at"), F.col("value").cast("double").alias("v")))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(len(channels) * length - 1)), lambda i: F.col("_m")[i])
    return found.select(F.col("event_id").cast("long").alias("event_id"), values.alias("values"))


@dataclass
class _Events:
    """Events as (events, channels, offsets), nan where nothing was seen, with what bounds their scores."""

    ids: np.ndarray
    x: np.ndarray
    n: np.ndarray
    part_n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray


def events_of(ids: np.ndarray, x: np.ndarray) -> _Events:
    seen = ~np.isnan(x)
    begins = np.arange(0, x.shape[2], STRETCH)
    low = np.minimum.reduceat(np.where(seen, x, np.inf), begins, axis=2)
    high = np.maximum.reduceat(np.where(seen, x, -np.inf), begins, axis=2)
    size = np.where(seen, np.abs(x), 0).max(axis=2, initial=0)
    return _Events(ids, x, seen.sum(axis=2), np.add.reduceat(seen, begins, axis=2, dtype=np.int64), low, high, size)


def bounds(e: _Events, i: int, past: _Events, binary: np.ndarray, least: int) -> np.ndarray:
    """No less than the score of event ``i`` of ``e`` against each of ``past``.

    A stretch gives at most as many shared offsets as either has; values there differ by the gap between
    the two ranges or more, and the scale is at most the greatest magnitude of both. -1 where no channel
    can count.
    """
    shared = np.minimum(e.part_n[i], past.part_n)
    with np.errstate(invalid="ignore"):
        gap = np.maximum(np.maximum(e.low[i] - past.high, past.low - e.high[i]), 0)
    gap = np.where(shared > 0, gap, 0)
    scale = np.maximum(e.size[i], past.size)
    scale = np.where(scale == 0, 1, scale)[:, :, None]
    away = np.where(binary[:, None], gap > 0, gap / scale / 2)
    total = (shared * (1 - away)).sum(axis=2)
    need = np.maximum(least, -(-e.n[i] // 2))
    counts = (e.n[i] >= least) & (shared.sum(axis=2) >= need)
    bound = np.where(counts, total / np.maximum(e.n[i], 1), 0).sum(axis=1) / max((e.n[i] > 0).sum(), 1)
    return np.where(counts.any(axis=1), bound, -1)


def scores(e: _Events, i: int, past: _Events, those: np.ndarray, binary: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of event ``i`` against ``those`` of ``past``, and the number of channels that count."""
    a, b = e.x[i], past.x[those]
    both = ~np.isnan(a) & ~np.isnan(b)
    shared = both.sum(axis=2)
    gap = np.where(both, np.abs(a - b), 0)
    scale = np.where(both, np.maximum(np.abs(a), np.abs(b)), 0).max(axis=2, initial=0)
    scale = np.where(scale == 0, 1, scale)
    with np.errstate(divide="ignore", invalid="ignore"):
        distance = np.where(binary, (gap > 0).sum(axis=2) / shared, gap.sum(axis=2) / scale / 2 / shared)
    counts = (e.n[i] >= least) & (shared >= np.maximum(least, -(-e.n[i] // 2)))
    parts = np.where(counts, shared / np.maximum(e.n[i], 1) * (1 - np.where(counts, distance, 0)), 0)
    return parts.sum(axis=1) / max((e.n[i] > 0).sum(), 1), counts.sum(axis=1)


def best(e: _Events, i: int, past: _Events, k: int, binary: np.ndarray, least: int, digits: int) -> tuple[list[tuple[float, int, int]], int]:
    """The k best (score, past id, channels) of event ``i``, and how many were compared offset by offset."""
    bound = bounds(e, i, past, binary, least)
    order = np.argsort(-bound, kind="stable")
    order = order[(bound[order] >= 0) & (past.ids[order] != e.ids[i])]
    kept: list[tuple[float, int, int]] = []
    compared = 0
    for at in range(0, len(order), STEP):
        those = order[at : at + STEP]
        # rounding may lift a score by half a unit
        if len(kept) == k and bound[those[0]] < -kept[-1][0] - 10.0**-digits:
            break
        s, channels = scores(e, i, past, those, binary, least)
        compared += len(those)
        kept += [(-round(float(v), digits), int(p), int(c)) for v, p, c in zip(s, past.ids[those], channels, strict=True) if c]
        kept = sorted(kept)[:k]
    return [(-v, p, c) for v, p, c in kept], compared


def _search(asked: pa.Table, known: pa.Table, k: int, shape: tuple[int, int], binary: list[bool], least: int, digits: int) -> pa.Table:
    def made(t: pa.Table) -> _Events:
        flat = t["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        return events_of(t["event_id"].to_numpy(), flat.reshape(t.num_rows, *shape))

    schema = pa.schema([("event_id", pa.int64()), ("past_id", pa.int64()), ("score", pa.float64()), ("channels", pa.int64())])
    if not (asked.num_rows and known.num_rows):
        return schema.empty_table()
    e, past, kinds = made(asked), made(known), np.array(binary)
    out = [(int(e.ids[i]), p, v, c) for i in range(len(e.ids)) for v, p, c in best(e, i, past, k, kinds, least, digits)[0]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], [], []), schema, strict=True)], schema=schema)


def waveform_top_k(current: DataFrame, history: DataFrame, k: int, channels: Sequence[str], length: int, binary: Sequence[str] = (), least: int = 3, digits: int = 6) -> DataFrame:
    """(event_id, past_id, score, channels, rank): the k past events most like each current one.

    Both sides have (event_id, channel, offset, value) with offsets from 0 to ``length`` - 1 and the named
    channels; other rows and null values count as not seen. Scores are rounded to ``digits``; equal ones go
    by the past event's id. An event whose channels share too few offsets with all others has no rows.
    """
    search = partial(_search, k=k, shape=(len(channels), length), binary=[c in binary for c in channels], least=least, digits=digits)
    found = searched(packed(current, channels, length), packed(history, channels, length), search, "event_id long, past_id long, score double, channels long", "event_id", "event_id", BLOCK, SPAN)
    return top_k(found, k, "event_id", "past_id")
