"""Streams that judge each key's rows in order of time, with state that can be read back and carried on.

``InOrder`` holds a row in state until the watermark has passed it. Its parts of state are written down in
``parts``; ``snapshot`` reads them from a checkpoint folder with Spark's own state reader, and ``begin``
starts another stream from a snapshot: the same model goes on from all of it, a new one from the parts
that hold whatever the model is.

Needs the RocksDB state store provider (``rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A snapshot: one row for each entry of a part of a key's state, as numbers and a text.
SNAPSHOT = "gun_id string, part string, name string, at long, a double, b double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


@dataclass(frozen=True)
class Part:
    """A part of state: its kind (value, map or rows), the columns of its key and value, and whether it holds under another model.

    A column of a snapshot stands for each: ``key`` and ``value`` name them in order. ``rows`` is a list of
    blocks, each an array for every column: Spark pickles an entry of a list by itself, which for entries of
    one row takes longer than all else.
    """

    kind: str
    key: tuple[str, ...]
    value: tuple[str, ...]
    lasting: bool = True


_TYPES = {"name": "string", "at": "long", "a": "double", "b": "double"}


def _ddl(columns: Sequence[str], kind: str = "{}") -> str:
    return ", ".join(f"{c} {kind.format(_TYPES[c])}" for c in columns)


class Kept(StatefulProcessor):
    """A processor whose parts of state can be carried from stream to stream."""

    parts: dict[str, Part] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = {}
        for name, p in self.parts.items():
            if p.kind == "map":
                self.state[name] = handle.getMapState(name, _ddl(p.key), _ddl(p.value))
            elif p.kind == "rows":
                self.state[name] = handle.getListState(name, _ddl(p.value, "array<{}>"))
            else:
                self.state[name] = handle.getValueState(name, _ddl(p.value))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        lists: dict[str, list[tuple]] = {}
        for row in initialState.to_dict("records"):
            p, part = self.parts[row["part"]], self.state[row["part"]]
            value = tuple(self._typed(c, row[c]) for c in p.value)
            if p.kind == "map":
                part.updateValue(tuple(self._typed(c, row[c]) for c in p.key), value)
            elif p.kind == "rows":
                lists.setdefault(row["part"], []).append(value)
            else:
                part.update(value)
        for name, values in lists.items():
            self.add(name, values)
            self.placed(name, values)

    @staticmethod
    def _typed(column: str, value: object) -> object:
        if pd.isna(value):
            return None
        return {"string": str, "long": int, "double": float}[_TYPES[column]](value)

    def placed(self, part: str, values: list[tuple]) -> None:
        """Rows have been taken over."""

    def value(self, name: str, default: object = None) -> object:
        """The first column of a value."""
        held = self.state[name].get()
        return default if held is None else held[0]

    def rows(self, name: str) -> list[tuple]:
        """All of a part's rows, in the order in which they came."""
        return [row for block in self.state[name].get() for row in zip(*block, strict=True)]

    def add(self, name: str, rows: list[tuple]) -> None:
        if rows:
            self.state[name].appendValue(tuple(map(list, zip(*rows, strict=True))))

    def put(self, name: str, rows: list[tuple]) -> None:
        """A part's rows are these from now on."""
        if rows:
            self.state[name].put([tuple(map(list, zip(*rows, strict=True)))])
        else:
            self.state[name].clear()

    def close(self) -> None:
        pass


def frame(key: tuple, rows: list[tuple], columns: Sequence[str]) -> pd.DataFrame | None:
    """Rows of a key's output; the key is their first column, gun_id."""
    if not rows:
        return None
    return pd.DataFrame({"gun_id": [key[0]] * len(rows)} | dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)))


class InOrder(Kept):
    """Rows of a key in order of their time, each once the watermark has passed it; of rows of one time the last to arrive counts.

    A row that is not after the last one judged is late and dropped. ``waiting`` has rows with
    their time first. Every call of the state is a round trip to the JVM, so a batch's rows are read and written
    together, and a timer stands at the first waiting row only.
    """

    def __init_subclass__(cls, **kwargs: object) -> None:
        super().__init_subclass__(**kwargs)
        cls.parts = {"taken": Part("value", (), ("at",)), **cls.parts}

    def placed(self, part: str, values: list[tuple]) -> None:
        if part == "waiting":
            self.handle.registerTimer(min(v[0] for v in values))

    def judge(self, key: tuple, rows: list[tuple]) -> pd.DataFrame | None:
        """What the next rows (at, ...) give; they are in order."""
        raise NotImplementedError

    def _ready(self, key: tuple, watermark: int, waiting: dict[int, tuple]) -> Iterator[pd.DataFrame]:
        """Judges the rows that the watermark has passed; the others stay in ``waiting``."""
        ready = [waiting.pop(at) for at in sorted(at for at in waiting if at <= watermark)]
        if not ready:
            return
        out = self.judge(key, ready)
        self.state["taken"].update((ready[-1][0],))
        if out is not None:
            yield out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        watermark, taken = timerValues.getCurrentWatermarkInMs(), self.value("taken", -1)
        columns = self.parts["waiting"].value
        fresh: dict[int, tuple] = {}
        for part in rows:
            for row in zip(*(part[c].tolist() for c in columns), strict=True):
                if row[0] > watermark and row[0] > taken:
                    fresh[int(row[0])] = tuple(self._typed(c, v) for c, v in zip(columns, row, strict=True))
        waiting = {r[0]: r for r in self.rows("waiting")}
        first, held = min(waiting, default=None), len(waiting)
        yield from self._ready(key, watermark, waiting)
        if len(waiting) < held or waiting.keys() & fresh.keys():
            waiting |= fresh
            self.put("waiting", list(waiting.values()))
        elif fresh:
            self.add("waiting", list(fresh.values()))
            waiting |= fresh
        if waiting and (first is None or min(waiting) != first):
            self.handle.registerTimer(min(waiting))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        waiting = {r[0]: r for r in self.rows("waiting")}
        held = len(waiting)
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs(), waiting)
        if len(waiting) < held:
            self.put("waiting", list(waiting.values()))
        if waiting:
            self.handle.registerTimer(min(waiting))


def run(rows: DataFrame, processor: Kept, out: str, initial: DataFrame | None = None, time_mode: str = "EventTime") -> DataFrame:
    """``processor`` over a stream with a column gun_id; ``initial`` is a snapshot that it begins with."""
    given = None if initial is None else initial.groupBy("gun_id")
    return rows.groupBy("gun_id").transformWithStateInPandas(processor, out, "Append", time_mode, given)


def read_part(spark: SparkSession, checkpoint: str, processor: Kept, part: str) -> DataFrame:
    """(gun_id, part, name, at, a, b): one part of the state as the last finished batch of a stopped stream left it."""
    p = processor.parts[part]
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", part).load()
    held = {"map": "user_map_value", "rows": "_row", "value": "value"}[p.kind]
    if p.kind == "rows":
        rows = rows.select("key", F.explode(F.arrays_zip(*[F.col(f"list_element.{c}").alias(c) for c in p.value])).alias("_row"))
    columns = {c: F.col(f"user_map_key.{c}") for c in p.key} | {c: F.col(f"{held}.{c}") for c in p.value}
    return rows.select(F.col("key.gun_id").alias("gun_id"), F.lit(part).alias("part"), *[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _TYPES.items()])


def snapshot(spark: SparkSession, checkpoint: str, processor: Kept) -> DataFrame:
    """All parts of a stopped stream's state, as a table of ``SNAPSHOT``."""
    return reduce(DataFrame.unionByName, (read_part(spark, checkpoint, processor, p) for p in processor.parts))


def begin(state: DataFrame, processor: Kept, same_model: bool) -> DataFrame:
    """What of a snapshot a stream begins with: all of it under the same model, else the parts that last."""
    kept = [n for n, p in processor.parts.items() if same_model or p.lasting]
    return state.where(F.col("part").isin(*kept))


# warm-up (R5, R6)


@dataclass(frozen=True)
class WarmUp:
    """When a key's own statistics freeze, and its threshold from then on.

    That is at the ``rows``-th normal row, or ``span`` milliseconds after the first row if that comes
    sooner. With ``rows`` normal rows by then the threshold is their quantile ``q`` or ``common``,
    whichever is greater, and scores are centred and scaled by their mean and deviation (at least
    ``floor``); with fewer, ``common`` holds on and scores stay as they are.
    """

    span: int
    rows: int
    common: float
    q: float = 0.99
    floor: float = 1e-6


class WarmUpProcessor(InOrder):
    """One key's warm-up: mergeable moments and at most ``rows`` scores, dropped when they freeze."""

    parts = {
        "waiting": Part("rows", (), ("at", "a", "b")),
        "moments": Part("value", (), ("at", "a", "b"), lasting=False),  # rows, mean, sum of squares about it
        "began": Part("value", (), ("at",), lasting=False),
        "scores": Part("rows", (), ("a",), lasting=False),
        "frozen": Part("value", (), ("at", "a", "name"), lasting=False),  # from when on, threshold, source
    }

    def __init__(self, rule: WarmUp) -> None:
        self.rule = rule

    def _freeze(self, at: int, n: int) -> tuple[int, float, str]:
        enough = n >= self.rule.rows
        own = sorted(r[0] for r in self.rows("scores")) if enough else []
        self.state["scores"].clear()
        threshold = self.rule.common
        if enough:
            place = self.rule.q * (len(own) - 1)
            low = own[int(place)]
            high = own[min(int(place) + 1, len(own) - 1)]
            threshold = max(threshold, low + (high - low) * (place - int(place)))
        frozen = (at, threshold, "gun" if enough else "global")
        self.state["frozen"].update(frozen)
        return frozen

    def judge(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        rule, out, fresh = self.rule, [], []
        began = self.value("began")
        frozen = self.state["frozen"].get()
        held = self.state["moments"].get() or (0, 0.0, 0.0)
        n, mean, square = held
        if began is None:
            began = rows[0][0]
            self.state["began"].update((began,))
        for at, score, normal in rows:
            if frozen is None and at >= began + rule.span:
                self.add("scores", fresh)
                frozen, fresh = self._freeze(began + rule.span, n), []
            if frozen is None and normal:
                n += 1
                step = score - mean
                mean += step / n
                square += step * (score - mean)
                fresh.append((score,))
                if n >= rule.rows:
                    self.add("scores", fresh)
                    frozen, fresh = self._freeze(at, n), []
            own = frozen is not None and frozen[2] == "gun" and at >= frozen[0]
            z = (score - mean) / max(sqrt(square / n), rule.floor) if own else score
            out.append((at, score, frozen[1] if own else rule.common, z, "warming_up" if frozen is None else frozen[2]))
        self.add("scores", fresh)
        if n != held[0]:
            self.state["moments"].update((n, mean, square))
        return frame(key, out, ["at", "score", "threshold", "z", "source"])


def warm_up(stream: DataFrame, rule: WarmUp, late: str, initial: DataFrame | None = None) -> DataFrame:
    """(gun_id, at, score, threshold, z, source) of a stream (gun_id, time, score, normal): each row by its key's own threshold once that is frozen.

    A null score or normal counts as 0 and not normal.
    """
    rows = stream.select(F.col("gun_id").cast("string").alias("gun_id"), F.col("time").cast("timestamp").alias("time"), F.coalesce("score", F.lit(0.0)).cast("double").alias("a"), F.coalesce(F.col("normal").cast("double"), F.lit(0.0)).alias("b"))
    rows = rows.withWatermark("time", late).withColumn("at", F.unix_millis("time"))
    return run(rows, WarmUpProcessor(rule), "gun_id string, at long, score double, threshold double, z double, source string", initial)


# trace ring


class RingProcessor(InOrder):
    """The last ``size`` rows of a key, in order of time."""

    parts = {"waiting": Part("rows", (), ("at", "a")), "ring": Part("rows", (), ("at", "a"))}

    def __init__(self, size: int) -> None:
        self.size = size

    def judge(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        before = [] if len(rows) >= self.size else self.rows("ring")
        self.put("ring", [*before, *rows][-self.size :])
        return frame(key, rows, ["at", "score"])


def traced(stream: DataFrame, size: int, late: str, initial: DataFrame | None = None) -> DataFrame:
    """(gun_id, at, score) of a stream (gun_id, time, score) in order; the last ``size`` of each key stay in state (``last_traces``)."""
    rows = stream.select(F.col("gun_id").cast("string").alias("gun_id"), F.col("time").cast("timestamp").alias("time"), F.col("score").cast("double").alias("a"))
    rows = rows.withWatermark("time", late).withColumn("at", F.unix_millis("time"))
    return run(rows, RingProcessor(size), "gun_id string, at long, score double", initial)


def last_traces(spark: SparkSession, checkpoint: str, size: int) -> DataFrame:
    """(gun_id, at, score): the ring of each key, read from a stopped stream's state."""
    return read_part(spark, checkpoint, RingProcessor(size), "ring").select("gun_id", "at", F.col("a").alias("score"))


# chunks (R3, P3, P16)


class ChunkProcessor(Kept):
    """One key's chunks in the order of their number: refused whole, or taken into a buffer of ``limit`` milliseconds.

    A row leaves the buffer when it is more than ``limit`` behind the newest; in leaving, a row at rest
    gets the values of the last row at work that left before it (the carry).
    """

    parts = {"newest": Part("value", (), ("at",)), "buffer": Part("rows", (), ("at", "a", "b")), "carry": Part("value", (), ("a",))}

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        newest, out = self.value("newest"), []
        chunks: dict[int, list[tuple]] = {}
        for part in rows:
            for chunk, at, value, rest in zip(*(part[c].tolist() for c in ("chunk", "at", "a", "b")), strict=True):
                if not pd.isna(chunk):
                    chunks.setdefault(int(chunk), []).append((int(at), None if pd.isna(value) else float(value), float(rest)))
        held = {r[0]: r for r in self.rows("buffer")}
        buffer = dict(held)
        for chunk, part in sorted(chunks.items()):
            first, last = min(r[0] for r in part), max(r[0] for r in part)
            reason = "span" if last - first > self.limit else "clock went back" if newest is not None and last < newest - self.limit else None
            if reason:
                out.append(("refused", chunk, None, None, reason))
                continue
            for row in part:
                if newest is not None and row[0] < newest - self.limit:
                    out.append(("late", chunk, row[0], row[1], None))
                else:
                    buffer[row[0]] = row
            newest = last if newest is None else max(newest, last)
        gone = [] if newest is None else sorted(at for at in buffer if at < newest - self.limit)
        carry = self.value("carry") if gone else None
        for at in gone:
            _, value, rest = buffer.pop(at)
            if rest:
                value = carry
            else:
                carry = value
            out.append(("row", None, at, value, None))
        if buffer != held:
            self.put("buffer", list(buffer.values()))
        if newest is not None:
            self.state["newest"].update((newest,))
        if gone:
            self.state["carry"].update((carry,))
        if out:
            yield frame(key, out, ["tag", "chunk", "at", "value", "reason"]).astype({"chunk": "Int64", "at": "Int64"})


def chunked(stream: DataFrame, limit: int, initial: DataFrame | None = None) -> DataFrame:
    """(gun_id, tag, chunk, at, value, reason) of a stream of chunks (gun_id, chunk, at, value, rest), ``at`` in milliseconds.

    tag is ``refused`` for a chunk that spans more than ``limit`` or ends that much before the newest
    row so far; ``row`` for a row that leaves the buffer, in order of time, with the carried value where
    it is at rest; ``late`` for a row of an accepted chunk that is itself too old for the buffer. Chunks of
    one batch are taken in order of their number, those of a later batch after them.
    """
    rows = stream.select(F.col("gun_id").cast("string").alias("gun_id"), F.col("chunk").cast("long").alias("chunk"), F.col("at").cast("long").alias("at"), F.col("value").cast("double").alias("a"), F.coalesce(F.col("rest").cast("double"), F.lit(0.0)).alias("b"))
    return run(rows, ChunkProcessor(limit), "gun_id string, tag string, chunk long, at long, value double, reason string", initial, "None")
