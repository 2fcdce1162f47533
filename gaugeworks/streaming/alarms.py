"""Streams: complete windows, and triggers with cooldown kept in state.

A row is taken in the order of its time, not of its arrival (``ordered.InOrder``). Rows later than the
watermark are dropped one by one; ``ordered.chunked`` refuses whole chunks, as the batch form does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.streaming.ordered import InOrder, Part, frame, run


def complete_windows(stream: DataFrame, width: str, late: str, columns: Sequence[str], key: str = "gun_id", time: str = "time") -> DataFrame:
    """Tumbling windows, each once and only when the watermark has passed its end."""
    stats = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    w = stream.withWatermark(time, late).groupBy(key, F.window(time, width)).agg(F.count("*").alias("n"), *stats)
    return w.select(key, F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), "n", *[f"{c}_{s}" for c in columns for s in ("mean", "std")])


def sliding_windows(stream: DataFrame, width: str, step: str, late: str, column: str, key: str = "gun_id", time: str = "time") -> DataFrame:
    """(key, w_start, w_end, n, mean) of windows that begin every ``step``, each once when the watermark has passed it."""
    w = stream.withWatermark(time, late).groupBy(key, F.window(time, width, step)).agg(F.count("*").alias("n"), F.avg(column).alias("mean"))
    return w.select(key, F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), "n", "mean")


def session_windows(stream: DataFrame, gap: str, late: str, column: str, key: str = "gun_id", time: str = "time") -> DataFrame:
    """(key, s_start, s_end, n, mean) of runs of rows less than ``gap`` apart; s_end is the last row's time plus ``gap``."""
    w = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"), F.avg(column).alias("mean"))
    return w.select(key, F.col("session_window.start").alias("s_start"), F.col("session_window.end").alias("s_end"), "n", "mean")


def state_folder(folder: str, *model: object) -> str:
    """The checkpoint folder of a stream scored by one model.

    A restarted stream of the same model finds its state again; a new model, or a new rule, starts with
    none, or with what ``ordered.begin`` keeps of a snapshot. ``model`` is what the state depends on:
    version, rule, channels.
    """
    return f"{folder}/{hashlib.sha256(repr(model).encode()).hexdigest()[:32]}"


@dataclass(frozen=True)
class Rule:
    """Terminal codes, cooldown and repeat span (milliseconds); per code or shared."""

    codes: tuple[str, ...]
    wait: int
    repeat: int
    per_code: bool = True

    def step(self, before: str | None, code: str, at: int, accepted: dict[str, int]) -> tuple[bool, bool]:
        """(fires, is a repeat) of the next row; ``accepted`` (last accepted time of each code) is updated."""
        if code not in self.codes or (code == before if self.per_code else before in self.codes):
            return False, False
        last = accepted.get(code) if self.per_code else max(accepted.values(), default=None)
        if last is not None and at - last < self.wait:
            return False, False
        repeat = code in accepted and at - accepted[code] < self.repeat
        accepted[code] = at
        return True, repeat


class TriggerProcessor(InOrder):
    """One gun's triggers: waiting rows, the code before, and when each code last triggered; all last under another model."""

    parts = {"waiting": Part("rows", (), ("at", "name")), "before": Part("value", (), ("name",)), "accepted": Part("map", ("name",), ("at",))}

    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def judge(self, key: tuple, rows: list[tuple]) -> pd.DataFrame | None:
        before = self.value("before")
        held = {k[0]: v[0] for k, v in self.state["accepted"].iterator()}
        accepted = dict(held)
        fired = []
        for at, code in rows:
            fires, repeat = self.rule.step(before, code, at, accepted)
            if fires:
                fired.append((code, at, repeat))
            before = code
        self.state["before"].update((before,))
        for code, at in accepted.items():
            if held.get(code) != at:
                self.state["accepted"].updateValue((code,), (at,))
        return frame(key, fired, ["code", "at", "repeat"])


def triggers(stream: DataFrame, rule: Rule, late: str, key: str = "gun_id", time: str = "time", code: str = "code", initial: DataFrame | None = None) -> DataFrame:
    """(gun_id, code, at, repeat) of a stream's accepted triggers; ``at`` in milliseconds since 1970.

    ``initial`` is the state to begin with (``ordered.begin``). Needs the RocksDB state store provider.
    """
    rows = stream.select(F.col(key).cast("string").alias("gun_id"), F.col(time).cast("timestamp").alias("time"), F.col(code).alias("name"))
    rows = rows.withWatermark("time", late).withColumn("at", F.unix_millis("time"))
    return run(rows, TriggerProcessor(rule), "gun_id string, code string, at long, repeat boolean", initial)


@dataclass(frozen=True)
class Gate:
    """Gating of scored windows: idle share, restart hold and early-warning runs.

    Times are milliseconds; ``step`` is the distance of windows, ``idle_least`` the idle windows (missing
    ones count) after which a restart holds for ``hold``, ``k`` the windows in a row that warn.
    """

    threshold: float
    step: int
    idle_least: int
    hold: int
    k: int
    idle_share: float = 0.5

    def next(self, state: dict, at: int, score: float, idle: float) -> dict:
        """What the next window in order is; ``state`` is updated."""
        resting = idle > self.idle_share
        first = state.setdefault("first", at)
        if not resting:
            active = state.get("active")
            quiet = (at - active) // self.step - 1 if active is not None else (at - first) // self.step
            if quiet >= self.idle_least:
                state["held_from"] = at
            state["active"] = at
        held = "held_from" in state and at - state["held_from"] < self.hold
        alarm = score >= self.threshold and not resting and not held
        follows = state.get("last") == at - self.step
        run = (state.get("run", 0) + 1 if follows else 1) if alarm else 0
        state["run"], state["last"] = run, at
        return {"held": held, "alarm": alarm, "active": run >= self.k, "onset": run == self.k}


class GateProcessor(InOrder):
    """One gun's windows, gated in order of time; a restart's hold lasts under another model, a run of alarms does not."""

    parts = {"waiting": Part("rows", (), ("at", "a", "b")), "rest": Part("map", ("name",), ("at",)), "run": Part("map", ("name",), ("at",), lasting=False)}
    _RUN = ("run", "last")

    def __init__(self, gate: Gate) -> None:
        self.gate = gate

    def judge(self, key: tuple, rows: list[tuple]) -> pd.DataFrame | None:
        held = {k[0]: v[0] for part in ("rest", "run") for k, v in self.state[part].iterator()}
        state, out = dict(held), []
        for at, score, idle in rows:
            r = self.gate.next(state, at, score, idle)
            out.append((at, score, r["held"], r["alarm"], r["active"], r["onset"]))
        for name, value in state.items():
            if held.get(name) != value:
                self.state["run" if name in self._RUN else "rest"].updateValue((name,), (int(value),))
        return frame(key, out, ["at", "score", "held", "alarm", "active", "onset"])


def gated_windows(stream: DataFrame, gate: Gate, late: str, initial: DataFrame | None = None) -> DataFrame:
    """(gun_id, at, score, held, alarm, active, onset) of a stream of windows (gun_id, w_end, score, idle).

    ``initial`` is the state to begin with (``ordered.begin``). Needs the RocksDB state store provider. A null
    score is no alarm, a null idle share no rest.
    """
    rows = stream.select(F.col("gun_id").cast("string").alias("gun_id"), F.col("w_end").cast("timestamp").alias("w_end"), F.coalesce("score", F.lit(float("-inf"))).alias("a"), F.coalesce("idle", F.lit(0.0)).alias("b"))
    rows = rows.withWatermark("w_end", late).withColumn("at", F.unix_millis("w_end"))
    return run(rows, GateProcessor(gate), "gun_id string, at long, score double, held boolean, alarm boolean, active boolean, onset boolean", initial)
