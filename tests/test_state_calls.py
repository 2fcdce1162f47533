"""Calls of a key's state, each a round trip to the JVM: as many for a thousand rows as for ten."""

from types import SimpleNamespace

import pandas as pd
import pytest

from gaugeworks.streaming import alarms as S
from gaugeworks.streaming import ordered as O


class Held:
    """A part of state in memory that counts its calls."""

    def __init__(self, handle, kind):
        self.handle, self.kind, self.held = handle, kind, {"list": [], "map": {}, "value": None}[kind]

    def __getattr__(self, name):
        self.handle.calls += 1
        return {
            "get": lambda: iter(list(self.held)) if self.kind == "list" else self.held,
            "exists": lambda: bool(self.held) if self.kind != "value" else self.held is not None,
            "update": lambda v: setattr(self, "held", v),
            "put": lambda v: setattr(self, "held", list(v)),
            "appendValue": lambda v: self.held.append(v),
            "appendList": lambda v: self.held.extend(v),
            "clear": lambda: setattr(self, "held", {"list": [], "map": {}, "value": None}[self.kind]),
            "iterator": lambda: iter(list(self.held.items())),
            "updateValue": lambda k, v: self.held.__setitem__(k, v),
            "removeKey": lambda k: self.held.pop(k),
        }[name]


class Handle:
    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, *_):  # noqa: N802
        return Held(self, "value")

    def getListState(self, *_):  # noqa: N802
        return Held(self, "list")

    def getMapState(self, *_):  # noqa: N802
        return Held(self, "map")

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


def fed(processor, rows, watermarks):
    """The outputs and the number of calls: rows in one batch, then the watermark moves on."""
    handle, out = Handle(), []
    processor.init(handle)
    out += processor.handleInputRows(("g",), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    for w in watermarks:
        for at in sorted(t for t in handle.timers if t <= w):
            out += processor.handleExpiredTimer(("g",), SimpleNamespace(getCurrentWatermarkInMs=lambda w=w: w), None)
            handle.timers.discard(at)
            handle.calls += 1
    return pd.concat(out), handle.calls


MADE = {
    "triggers": lambda: S.TriggerProcessor(S.Rule(("0", "1"), 5, 50)),
    "gates": lambda: S.GateProcessor(S.Gate(40, 1, 3, 10, 2)),
    "warm-up": lambda: O.WarmUpProcessor(O.WarmUp(10_000, 12, 60.0, 0.9)),
    "ring": lambda: O.RingProcessor(10),
}


@pytest.mark.parametrize("name", sorted(MADE))
def test_calls_do_not_grow_with_rows(name):
    def calls(n):
        rows = pd.DataFrame({"at": range(1, n + 1), "name": [str(i % 2) for i in range(n)], "a": [float(i) for i in range(n)], "b": 0.0})
        out, made = fed(MADE[name](), rows.sample(frac=1, random_state=0), [n // 2, 2 * n])
        assert list(out["at"]) == sorted(out["at"]) and (name == "triggers" or len(out) == n)
        return made

    assert calls(1000) <= calls(40) + 5


def test_chunk_calls_do_not_grow_with_rows():
    def calls(n):
        rows = pd.DataFrame({"chunk": [i // 10 for i in range(n)], "at": range(n), "a": 1.0, "b": 0.0})
        return fed(O.ChunkProcessor(20), rows, [])[1]

    assert calls(1000) <= calls(40) + 5
