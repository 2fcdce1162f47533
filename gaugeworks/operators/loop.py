"""The model loop: when to train, when to judge, what to keep."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """How many ended files the first model, a retraining and a judgement need."""

    first: int = 16
    new: int = 5
    shadow: int = 5


@dataclass
class Registry:
    """Versions with the number of files each was trained on, champion, challenger, and what was done."""

    trained: dict[str, int] = field(default_factory=dict)
    champion: str | None = None
    challenger: str | None = None
    log: list[tuple[int, list[str]]] = field(default_factory=list)


def replay(ended: Sequence[int], schedule: Schedule, judge: Callable[[str, str, int, int], bool]) -> Registry:
    """Ticks of a control loop: ``ended`` is the number of files that have ended by each tick.

    Without a champion it waits for the first model. A challenger is judged once enough files that
    neither model was trained on have ended; then, or without one, a new challenger is trained if enough
    files are new. The loop keeps a few numbers; training and judging are jobs of their own, given by
    ``judge(champion, challenger, shadow files)``.
    """
    reg = Registry()

    def train(n: int) -> str:
        version = f"v{len(reg.trained) + 1:03d}"
        reg.trained[version] = n
        return version

    for tick, n in enumerate(ended):
        done = []
        if reg.champion is None:
            if n >= schedule.first:
                reg.champion = train(n)
                done.append(f"first:{reg.champion}")
            else:
                done.append(f"wait_first:{n}")
        else:
            if reg.challenger is not None:
                shadow = n - reg.trained[reg.challenger]
                if shadow >= schedule.shadow:
                    a, b = reg.champion, reg.challenger
                    swap = judge(a, b, reg.trained[b], n)
                    done.append(f"{'swap' if swap else 'keep'}:{a}|{b}")
                    reg.champion, reg.challenger = (b if swap else a), None
                else:
                    done.append(f"defer:{shadow}")
            if reg.challenger is None:
                new = n - max(reg.trained.values())
                if new >= schedule.new:
                    reg.challenger = train(n)
                    done.append(f"train:{reg.challenger}")
        reg.log.append((tick, done))
    return reg


def what_if(files: DataFrame, order: str, better: dict[str, str], schedules: Sequence[Schedule], tick: int) -> list[Registry]:
    """Replays each schedule over one count of ended files per tick of ``order``.

    ``better`` names the columns in which a challenger's and a champion's file scores stand; a challenger
    replaces the champion if it is at least as good in more than half of the files that have ended since
    it was trained. Only one row a tick comes to the driver.
    """
    per = files.groupBy(F.floor(F.col(order) / tick).alias("tick")).agg(F.count("*").alias("n"), F.count_if(F.col(better["b"]) >= F.col(better["a"])).alias("wins"))
    ended, won = [0], {0: 0}
    for r in per.orderBy("tick").collect():
        ended.append(ended[-1] + r["n"])
        won[ended[-1]] = won[ended[-2]] + r["wins"]
    return [replay(ended[1:], s, lambda a, b, seen, n: 2 * (won[n] - won[seen]) > n - seen) for s in schedules]
