"""The recursive loop against a loop in Python."""

import random

from gaugeworks.operators import control as C


def by_hand(ticks, v):
    """Confirm or revert, then judge, then train, tick by tick, with the sums kept as they were at each version's training."""
    variant, first, fresh, shadow, confirm, margin, noise, majority, ratio = v
    trained, champion, challenger, prev, swapped, out = {}, None, None, None, None, []
    for tick, n, d, *rest in ticks:
        at, done = (n, d, *rest), []
        if champion is None:
            if n >= first:
                champion, trained[1] = 1, at
                done.append("first:v1")
            else:
                done.append(f"wait_first:{n}")
            out.append((variant, tick, champion, None, None, " ".join(done)))
            continue
        if prev is not None and n - swapped[0] >= confirm:
            gain = (champion % 2 - prev % 2) * (d - swapped[1])
            if gain < -noise * (n - swapped[0]):
                done.append(f"revert:v{champion}|v{prev}")
                champion = prev
            else:
                done.append(f"confirm:v{champion}")
            prev = None
        if challenger is not None:
            was = trained[challenger]
            files = n - was[0]
            if files >= shadow:
                odd, side = challenger % 2, challenger % 2 - champion % 2
                wins = files if side == 0 else (at[2] - was[2] if odd else at[3] - was[3])
                alarms = lambda v: at[4] - was[4] if v % 2 else at[5] - was[5]  # noqa: B023, E731
                if side * (d - was[1]) > margin * files and (not majority or 2 * wins > files) and (ratio is None or alarms(challenger) <= ratio * alarms(champion)):
                    done.append(f"swap:v{champion}|v{challenger}")
                    prev, swapped, champion = champion, at, challenger
                else:
                    done.append(f"keep:v{champion}|v{challenger}")
                challenger = None
            else:
                done.append(f"defer:{files}")
        if challenger is None and n - max(x[0] for x in trained.values()) >= fresh:
            challenger = len(trained) + 1
            trained[challenger] = at
            done.append(f"train:v{challenger}")
        out.append((variant, tick, champion, challenger, prev, " ".join(done)))
    return out


def test_equals_a_loop(spark):
    r = random.Random(3)
    n = odd = even = a = b = 0
    d, ticks = 0.0, []
    for i in range(1, 19):
        for _ in range(r.choice([0, 2, 5, 9])):
            n, g = n + 1, r.gauss(0, 1)
            d, odd, even, a, b = d + g, odd + (g >= 0), even + (g <= 0), a + r.randint(0, 3), b + r.randint(0, 3)
        ticks.append((i, n, d, odd, even, a, b))
    variants = [(i, 12, 5, 5, c, m, 0.05, j, q) for i, (m, j, q, c) in enumerate((m, j, q, c) for m in (0.0, 0.1) for j in (False, True) for q in (None, 1.0) for c in (4, 9))]
    got = C.control(spark.createDataFrame(ticks, C.TICK), spark.createDataFrame(variants, C.VARIANT))
    want = [row for v in variants for row in by_hand(ticks, v)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    words = " ".join(r[-1] for r in want)
    assert all(w in words for w in ("wait_first", "first", "train", "defer", "keep", "swap", "confirm", "revert"))


def test_empty(spark):
    none = C.control(spark.createDataFrame([], C.TICK), spark.createDataFrame([], C.VARIANT))
    assert none.collect() == []
