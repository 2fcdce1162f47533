"""A forest's sums of depths looked up in place of walked, for values that come up often."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from gaugeworks.operators.scoring import IsolationForest

#: Rows that a key has before its steps are made: about as many walks cost what its steps cost.
OFTEN = 16
#: Bytes of steps that a Python worker may hold, keys that it counts, and numbers of one table while steps are made.
MOST_BYTES, MOST_KEYS, TABLE = 1 << 27, 1 << 20, 1 << 20


class Steps:
    """The sum of a row's depths over all trees, as a step function of one feature (the axis).

    All that a tree asks of a value is which thresholds it lies below, so a feature's values fall into bins.
    With the bins of all other features given (a key), the sum is a step function of the axis: the trees are
    followed once, down both sides of the axis's splits, and then a row costs one look-up in place of a walk:
    a bit for each bin tells where the sum changes, and the number of bits before is the sum's place. Rows whose key is rare, or for whose key there is no room, are walked. Depths add up exactly
    (``IsolationForest.parts``), so both ways give the same bits.

    The axis is the feature with the most bins in the first rows, so that keys are few.
    """

    def __init__(self, forest: IsolationForest, x: np.ndarray) -> None:
        self._forest = forest
        features = range(x.shape[1])
        inner = forest.feature >= 0
        self._cuts = [np.unique(forest.threshold[forest.feature == j]) for j in features]
        used = [len(np.unique(b)) for b in self._bins(x)]
        self._axis = int(np.argmax(used)) if used else 0
        self._width = len(self._cuts[self._axis]) + 2 if used else 2
        # a key is one number: its bins as digits
        self._digits, space = {}, 1
        for j in features:
            if j != self._axis:
                self._digits[j] = (space, len(self._cuts[j]) + 1)
                space *= len(self._cuts[j]) + 1
        self._usable = bool(used) and space < 2**62
        self._feature = forest.feature.ravel().astype(np.int32)
        base = np.arange(len(forest.feature))[:, None] * forest.feature.shape[1]
        self._left, self._right = ((side + base).ravel().astype(np.int32) for side in (forest.left, forest.right))
        self._roots, self._depth = base.ravel().astype(np.int32), forest.parts.ravel()
        rank = np.zeros(forest.feature.shape, np.int32)
        for j in features:
            own = inner & (forest.feature == j)
            rank[own] = np.searchsorted(self._cuts[j], forest.threshold[own])
        self._rank = rank.ravel()
        self._keys, self._seen, self._slot = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self._words = -(-self._width // 64)
        self._bits, self._before, self._slots = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        # the sum before any step is 0
        self._total, self._held = np.zeros(1024), 1

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(cuts, x[:, j], side="right") for j, cuts in enumerate(self._cuts)]

    def without(self, x: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the rows of ``x`` as they are (n), and with each feature at its reference (n, features)."""
        x, reference = np.nan_to_num(x), np.nan_to_num(reference)
        alone = np.empty_like(x)
        if not self._usable:
            total = self._forest.depths(x)
            for j in range(x.shape[1]):
                alone[:, j] = self._forest.depths(_put(x, j, reference[j]))
            return total, alone
        bins, fixed = self._bins(x), [int(b[0]) for b in self._bins(reference[None])]
        key = np.zeros(len(x), np.int64)
        for j, (unit, _) in self._digits.items():
            key += bins[j] * unit
        axis = bins[self._axis]
        total = self._sums(key, axis, lambda rows: x[rows])
        for j in range(x.shape[1]):
            walked = lambda rows, j=j: _put(x[rows], j, reference[j])
            if j == self._axis:
                alone[:, j] = self._sums(key, np.full_like(axis, fixed[j]), walked)
            else:
                alone[:, j] = self._sums(key + (fixed[j] - bins[j]) * self._digits[j][0], axis, walked)
        return total, alone

    def _sums(self, key: np.ndarray, axis: np.ndarray, walked) -> np.ndarray:  # noqa: ANN001
        slot = self._slots_of(key)
        if len(slot) and slot.min() < 0:
            self._count(key[slot < 0])
            slot = self._slots_of(key)
        rare = np.flatnonzero(slot < 0)
        if len(rare) == len(key):
            return self._forest.depths(walked(rare))
        word = slot * self._words + (axis >> 6)
        bits = self._bits.take(word, mode="clip") << (63 - (axis & 63)).astype(np.uint64)
        total = self._total.take(self._before.take(word, mode="clip") + np.bitwise_count(bits), mode="clip")
        if len(rare):
            total[rare] = self._forest.depths(walked(rare))
        return total

    def _slots_of(self, key: np.ndarray) -> np.ndarray:
        """Where a key's steps are, -1 if it has none."""
        if not len(self._keys):
            return np.full(len(key), -1)
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys.take(at, mode="clip") == key, self._slot.take(at, mode="clip"), -1)

    def _count(self, missed: np.ndarray) -> None:
        """Counts rows of keys without steps, and makes those of keys that are seen often."""
        keys, n = np.unique(missed, return_counts=True)
        at = np.searchsorted(self._keys, keys)
        known = self._keys.take(at, mode="clip") == keys if len(self._keys) else np.zeros(len(keys), bool)
        self._seen[at[known]] += n[known]
        new = ~known
        if len(self._keys) + new.sum() <= MOST_KEYS:
            self._keys, self._seen, self._slot = (np.insert(a, at[new], b) for a, b in ((self._keys, keys[new]), (self._seen, n[new]), (self._slot, -1)))
        due = np.flatnonzero((self._seen >= OFTEN) & (self._slot < 0))
        many = max(1, TABLE // (64 * self._words))
        for low in range(0, len(due), many):
            if 8 * (self._held + 2 * self._slots * self._words) >= MOST_BYTES:
                break
            some = due[low : low + many]
            self._make(self._keys[some])
            self._slot[some] = self._slots + np.arange(len(some))
            self._slots += len(some)

    def _make(self, keys: np.ndarray) -> None:
        """Appends the steps of ``keys``, in the order of slots."""
        n, width, features = len(keys), self._words * 64, len(self._cuts)
        digit = np.zeros((n, features), np.int32)
        for j, (unit, size) in self._digits.items():
            digit[:, j] = keys // unit % size
        digit = digit.ravel()
        key, node = np.repeat(np.arange(n, dtype=np.int32), len(self._roots)), np.tile(self._roots, n)
        low, high = np.zeros(len(key), np.int32), np.full(len(key), self._width - 2, np.int32)
        places, changes = [], []
        while len(key):
            feature = self._feature.take(node)
            leaf = feature < 0
            if leaf.any():
                k, d, inner = key[leaf].astype(np.int64) * width, self._depth.take(node[leaf]), ~leaf
                places += [k + low[leaf], k + high[leaf] + 1]
                changes += [d, -d]
                key, node, low, high, feature = key[inner], node[inner], low[inner], high[inner], feature[inner]
            rank = self._rank.take(node)
            # a value of bin b lies below the threshold of rank r if b <= r
            at = digit.take(key * features + feature)
            on = feature == self._axis
            lower = np.flatnonzero(np.where(on, low, at) <= rank)
            upper = np.flatnonzero(np.where(on, high, at) > rank)
            key, node, low, high = (
                np.concatenate((key[lower], key[upper])),
                np.concatenate((self._left.take(node[lower]), self._right.take(node[upper]))),
                np.concatenate((low[lower], np.where(on, np.maximum(low, rank + 1), low)[upper])),
                np.concatenate((np.where(on, np.minimum(high, rank), high)[lower], high[upper])),
            )
        change = np.bincount(np.concatenate(places), np.concatenate(changes), n * width)
        at = np.flatnonzero(change)
        bits = np.packbits(change != 0, bitorder="little").view("<u8").astype(np.uint64)
        inside = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
        # each key's changes add up to 0, so where none came yet the sum is the 0 of the key before
        before = self._held - 1 + np.concatenate(([0], inside[:-1]))
        end = self._held + len(at)
        self._total = _with_room(self._total, self._held, end)
        self._total[self._held : end] = np.cumsum(change[at])
        used = self._slots * self._words
        self._bits, self._before = _with_room(self._bits, used, used + len(bits)), _with_room(self._before, used, used + len(bits))
        self._bits[used : used + len(bits)], self._before[used : used + len(bits)] = bits, before
        self._held = end


def _with_room(a: np.ndarray, used: int, size: int) -> np.ndarray:
    """``a``, or its used part in an array of ``size`` at least."""
    if size <= len(a):
        return a
    out = np.empty(max(size, len(a) * 3 // 2), a.dtype)
    out[:used] = a[:used]
    return out


def _put(x: np.ndarray, column: int, value: float) -> np.ndarray:
    y = x.copy()
    y[:, column] = value
    return y


_HELD: dict[str, Steps] = {}


def steps_of(token: str, forest: IsolationForest, x: np.ndarray) -> Steps:
    """This worker's steps of a forest, kept from task to task until another forest comes."""
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = Steps(forest, x)
    return _HELD[token]
