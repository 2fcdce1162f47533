"""Anomaly scores: isolation trees, boosted trees, ensembles, attribution."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.stats import cumulative, quantiles, same_keys
from gaugeworks.operators.steps import steps_of


#: Rows and trees that are walked at a time: few enough for a core's cache, and many enough for its calls.
ROWS, TREES = 2048, 8


@dataclass(frozen=True)
class IsolationForest:
    """Trees as arrays: feature (-1 a leaf), threshold, children, and a leaf's depth with its correction."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    expected: float
    steps: int

    @cached_property
    def parts(self) -> np.ndarray:
        """``depth`` as multiples of a power of two so small that a row's sum over all trees is exact, in any order."""
        most = max(1.0, float(np.abs(self.depth).max(initial=0.0))) * len(self.feature)
        unit = 2.0 ** (np.ceil(np.log2(most)) - 52)
        return np.rint(self.depth / unit) * unit

    @cached_property
    def token(self) -> str:
        """Differs between forests."""
        parts = (self.feature, self.threshold, self.left, self.right, self.depth)
        return hashlib.blake2b(b"".join(np.ascontiguousarray(a).tobytes() for a in parts), digest_size=16).hexdigest()

    @cached_property
    def _walks(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(roots, feature, threshold, children, depth) of some trees at a time as one list of nodes; a leaf leads to itself.

        Made once in a task, so that a batch costs its rows' steps only.
        """
        out = []
        for t in range(0, len(self.feature), TREES):
            feature = self.feature[t : t + TREES]
            roots = np.arange(len(feature)) * feature.shape[1]
            node = np.arange(feature.size).reshape(feature.shape)
            leaf = feature < 0
            child = np.stack([np.where(leaf, node, side[t : t + TREES] + roots[:, None]) for side in (self.right, self.left)], axis=2)
            threshold = np.where(leaf, np.inf, self.threshold[t : t + TREES])
            out.append((roots, np.where(leaf, 0, feature).ravel(), threshold.ravel(), child.ravel(), self.parts[t : t + TREES].ravel()))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, higher: easier to isolate. Missing values are 0."""
        return self.scored(self.depths(np.nan_to_num(x)))

    def scored(self, total: np.ndarray) -> np.ndarray:
        """The score of rows from the sums of their depths."""
        return np.exp2(-total / len(self.feature) / self.expected)

    def depths(self, x: np.ndarray) -> np.ndarray:
        """The sum of the depths of the leaves that each row reaches; no value is missing."""
        total = np.zeros(len(x))
        for low in range(0, len(x), ROWS):
            total[low : low + ROWS] = self._depths(x[low : low + ROWS])
        return total

    def _depths(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        total, flat = np.zeros(n), np.ascontiguousarray(x.T).ravel()
        for roots, feature, threshold, child, depth in self._walks:
            row = np.tile(np.arange(n), len(roots))
            at = np.repeat(roots, n)
            # every row takes the same number of steps; numbers of nodes are all valid, so "clip" only skips the check
            for _ in range(self.steps):
                value = flat.take(feature.take(at, mode="clip") * n + row, mode="clip")
                at = child.take(2 * at + (value < threshold.take(at, mode="clip")), mode="clip")
            for d in depth.take(at, mode="clip").reshape(len(roots), n):
                total += d
        return total


def _average_depth(n: float) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


#: Nodes of a forest that the driver and each task may hold: a few tens of megabytes.
MOST_NODES = 1_000_000
_NODE = "tree int, node int, feature int, threshold double, lower int, upper int, depth double"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that all depend on each bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(hashes: np.ndarray, place: int) -> np.ndarray:
    """A batch's hashes, copies told apart: what ``draws`` makes a tree's numbers from."""
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    copy = np.empty(len(order), np.uint64)
    copy[order] = (np.arange(len(order)) - first).astype(np.uint64)
    return hashes ^ np.where(copy > 0, _mixed(copy + np.uint64([place]) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


def numbers(own: np.ndarray, tree: int, seed: int) -> np.ndarray:
    return _mixed(own ^ _mixed(np.uint64([(seed << 32) + tree + 1]))[0])


def low_numbers(own: np.ndarray, trees: int, seed: int, bar: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tree, places, numbers) of each tree's ``numbers`` that are at most ``bar``, in buffers used again for each tree."""
    start, y, z = own ^ (own >> np.uint64(30)), np.empty_like(own), np.empty_like(own)
    # the last step of _mixed leaves the upper 31 bits as they are, so it is only taken for numbers low in these
    nearly = bar | np.uint64(2**33 - 1)
    salts = _mixed(np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed << 32))
    for tree, salt in enumerate(salts ^ (salts >> np.uint64(30))):
        np.bitwise_xor(start, salt, out=y)
        np.multiply(y, np.uint64(0xBF58476D1CE4E5B9), out=y)
        np.right_shift(y, np.uint64(27), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint64(0x94D049BB133111EB), out=y)
        if len(y) and y.min() <= nearly:
            places = np.flatnonzero(y <= nearly)
            number = y[places] ^ (y[places] >> np.uint64(31))
            low = number <= bar
            yield tree, places[low], number[low]


def draws(hashes: np.ndarray, place: int, tree: int, seed: int) -> np.ndarray:
    """A number for each row of a batch and one tree; the rows of a tree's smallest numbers are its sample.

    A row's number comes from its own hash. Copies in a batch have numbers of their own, from the batch's
    place besides, so a row that is a third of all is a third of a sample.
    """
    return numbers(salted(hashes, place), tree, seed)


def grown(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple[int, float, int, int, float]]:
    """An isolation tree over the rows of ``x``: (feature or -1, threshold, lower, upper, depth) of each node."""
    rng = np.random.default_rng((seed, tree))
    nodes: list[tuple[int, float, int, int, float]] = []
    todo = [(x, 0, -1, 0)]
    while todo:
        part, depth, above, side = todo.pop()
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, depth + _average_depth(len(part))))
        if above >= 0:
            up = list(nodes[above])
            up[2 + side] = at
            nodes[above] = tuple(up)
        spread = np.ptp(part, axis=0) if len(part) else np.zeros(x.shape[1])
        if depth < limit and len(part) > 1 and spread.any():
            f = int(rng.choice(np.flatnonzero(spread)))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            nodes[at] = (f, cut, 0, 0, nodes[at][4])
            todo += [(part[part[:, f] >= cut], depth + 1, at, 1), (part[part[:, f] < cut], depth + 1, at, 0)]
    return nodes


def fit_forest(df: DataFrame, columns: Sequence[str], trees: int = 300, sample: int = 256, seed: int = 0) -> IsolationForest:
    """Trees grown in the executors, each from its own ``sample`` rows (the same for a seed).

    A tree's sample is the rows of its smallest numbers (``draws``). Each task sends on only rows whose
    number is low enough to be among them, about twice as many as are needed in all, whatever the table's
    size. What comes to the driver is the trees' nodes, at most 2 * ``sample`` for each; more than
    ``MOST_NODES`` are refused. Nulls count as 0; a table without rows gives trees of one leaf.
    """
    if trees * 2 * sample > MOST_NODES:
        raise ValueError(f"{trees} trees of {sample} rows may have more than {MOST_NODES} nodes")
    n = df.count()
    share = 2 * sample + 40 * np.sqrt(sample)
    bar = np.uint64(min(share / max(n, 1) * 2.0**64, 2.0**64 - 2.0**12))
    hashed = F.xxhash64(F.lit(seed), *[F.col(c) for c, kind in sorted(df.dtypes) if "map<" not in kind])
    rows = df.select(hashed.alias("_hash"), F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns]).alias("_x"))
    schema = pa.schema([("tree", pa.int32()), ("number", pa.int64()), ("x", pa.list_(pa.float64()))])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            hashes = batch.column(0).to_numpy().view(np.uint64)
            found = list(low_numbers(salted(hashes, (task << 32) + i), trees, seed, bar)) if len(hashes) else []
            if found:
                tree = np.repeat(np.array([t for t, _, _ in found], np.int32), [len(places) for _, places, _ in found])
                places, number = (np.concatenate(a) for a in list(zip(*found, strict=True))[1:])
                # the order of unsigned numbers holds for their halves
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array((number >> np.uint64(1)).view(np.int64)), batch.column(1).take(pa.array(places))], schema=schema)

    limit = max(1, int(np.ceil(np.log2(max(min(sample, n), 2)))))

    def grow(part: pa.Table) -> pa.Table:
        x = np.array(part["x"].to_pylist(), float).reshape(part.num_rows, len(columns))
        first = np.lexsort((*x.T[::-1], part["number"].to_numpy()))[:sample]
        tree = part["tree"][0].as_py()
        nodes = grown(x[first], seed, tree, limit)
        names = [f.split()[0] for f in _NODE.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
        columns_of = zip(*((tree, i, *node) for i, node in enumerate(nodes)), strict=True)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns_of, kinds, strict=True)], names=names)

    sent = rows.mapInArrow(chosen, "tree int, number long, x array<double>")
    # put in order here: an order of Spark's would grow the trees once more, for its ranges
    found = sorted(sent.groupBy("tree").applyInArrow(grow, _NODE).collect(), key=lambda r: (r["tree"], r["node"]))
    by_tree: dict[int, list] = {}
    for r in found:
        by_tree.setdefault(r["tree"], []).append((r["feature"], r["threshold"], r["lower"], r["upper"], r["depth"]))
    tables = list(by_tree.values()) or [[(-1, 0.0, 0, 0, 0.0)]]
    width = max(map(len, tables))
    table = np.array([t + [(-1, 0.0, 0, 0, 0.0)] * (width - len(t)) for t in tables], float)
    ints = [table[:, :, i].astype(np.int64) for i in (0, 2, 3)]
    return IsolationForest(ints[0], table[:, :, 1], ints[1], ints[2], table[:, :, 4], max(_average_depth(min(sample, n)), 1.0), limit)


def with_score(df: DataFrame, forest: IsolationForest, columns: Sequence[str], name: str = "score") -> DataFrame:
    """Adds a forest's score, in Arrow batches."""

    @F.pandas_udf("double")
    def score(rows):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(forest.score(rows.to_numpy(float)))

    return df.withColumn(name, score(F.struct(*[F.col(c).cast("double") for c in columns])))


def boosted(df: DataFrame, columns: Sequence[str], label: str, iterations: int = 20, depth: int = 4, seed: int = 0):  # noqa: ANN201
    """Gradient boosted trees on assembled columns; ``transform`` of the result adds probability."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    steps = [VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip"), GBTClassifier(labelCol=label, maxIter=iterations, maxDepth=depth, seed=seed)]
    return Pipeline(stages=steps).fit(df)


def share_below(df: DataFrame, reference: DataFrame, score: str, knots: int = 1000, name: str = "cdf") -> DataFrame:
    """Adds the share of ``reference`` scores at or below each score, from a grid of its quantiles.

    The grid is a fixed number of numbers, so scoring is a map. Between knots the share is linear.
    """
    grid = reference.approxQuantile(score, [i / knots for i in range(knots + 1)], 0.25 / knots)

    @F.pandas_udf("double")
    def share(x):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.interp(x, grid, np.linspace(0, 1, len(grid))) if grid else np.zeros(len(x)))

    return df.withColumn(name, share(F.col(score).cast("double")))


def exact_share(df: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """Adds cdf: the share of a key's own rows with scores at or below each, nulls below all."""
    n = df.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    n = cumulative(n, score, "_n", "_below", keys, "_all")
    return same_keys(df, n.select(*keys, score, ((F.col("_below") + F.col("_n")) / F.col("_all")).alias("cdf")), [*keys, score])


def combined(parts: Sequence[Column], weights: Sequence[float] | None = None, kind: str = "mean") -> Column:
    """The (weighted) mean or the greatest of component scores."""
    if kind == "max":
        return F.greatest(*parts)
    weights = weights or [1.0] * len(parts)
    total = sum(weights)
    out = F.lit(0.0)
    for p, w in zip(parts, weights, strict=True):
        out = out + p * (w / total)
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> list[float | None]:
    """Each column's approximate median, as a reference for ``ablation``.

    One task merges the digests of all others, so there are at most a few tasks a core, whatever the input.
    """
    few = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    return list(few.agg(*[F.percentile_approx(c, 0.5) for c in columns]).first())


def ablation(df: DataFrame, forest: IsolationForest, columns: Sequence[str], reference: Sequence[float], most: int = 8) -> DataFrame:
    """Adds contributions: how far the score drops with each feature at its reference, the largest first (E5, O2).

    share is the positive part over the sum of positive parts; ties go by the feature's place.
    """
    ref = np.asarray(reference, float)
    names = pa.array(list(columns), pa.string())
    token = forest.token

    @F.arrow_udf("array<struct<feature:string,contribution:double,share:double>>")
    def contributions(*values):  # noqa: ANN002, ANN202
        x = np.column_stack([v.to_numpy(zero_copy_only=False) for v in values])
        total, alone = steps_of(token, forest, x).without(x, ref)
        drops = forest.scored(total)[:, None] - forest.scored(alone)
        positive = np.maximum(drops, 0)
        shares = positive / np.maximum(positive.sum(axis=1, keepdims=True), 1e-12)
        order = np.argsort(-drops, axis=1, kind="stable")[:, :most]
        found = [np.take_along_axis(a, order, axis=1).ravel() for a in (drops, shares)]
        items = pa.StructArray.from_arrays([names.take(pa.array(order.ravel())), *map(pa.array, found)], names=["feature", "contribution", "share"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * order.shape[1]), items)

    return df.withColumn("contributions", contributions(*[F.col(c).cast("double") for c in columns]))


def findings(contributions: Column, deviations: Column, share: float = 0.03, deviation: float = 0.5, most: int = 6, clock: Sequence[str] = ("hour_sin", "hour_cos", "dow")) -> Column:
    """Sensor findings: contributions of enough share and deviation, with direction.

    ``deviations`` maps a feature's name to its deviation from the reference. A standard deviation counts
    only when it rose, and then as unstable.
    """
    named = F.transform(contributions, lambda c: F.struct(c["feature"].alias("feature"), c["share"].alias("share"), c["contribution"].alias("contribution"), F.try_element_at(deviations, c["feature"]).alias("deviation")))
    spread = lambda c: F.endswith(c["feature"], F.lit("_std"))
    sensor = lambda c: F.regexp_replace(c["feature"], "_[^_]*$", "")
    fits = F.filter(named, lambda c: (c["share"] >= share) & (c["contribution"] > 0) & (F.abs(c["deviation"]) >= deviation) & (~spread(c) | (c["deviation"] > 0)) & ~sensor(c).isin(*clock))
    direction = lambda c: F.when(spread(c), "unstable").when(c["deviation"] > 0, "high").otherwise("low")
    return F.slice(F.transform(fits, lambda c: F.struct(c["feature"].alias("feature"), direction(c).alias("direction"), c["share"].alias("share"))), 1, most)


def deviations(columns: Sequence[str], reference: Sequence[float]) -> Column:
    """A map from each feature to its deviation from the reference."""
    parts = [x for c, r in zip(columns, reference, strict=True) for x in (F.lit(c), F.col(c).cast("double") - float(r))]
    return F.create_map(*parts)


def threshold_of(df: DataFrame, score: str, normal: Column, q: float = 0.99) -> DataFrame:
    """One row, threshold: a quantile of the scores of normal rows."""
    return quantiles(df.where(normal), score, [q]).select(F.col("quantiles")[0].alias("threshold"))


def top_contributors(contributions: Column, most: int = 3, clock: Sequence[str] = ("hour_sin", "hour_cos", "dow")) -> Column:
    """The first contributors that add to the score, without features of the clock (O3)."""
    sensor = lambda c: F.regexp_replace(c["feature"], "_[^_]*$", "")
    return F.slice(F.filter(contributions, lambda c: (c["contribution"] > 0) & ~sensor(c).isin(*clock) & ~c["feature"].isin(*clock)), 1, most)
