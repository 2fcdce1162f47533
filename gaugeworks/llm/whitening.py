"""Embedding whitening from an exact integer scatter (operator 12).

An entry c becomes the whole number x = floor(64 * c) + 1000000. The fit subtracts a shift, so the numbers
that are multiplied are small, and adds up counts, sums S and cross-products X'X as whole numbers of any
size: a block's products are exact in doubles or else in Python's integers, a task's totals are Python's
integers, and the tasks' totals meet as limbs of 30 bits in Spark's own sums of longs. n * X'X - S S' is
then formed exactly, and only its entries over n * n become doubles, each rounded once, for ``eigh``.

Scale: the fit is one pass whose tasks write a row for each pair of dimensions; those rows are summed on
the map side and dealt out by pair, so what the driver gets is a number of rows that the dimension alone
fixes. Whitening is a map; the covariance of what it gives is summed in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import small_batches

#: x is floor(STEP * c) + SHIFT.
STEP, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: A task's total is sent as LIMBS numbers of LIMB bits: enough for 2 ** 40 products of two longs.
LIMB, LIMBS = 30, 6
#: Whole numbers below this have exact sums in doubles.
_EXACT = 1 << 53
_LONG = 1 << 62


def _rows_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has only finite entries, as doubles."""
    rows = small_batches(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & whole)


def shifted(values: np.ndarray) -> np.ndarray:
    """x - SHIFT, as longs; an entry beyond 2 ** 62 counts as 2 ** 62, with its sign."""
    return np.clip(np.floor(values * STEP), -float(_LONG), float(_LONG)).astype(np.int64)


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns and of their products, exact: Python's integers in object arrays."""
    top = max(int(y.max()), -int(y.min()), 1)
    if top * top * len(y) < _EXACT:
        z = y.astype(np.float64)
        return (z.sum(axis=0)).astype(np.int64).astype(object), (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.sum(axis=0), z.T @ z


def _limbs(value: int) -> list[int]:
    """``value`` in base 2 ** LIMB; the last limb has the sign and all that is left."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors as matrices, whose vectors have one length each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            vectors = part.column(1)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            if len(sizes):
                yield part.column(0), flat.reshape(len(sizes), int(sizes[0]))


def _totals(rows: DataFrame) -> DataFrame:
    """(i, j, limbs) with i <= j < d: sums of products of columns i and j; j = d is the column's own sum; (d, d) counts rows."""
    names = [f"l{k}" for k in range(LIMBS)]
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), *[(n, pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for _, block in _blocks(batches):
            s, p = scatter(shifted(block))
            n, sums, products = n + len(block), sums + s, products + p
        if n:
            d = len(sums)
            cells = [(i, j, products[i, j]) for i in range(d) for j in range(i, d)] + [(i, d, sums[i]) for i in range(d)] + [(d, d, n)]
            columns = zip(*((i, j, *_limbs(int(v))) for i, j, v in cells), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    sent = rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} long" for n in names))
    return sent.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])


@dataclass
class Whitening:
    """What the fit gives: n, the sums of x - SHIFT, the eigenvalues by falling size and their vectors in columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def covariance(n: int, sums: list[int], products: list[list[int]]) -> tuple[np.ndarray, float]:
    """(n * X'X - S S') / n ** 2, its entries whole until the division, and its trace likewise."""
    d = len(sums)
    whole = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return np.array([[v / (n * n) for v in row] for row in whole]).reshape(d, d), sum(whole[i][i] for i in range(d)) / (n * n)


def _fitted(rows: DataFrame, d: int) -> Whitening:
    cells = {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in _totals(rows).collect()}
    n, sums = cells[d, d], [cells[i, d] for i in range(d)]
    v, trace = covariance(n, sums, [[cells[min(i, j), max(i, j)] for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    # what rounding makes of zero is no variance
    return Whitening(n, sums, np.where(values > d * np.finfo(float).eps * max(values[0], 0.0), values, 0.0), vectors, trace)


def centred(fit: Whitening, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """x - S / n as doubles and, for each row, the sum over dimensions of (n * x - S) ** 2, exact."""
    top = max(int(y.max()), -int(y.min()), 1) * fit.n + max(map(abs, fit.sums))
    if top * top * y.shape[1] < 1 << 63:
        whole = y * fit.n - np.array(fit.sums, np.int64)
        return whole / fit.n, (whole * whole).sum(axis=1).tolist()
    whole = y.astype(object) * fit.n - np.array(fit.sums, object)
    return (whole / fit.n).astype(np.float64), (whole * whole).sum(axis=1).tolist()


def projected(fit: Whitening, x: np.ndarray, components: int) -> np.ndarray:
    """Whitened coordinates; a component without variance has none (nan)."""
    e = fit.values[:components]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(e > 0, (x @ fit.vectors[:, :components]) / np.sqrt(e), np.nan)


def _identity_error(rows: DataFrame, fit: Whitening, components: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    kept = int((fit.values[:components] > 0).sum())
    if not kept:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((kept, kept)), np.zeros(kept)
        for _, block in _blocks(batches):
            w = projected(fit, centred(fit, shifted(block))[0], kept)
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        i, j = np.triu_indices(kept)
        yield pa.RecordBatch.from_pydict({"i": pa.array([*i, *range(kept)], pa.int32()), "j": pa.array([*j, *[kept] * kept], pa.int32()), "v": pa.array([*total[i, j], *mean])})

    # exact sums of longs need no order: a double goes as its parts of 2 ** -20 and of 2 ** -60
    sent = rows.mapInArrow(run, "i int, j int, v double")
    high = F.floor(F.col("v") * 2.0**20)
    low = F.floor((F.col("v") * 2.0**20 - high) * 2.0**30)
    found = sent.groupBy("i", "j").agg(F.sum(high).alias("high"), F.sum(low).alias("low")).collect()
    cell = {(r["i"], r["j"]): fsum((r["high"] / 2.0**20, r["low"] / 2.0**50)) / fit.n for r in found}
    return max(abs(cell[i, j] - cell[i, kept] * cell[j, kept] - (i == j)) for i in range(kept) for j in range(i, kept))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; all others are
    fitted and returned, rows that repeat as often as they stand and null ids as null. Vectors must have
    one length: the longest that any has is taken, and rows of other lengths are dropped as broken.
    Components are numbered from 1 by falling eigenvalue, up to ``components`` or the dimension. deviation
    is a decimal(38, 0), null beyond that. A component without variance (as in a table of one row) has a
    null whitened and is left out of identity_error, which is null if none has any; explained is null
    where the trace is zero. An empty table gives an empty one.
    """
    rows = _rows_of(vectors, id_col, vector_col)
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    d = rows.agg(F.max(F.size("vector"))).first()[0]
    if d is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("vector") == d)
    fit = _fitted(rows, d)
    kept = min(components, d)
    error = _identity_error(rows, fit, kept)
    explained = [float(e) / fit.trace if fit.trace else None for e in fit.values[:kept]]
    limit = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
        for ids, block in _blocks(batches, 256):
            x, deviation = centred(fit, shifted(block))
            w = projected(fit, x, kept).ravel()
            many = len(block) * kept
            of_row = np.repeat(np.arange(len(block)), kept)
            exact = pa.array([v if v < limit else None for v in deviation], pa.decimal128(38, 0))
            columns = [ids.take(pa.array(of_row)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(block))), pa.array(np.full(many, fit.n)), exact.take(pa.array(of_row))]
            columns += [pa.array(w, mask=np.isnan(w)), pa.array(explained * len(block), pa.float64()), pa.array([error] * many, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, out)
