"""Quality classifier: regularised quadratic discriminant over document statistics (operator 1).

Each class is a normal density over transformed statistics of a text (logarithms of counts and shares).
Its covariance is shrunk towards the covariance of both classes together and towards a diagonal; its
Cholesky factor is computed once and serves every Mahalanobis distance.

Scale: one pass over the texts makes a narrow table of statistics. Fitting joins that table with the
labels and adds up moments by class, of which two rows come to the driver; scoring is a map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import id_and_text, per_batch, small_batches, staged

STATISTICS = ("words", "word_length", "length_spread", "upper", "digits", "symbols", "stops", "distinct", "short", "repeated_lines", "lines")
_D = len(STATISTICS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-"]] = True
#: Shares are compared on a logarithmic scale from this one on.
_LEAST = 1e-3
#: How many usual words are added to a text's own, so that a few words prove little.
PRIOR_WORDS = 40


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``STATISTICS``; defined for empty texts."""
    words = text.split()
    n = len(words)
    raw = text.encode()
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    mean = (lengths.sum() + PRIOR_WORDS * 5) / (n + PRIOR_WORDS)
    spread = np.sqrt((np.square(lengths - mean).sum() + PRIOR_WORDS * 9) / (n + PRIOR_WORDS))
    per_byte = lambda x, usual: _share(x, len(raw), usual, 6 * PRIOR_WORDS)
    per_word = lambda x, usual: _share(x, n, usual, PRIOR_WORDS)
    return [
        float(np.log1p(n)),
        float(np.log(mean)),
        float(np.log(spread)),
        per_byte(bytes_of[65:91].sum(), 0.02),
        per_byte(bytes_of[48:58].sum(), 0.001),
        per_byte(bytes_of[_SYMBOL].sum(), 0.001),
        per_word(bytes_of[46] + bytes_of[44], 0.15),
        float(np.log((len(set(words)) + PRIOR_WORDS) / (n + PRIOR_WORDS))),
        per_word((lengths <= 3).sum(), 0.4),
        _share(len(lines) - len(set(lines)), len(lines), 0.0, 4),
        per_word(len(lines), 0.03),
    ]


def _share(x: float, of: int, usual: float, weight: int) -> float:
    """The logarithm of x / of, drawn towards a usual share where ``of`` is small against ``weight``."""
    return float(np.log(_LEAST + (x + usual * weight) / (of + weight)))


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row's text; a null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    return per_batch(id_and_text(docs, id_col, text_col), lambda ids, texts: {"doc_id": ids, "x": [statistics(t) for t in texts]}, schema, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Quadratic:
    """Two normal densities: means, inverse Cholesky factors, constants with the log priors."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of x."""
        log_density = [self.constant[c] - 0.5 * np.square((x - self.mean[c]) @ self.whiten[c].T).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -500, 500)))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", shrink: float = 0.05, pool: float = 0.05) -> Quadratic:
    """Fits the two classes on all labelled rows of ``stats`` that are not held out.

    ``pool`` is the weight of the common covariance, ``shrink`` that of the diagonal. A class without
    rows takes the moments of all; with no labels at all every score is 0.5. Null labels are ignored;
    an id with several labels counts with each.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label"))
    rows = stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id")
    pairs = [(i, j) for i in range(_D) for j in range(i + 1)]
    sums = [F.count("*").alias("n")]
    sums += [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(_D)]
    sums += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i, j in pairs]
    found = {r["label"]: r for r in rows.groupBy("label").agg(*sums).collect()}
    n, s, q = np.zeros(2), np.zeros((2, _D)), np.zeros((2, _D, _D))
    for c, r in found.items():
        n[c] = r["n"]
        s[c] = [r[f"s{i}"] for i in range(_D)]
        for i, j in pairs:
            q[c, i, j] = q[c, j, i] = r[f"q{i}_{j}"]
    if not n.sum():
        return Quadratic(np.zeros((2, _D)), np.zeros((2, _D, _D)), np.zeros(2))
    for c in (0, 1):
        if not n[c]:
            s[c], q[c] = s.sum(0) / n.sum(), q.sum(0) / n.sum()
    m = np.maximum(n, 1)[:, None]
    mean = s / m
    cov = q / m[:, :, None] - mean[:, :, None] * mean[:, None, :]
    common = np.einsum("c,cij->ij", np.maximum(n, 1) / np.maximum(n, 1).sum(), cov)
    whiten, constant = [], []
    for c in (0, 1):
        own = (1 - pool) * cov[c] + pool * common
        own = (1 - shrink) * own + shrink * np.diag(np.diag(own)) + 1e-4 * np.eye(_D)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        constant.append(-np.log(np.diag(factor)).sum() + np.log((n[c] + 1) / (n.sum() + 2)))
    return Quadratic(mean, np.array(whiten), np.array(constant))


def scored(stats: DataFrame, model: Quadratic) -> DataFrame:
    """(doc_id, score) of each row of ``stats``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, _D)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], schema=schema)

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score): one row for each row of ``docs``; score is from 0 to 1, higher for label 1.

    Only statistics of the text enter a score. Labels are read for rows that are not held out. Null and
    empty texts are scored by their (defined) statistics; repeated rows and null doc_ids keep their
    rows; an empty table gives an empty one.
    """
    stats = staged(statistics_of(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, label_col)
    return scored(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with all their columns.

    The model is fitted as in ``quality_scores``; the score itself is a map, so texts are not shuffled.
    """
    model = fit(staged(statistics_of(docs, id_col, text_col), "statistics"), labels)

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        x = np.array([statistics(t or "") for t in texts]).reshape(-1, _D)
        return pd.Series(model.score(x))

    return small_batches(docs).where(score(F.col(text_col)) >= threshold)
