"""What several operators of this subpackage need: staged tables, Arrow passes over texts, row order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.staging import finished, staged

__all__ = ["finished", "id_and_text", "per_batch", "small_batches", "staged"]


#: Rows of an Arrow batch: texts can be long, and a batch is held several times over.
BATCH_ROWS = 256


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most ``BATCH_ROWS`` rows from now on.

    A pandas function sees a batch whole, so its rows bound a task's memory; a session that asks for
    fewer rows keeps its own number.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, renamed; a null text is empty."""
    return small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def per_batch(df: DataFrame, f: Callable[[list, list], dict], schema: pa.Schema, ddl: str, rows: int = 512) -> DataFrame:
    """``f(doc_ids, texts)`` over slices of at most ``rows`` rows of (doc_id, text); it returns columns.

    Slices bound the memory of a task whatever its partition holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = f(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return df.mapInArrow(run, ddl)
