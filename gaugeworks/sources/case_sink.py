"""A sink of streams for tables that change together: cases and their outbox.

A batch's tables are written to folders of their own and then committed by one marker file, so readers see
all of a batch or nothing: a batch that stopped between two tables is written over when the stream runs it
again, and one that is committed is skipped. ``compacted`` folds all committed batches into a base, drops
what is past its retention, and commits that in the same way; older folders are no longer read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kept:
    """A table of the sink: its key, the column that orders rows of one key, and which of them counts.

    ``last`` is an upsert: a later batch wins, in a batch the greatest ``order``. ``first`` is an insert that
    ignores what is there: the earliest batch wins, in a batch the least ``order``. Of equal ones the row
    that is greatest (or least) as a struct counts.
    """

    schema: str
    key: str
    order: str
    rule: str = "last"


class BatchSink:
    """Tables by name that a stream's batches write together. ``folder`` must be one that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Kept]) -> None:
        self.spark, self.folder, self.tables = spark, folder, tables

    def _path(self, path: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def committed(self) -> tuple[int | None, list[int]]:
        """The newest base, and the batches committed after it."""
        fs, where = self._path(f"{self.folder}/committed")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        base = max((int(n.removeprefix("base-")) for n in names if n.startswith("base-")), default=None)
        return base, sorted(int(n) for n in names if n.isdigit() and (base is None or int(n) > base))

    def _commit(self, name: str) -> None:
        fs, where = self._path(f"{self.folder}/committed/{name}")
        fs.create(where, True).close()

    def write(self, batch: DataFrame, batch_id: int, split: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
        """Writes and commits the tables that ``split`` makes of a batch, once however often it is run."""
        base, later = self.committed()
        if batch_id in later or (base is not None and batch_id <= base):
            return
        held = batch.persist()  # one computation for all tables
        try:
            made = split(held)
            for name in self.tables:
                made[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/batch-{batch_id}")
        finally:
            held.unpersist()
        self._commit(str(batch_id))

    def sink(self, stream: DataFrame, split: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, **trigger: object):  # noqa: ANN201
        """Starts the stream into this sink."""
        return stream.writeStream.foreachBatch(lambda batch, i: self.write(batch, i, split)).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def read(self, name: str) -> DataFrame:
        """A table as the committed batches leave it."""
        t, (base, later) = self.tables[name], self.committed()
        rows = self.spark.createDataFrame([], t.schema).withColumn("_batch", F.lit(-1).cast("long"))
        if base is not None:
            rows = self.spark.read.schema(t.schema).parquet(f"{self.folder}/{name}/base-{base}").withColumn("_batch", F.lit(base).cast("long"))
        if later:
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch-(\d+)/[^/]*$", 1).cast("long")
            fresh = self.spark.read.schema(t.schema).parquet(*[f"{self.folder}/{name}/batch-{i}" for i in later]).withColumn("_batch", number)
            rows = rows.unionByName(fresh)
        columns = [c for c in rows.columns if c != "_batch"]
        # an aggregate, not a window: a hot key's rows are combined before they are shuffled
        by = F.min if t.rule == "first" else F.max
        best = rows.groupBy(t.key).agg(by(F.struct("_batch", t.order, F.struct(*columns).alias("_row"))).alias("_best"))
        return best.select("_best._row.*")

    def compacted(self, gone: dict[str, Column]) -> None:
        """Folds the committed batches into a base without the rows for which ``gone`` holds, by table."""
        base, later = self.committed()
        if not later:
            return
        top = later[-1]
        for name in self.tables:
            rows = self.read(name)
            if name in gone:
                rows = rows.where(~F.coalesce(gone[name], F.lit(False)))
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/base-{top}")
        self._commit(f"base-{top}")


def past_retention(now: int, span: int, status: str = "status", created: str = "created_at") -> Column:
    """Outbox rows that are no longer pending and older than ``span``."""
    return (F.col(status) != "pending") & (F.col(created) < now - span)


#: Cases by id, replaced; deliveries by event, the first of each kept.
CASES = {
    "cases": Kept("case_id long, gun long, code string, updated_at long", "case_id", "updated_at"),
    "outbox": Kept("event_id long, case_id long, status string, created_at long", "event_id", "created_at", "first"),
}
