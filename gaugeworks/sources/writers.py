"""Sinks: tables, graph backups, incremental indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """A table in one of Spark's formats; its commit protocol makes the write all or nothing."""
    df.write.format(kind).mode(mode).options(header=True).save(path)


def backup_graph(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Nodes (id, label, ...) and edges (source, target, type, ...) to two tables; returns their counts."""
    save(nodes, f"{path}/nodes")
    save(edges, f"{path}/edges")
    spark = nodes.sparkSession
    return {n: spark.read.parquet(f"{path}/{n}").count() for n in ("nodes", "edges")}


def restore_graph(spark: SparkSession, path: str, label: str, counts: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of one label and the edges among them; ValueError if counts differ or an edge crosses."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if counts and (nodes.count(), edges.count()) != (counts["nodes"], counts["edges"]):
        raise ValueError("the backup's counts differ from those recorded")
    own = nodes.where(F.col("label") == label)
    ids = own.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    whole = inside.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    into = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    if inside.count() != whole.count() or into.count() != whole.count():
        raise ValueError("an edge leads out of the restored nodes")
    return own, whole


def indexed(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str) -> DataFrame:
    """All chunks with embeddings of ``model``: only those without one, or of another model, are embedded.

    ``embed`` takes (chunk_id, text) and returns (chunk_id, embedding).
    """
    fresh = F.col("embedding").isNotNull() & F.col("model").eqNullSafe(F.lit(model))
    stale = chunks.where(~fresh)
    made = embed(stale.select("chunk_id", "text"))
    done = stale.drop("embedding", "model").join(made, "chunk_id").withColumn("model", F.lit(model))
    return chunks.where(fresh).unionByName(done)


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with rows of known keys replaced and new ones added (S12, C2); keys of ``rows`` are distinct."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)
