"""Tables written once between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "gaugeworks.shared.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the session's checkpoint folder.

    On one machine (a local master) a folder of our own is made where a session names none; on a cluster
    that is refused, since each executor would write to its own disk.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get(_OWN, None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
    spark.conf.set(_OWN, folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: an executor lost later costs no recomputation, and the rows are computed once
    though several later steps read them. An application's tables are deleted when its driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that an application needs until its driver ends."""
    home = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    _deleted_at_exit(spark, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def finished(spark: SparkSession, *tables: DataFrame) -> None:
    """Frees what the steps so far have left: staged ``tables`` that no later step reads, and shuffle files.

    Spark removes a shuffle's files once the driver's garbage collection finds that nothing refers to it,
    which without a call may be half an hour later. Call it only where all that follows reads staged tables.
    """
    home = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/"
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if home.split("://")[-1].lstrip("/") not in path:
                raise ValueError(f"{path} is no staged table")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    spark._jvm.System.gc()


def _deleted_at_exit(spark: SparkSession, home: str) -> None:
    if spark.conf.get(f"{_OWN}.marked", None) != home:
        where = spark._jvm.org.apache.hadoop.fs.Path(home)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        spark.conf.set(f"{_OWN}.marked", home)
