"""Scans: readings, tagged file sets, manifests, JSON with bad lines, replayed streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.schemas import READING


def on_off(c: Column) -> Column:
    """1.0 for on, true or 1 and 0.0 for off, false or 0 in any case; anything else is an error, null stays null."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin("on", "true", "1", "1.0"), 1.0).when(x.isin("off", "false", "0", "0.0"), 0.0).when(x.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not on or off: "), x)).cast("double"))


def readings_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Typed readings of CSV files with a header; only the columns asked for are parsed.

    Times are UTC; a malformed field is null. Nothing is inferred, so the files are read once.
    """
    schema = READING.replace("gun_id string, ", "").replace("time timestamp_ntz", "time string")
    rows = spark.read.schema(schema).option("header", True).csv(path)
    time = F.to_timestamp(F.col("time")).cast("timestamp_ntz")
    out = rows.withColumn("time", time).withColumn("c10", on_off(F.col("c10")))
    return out.select(*columns) if columns else out


def columns_of(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Some columns of a Parquet table."""
    return spark.read.parquet(path).select(*columns)


def tagged(df: DataFrame, name: str = "file") -> DataFrame:
    """Adds the name of each row's file, without folder and extension (S3). For file scans."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1))


def kept_files(manifest: DataFrame, file: str = "file", dropped: str = "dropped") -> DataFrame:
    """Files of a manifest that no reason drops."""
    return manifest.where(F.col(dropped).isNull() | (F.trim(F.col(dropped).cast("string")).isin("", "false", "0")))


def of_kept(df: DataFrame, manifest: DataFrame, file: str = "file") -> DataFrame:
    """Rows of kept files with the manifest's columns; the manifest is small only if Spark finds it so."""
    return df.join(kept_files(manifest, file), file)


def json_lines(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a JSON-lines file: bad has the line's text, its file and what is wrong."""
    rows = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parsed = rows.where(F.trim("value") != "").withColumn("_row", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    missing = F.array_compact(F.array(*[F.when(F.col(f"_row.{c}").isNull(), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    wrong = F.when(F.col("_row").isNull() | F.col("_row._corrupt_record").isNotNull(), "not JSON of this schema").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    checked = parsed.withColumn("error", wrong)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return checked.where("error is null").select(*[F.col(f"_row.{n}").alias(n) for n in names]), checked.where("error is not null").select("value", "file", "error")


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of a folder of JSON files, one a file; unreadable ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def stream_of(spark: SparkSession, path: str, schema: str, files: int = 1, kind: str = "parquet") -> DataFrame:
    """A replay of files as a stream, ``files`` at a time in order of their age."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def appended(known: DataFrame, arrived: DataFrame, file: str = "file", failed: str = "is_failure", readable: str = "readable") -> tuple[DataFrame, DataFrame]:
    """(added, skipped): files not known before; those unreadable or no failure are skipped with a reason."""
    new = arrived.dropDuplicates([file]).join(known.select(file), file, "left_anti")
    reason = F.when(~F.col(readable), "unreadable").when(~F.col(failed), "no failure")
    marked = new.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def integrity(manifest: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """(key, problem) of sources whose hash or page count differ from the manifest, or that are on one side only."""
    a = manifest.select(key, F.col("sha256").alias("_sha"), F.col("pages").alias("_pages"))
    b = found.select(key, "sha256", "pages").withColumn("_found", F.lit(True))
    j = a.withColumn("_listed", F.lit(True)).join(b, key, "full_outer")
    problem = (
        F.when(F.col("_found").isNull(), "missing").when(F.col("_listed").isNull(), "not listed")
        .when(~F.col("_sha").eqNullSafe(F.col("sha256")), "changed").when(~F.col("_pages").eqNullSafe(F.col("pages")), "page count")
    )
    return j.select(key, problem.alias("problem")).where("problem is not null")
