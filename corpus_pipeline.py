"""A corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. SQL can express none of the stages in full, so ``ORACLE_SQL`` is None; the tests hold each
stage's operator against brute force, the stages against planted rows, and ``run`` against its stages. A row with a null doc_id passes the stages that find documents
by id (near-duplicates, passages) unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import packing, quality, secret_scan, simhash, substring
from gaugeworks.llm.queries import tokenizer_path
from gaugeworks.llm.shared import staged


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that links reach: SimHashes of 3 or fewer differing bits, found by pigeonring chains, or five-word shingles alike (0.8 or more)."""
    groups = simhash.joined_groups(simhash.near_duplicate_groups(docs), simhash.similar_groups(docs))
    return simhash.one_of_each_group(docs, groups)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller doc_id has too."""
    return _measured(substring.without_passages(docs, substring.repeated_passages(docs)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by its kind."""
    return _measured(secret_scan.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
