"""Where each query is registered beside the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Durations of the registered queries, in microseconds: events lie hours apart.
HOUR = 3_600_000_000
DAY = 24 * HOUR

#: The table ``events`` as readings of guns, in DuckDB's SQL; ``readings`` is the same in Spark.
READINGS = """ev AS (SELECT user_id AS gun, epoch_us(ts) AS t, event_type AS code, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` may use ``ev`` if it names it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if " ev" in body and not body.startswith("WITH RECURSIVE"):
                body = f"WITH {READINGS}, {body[5:]}" if body.startswith("WITH ") else f"WITH {READINGS} {body}"
            elif " ev" in body:
                body = f"WITH RECURSIVE {READINGS}, {body[len('WITH RECURSIVE ') :]}"
            ORACLES[f.__name__] = body
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> str:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's time zone."""
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as readings: gun, t (microseconds), code, value, k, event_id."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as gun", f"{micros('ts')} as t", "event_type as code", "value", "cast(get_json_object(props, '$.k') as int) as k", "event_id"
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, so that the order of a sum doesn't show.

    As DuckDB rounds: the scaled double, whose product takes a last bit less than a half up to it.
    """
    scale = 10.0**digits
    return df.withColumns({n: F.when(F.abs(n) < 1e300, F.round(F.col(n) * scale, 0) / scale).otherwise(F.col(n)) for n, kind in df.dtypes if kind == "double"})


def drawn(*parts: str) -> str:
    """DuckDB's SQL for ``functions.text.draw``."""
    text = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
