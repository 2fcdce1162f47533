"""Searches of many queries in many rows: blocks of both meet inside tasks, never as a table of pairs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def searched(queries: DataFrame, rows: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], out: str, query_id: str, row_id: str, block: int, span: int) -> DataFrame:
    """``search(queries, rows)`` over each pair of a block of queries and a range of rows.

    Blocks and ranges are made by a hash of the ids, about ``block`` queries and ``span`` rows each, so a
    task holds that much and no more; only the two counts come to the driver. Each side is repeated once
    for each part of the other: the shuffle is rows * blocks + queries * ranges, and not their product.
    """
    blocks, ranges = (max(1, -(-df.count() // n)) for df, n in ((queries, block), (rows, span)))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select("*", part(query_id, blocks).alias("_block")).select("*", number(ranges).alias("_range"))
    r = rows.select("*", part(row_id, ranges).alias("_range")).select("*", number(blocks).alias("_block"))
    return q.groupBy("_range", "_block").cogroup(r.groupBy("_range", "_block")).applyInArrow(search, out)
