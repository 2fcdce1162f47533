"""``registry.rounded`` against DuckDB's round, where a double lies on or just beside a half."""

import math

import duckdb
import pytest

from gaugeworks.plans.registry import rounded


@pytest.mark.parametrize("digits", [4, 6])
def test_halves_are_rounded_as_sql_does(spark, digits):
    halves = [(2 * i + 1) / 2 / 10**digits for i in range(0, 2_000_000, 9973)]
    values = [y for x in halves for h in (x, -x) for y in (h, math.nextafter(h, 9), math.nextafter(h, -9))]
    con = duckdb.connect()
    want = [con.execute(f"SELECT round(?::DOUBLE, {digits})", [x]).fetchall()[0][0] for x in values]
    rows = rounded(spark.createDataFrame(list(enumerate(values)), "i int, x double"), digits).collect()
    assert [r["x"] for r in sorted(rows)] == want


def test_rounding_keeps_what_has_no_digits(spark):
    values = [None, math.inf, -math.inf, 1.7e308, 0.0]
    rows = rounded(spark.createDataFrame(list(enumerate(values)), "i int, x double")).collect()
    assert [r["x"] for r in sorted(rows)] == values
