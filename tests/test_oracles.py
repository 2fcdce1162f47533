"""Every registered query against its SQL in DuckDB."""

import pytest

from compare import difference
from gaugeworks.plans import oracles, queries

QUERIES, ORACLES = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert difference(df, ORACLES[name], sf_dir) == ""
    else:
        assert df.count() > 0
